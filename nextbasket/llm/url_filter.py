"""URL filters: a cascade of Bloom filters gives exact membership over the corpus's key universe.

Level 1 encodes the listed keys; level 2 the unlisted keys of the universe that level 1 lets through; level 3 the
listed keys that level 2 lets through, and so on until a level has no false positives. A key of the universe is
listed if the number of levels that it passes before its first miss is odd. All of it is DataFrame expressions:
a level is a string of bits inside the plan, so that judging a key needs no join. Keys are dealt by a hash into parts with a
cascade each, as many as keep a plan small, and each part is one narrow pass over the rows; so lists may be of any size.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, saved, table

#: Bits of a block of bitmap_construct_agg.
BLOCK = 32768
#: Wanted size of the first filter of a part, in bytes.
FILTER_BYTES = 8 << 20


def key_hash(key, salt: int):
    return F.xxhash64(key, F.lit(salt))


@dataclass(frozen=True)
class Bloom:
    """k positions among m bits; bits is the byte string, lowest bit first."""

    bits: bytes
    m: int
    k: int
    salt: int

    @staticmethod
    def positions(key, m: int, k: int, salt: int):
        """Double hashing: an array of k positions from two 64-bit hashes."""
        a, b = F.pmod(key_hash(key, salt), F.lit(m)), F.pmod(key_hash(key, salt + 1), F.lit(m))
        return F.transform(F.array(*map(F.lit, range(k))), lambda i: F.pmod(a + i * b, F.lit(m)))

    @classmethod
    def build(cls, keys: DataFrame, n: int, p: float, salt: int) -> Bloom:
        """keys: one column named key, of n rows; p: the wanted share of false positives."""
        m = max(64, math.ceil(-max(n, 1) * math.log(p) / math.log(2) ** 2))
        k = max(1, min(16, round(m / max(n, 1) * math.log(2))))
        at = F.explode(F.array_distinct(cls.positions(F.col("key"), m, k, salt)))
        rows = (
            keys.select(at.alias("at"))
            .groupBy(F.bitmap_bucket_number("at").alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
            .collect()  # m bits in all
        )
        # bucket 1 holds the positions 1..BLOCK, bucket 0 the position 0
        out = bytearray((m // BLOCK + 2) * BLOCK // 8)
        for block, bits in rows:
            out[block * BLOCK // 8 : block * BLOCK // 8 + len(bits)] = bits
        return cls(bytes(out), m, k, salt)

    def might_contain(self, key):
        """The bits are in the expression once. A null key seems to be contained."""

        def hit(at):
            block, bit = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
            byte = F.substring(F.lit(self.bits), (block * F.lit(BLOCK // 8) + F.shiftright(bit, 3) + F.lit(1)).cast("int"), F.lit(1))
            return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(bit, F.lit(8)).cast("int")) == 1

        return F.forall(self.positions(key, self.m, self.k, self.salt), hit)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    @classmethod
    def build(cls, ins: DataFrame, other: DataFrame, r: int, s: int) -> Cascade:
        """ins, other: the r listed and the other keys of a universe of s keys, a column key each. An empty list gives no level."""
        if not r:
            return cls(())
        outs, levels = ins, []
        n, p = r, first_share(r, s)
        while n:
            level = Bloom.build(outs, n, p, 2 * len(levels) + 1)
            levels.append(level)
            wrong = saved(other.where(level.might_contain(F.col("key"))))
            outs, other, n, p = wrong, outs, wrong.count(), 0.5
        return cls(tuple(levels))

    def contains(self, key):
        """Exact for keys of the universe."""
        out = F.lit(False)
        for i, level in reversed(list(enumerate(self.levels))):
            deeper = out if i + 1 < len(self.levels) else F.lit(i % 2 == 0)
            out = F.when(level.might_contain(key), deeper).otherwise(F.lit(i % 2 == 1))
        return out


def first_share(r: int, s: int) -> float:
    """The wanted share of false positives of level 1: about 0.7 r unlisted keys come through, so that the levels shrink by half each."""
    return min(0.5, math.sqrt(0.5) * r / max(1, s - r))


def hits(df: DataFrame, keys: str, out: str, listed: DataFrame, universe: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """df with an array column out: those of the array column keys that are listed. listed, universe: a column key each; universe holds all of keys.

    Null keys, and listed keys outside the universe, have no effect. Each part of the keys is one pass over df, which is written between two of them.
    """
    every = saved(universe.select("key").where("key is not null").distinct())
    ins = saved(listed.select("key").where("key is not null").distinct().join(every, "key", "left_semi"))
    other = every.join(ins, "key", "left_anti")
    r, s = ins.count(), every.count()
    parts = max(1, math.ceil(-r * math.log(first_share(r, s)) / math.log(2) ** 2 / 8 / filter_bytes)) if r else 1
    if parts > 1:
        other = saved(other)
    part = lambda k: F.pmod(key_hash(k, 0), F.lit(parts))
    df = df.withColumn(out, F.array().cast("array<string>"))
    for i in range(parts):
        mine = part(F.col("key")) == i
        ours = ins.where(mine), other.where(mine)
        n = r if parts == 1 else ours[0].count()
        cascade = Cascade.build(*ours, n, s if parts == 1 else n + ours[1].count())
        own = F.filter(keys, lambda k: k.isNotNull() & (part(k) == i) & cascade.contains(k))  # noqa: B023
        df = df.withColumn(out, F.concat(out, own))
        if i + 1 < parts:
            df = saved(df)
    return df


def member(df: DataFrame, key: str, listed: DataFrame, out: str, **limits: int) -> DataFrame:
    """df with a boolean column out: whether key, a string, is listed (false for null). The universe is df's own keys."""
    names = [n for n in (f"_{k}" for k in range(len(df.columns) + 2)) if n not in df.columns]
    found = hits(df.withColumn(names[0], F.array(key)), names[0], names[1], listed, df.select(F.col(key).alias("key")), **limits)
    return found.withColumn(out, F.size(names[1]) > 0).drop(*names[:2])


def split_url(url):
    """(host, path): both empty without '://'. The host ends at the first of / ? #, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", **limits: int) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url, ...).

    rules(host, path, verdict): a rule fits its host and all subdomains where the url's path starts with the rule's;
    the longest host + path wins. A page's keys are the pairs of a host suffix and a path prefix whose shape (labels of
    the host, length of the path) some rule has, so their number depends on the rules alone. One cascade finds which keys
    are rules, a second which rules block; both are exact over all keys of pages. Nulls: a null url has an empty
    host and path, a null page_id stays; a rule with a null host is none, a null path is ''. Repeated rows stay. Without a rule
    that fits: rule null, verdict = default. Two equal rules of different verdicts: block wins. Other columns of pages are
    dropped. Empty tables give no rows, or no rules.
    """
    rules = rules.where("host is not null").select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.withColumns({"key": F.concat("host", F.lit("\n"), "path"), "labels": F.size(F.split("host", r"\.")), "chars": F.length("path")})
    # a row for each number of labels, of which a host has 127 at most; in it the lengths of paths
    shapes = [{"labels": r[0], "chars": r[1]} for r in rules.groupBy("labels").agg(F.array_sort(F.collect_set("chars"))).orderBy("labels").collect()]
    shape = F.from_json(F.lit(json.dumps(shapes)), "array<struct<labels:int,chars:array<int>>>")
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path")).withColumn("label", F.split("host", r"\."))

    def of(s):
        end = F.concat(F.array_join(F.slice("label", F.size("label") - (s["labels"] - 1), s["labels"]), "."), F.lit("\n"))
        return F.transform(F.filter(s["chars"], lambda c: c <= F.length("path")), lambda c: F.concat(end, F.substring(F.col("path"), F.lit(1), c)))

    keys = F.flatten(F.transform(F.filter(shape, lambda s: (s["labels"] <= F.size("label")) & (F.col("host") != "")), of))
    keyed = urls.withColumn("keys", keys).drop("label")
    found = hits(keyed, "keys", "fits", rules.select("key"), keyed.select(F.explode("keys").alias("key")), **limits)
    best = F.array_max(F.transform("fits", lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    found = hits(found.select("page_id", "host", "path", F.array(best).alias("best")), "best", "blocks", rules.where("verdict = 'block'").select("key"), rules.select("key"), **limits)
    key = F.get("best", F.lit(0))
    return found.select(
        "page_id",
        "host",
        "path",
        F.regexp_replace(key, "\n", "").alias("rule"),
        F.when(key.isNull(), F.lit(default)).when(F.size("blocks") > 0, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )


#: The rules of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
OP3_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))} END AS rule FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({", ".join(f"'{h}{p}'" for h, p, v in RULES if v == "block")}) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
