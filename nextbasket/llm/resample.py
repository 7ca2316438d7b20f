"""Target-distribution importance resampling: hashed n-gram weights scored by arrays, and a draw without replacement.

1. Each task counts hashed features of its texts in one array of fixed size; the arrays of both corpora give a gain for each bucket.
2. A document's weight is the sum of its features' gains; noise of its id makes the highest scores a draw without replacement.
3. The cutoff of the draw: a quantile sketch of the scores gives a bracket around it. The rows above and inside are counted
   exactly: a bracket that misses the place is widened, at last to all scores. Only the rows inside are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, slices, spans_of, table

#: Bytes that divide words: ASCII but for digits and lower case, once A-Z are lower-cased.
DIVIDES = np.zeros(256, bool)
DIVIDES[:128] = [not (chr(c).isdigit() or chr(c).isalpha()) for c in range(128)]
#: Longer features are hashed one by one.
LONG = 64
#: Bytes of texts that are turned at a time: the arrays of a task take some ten times as much.
PIECE = 1 << 18


def _crc_table() -> np.ndarray:
    """Of the CRC-32 of zlib, by its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for each pair: place by place over all of them at once, the long ones alone."""
    out, size = np.zeros(len(start), np.uint32), end - start
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]])
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG]
    at, left = start[order], np.searchsorted(-size[order], -np.arange(LONG), "left")  # left[k]: how many have more than k bytes
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[order[0]]) if len(order) else 0):
        m = left[k]
        c[:m] = CRC[(c[:m] ^ data[at[:m] + k]) & 0xFF] ^ (c[:m] >> np.uint32(8))
    out[order] = ~c
    return out


def features(data: np.ndarray, at: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to longest words, text by text; how many features and how many words each text has."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, begin = spans_of(data, at, DIVIDES)
    words = np.diff(begin)
    # words one space apart: the byte after each word stays, as a space
    after = end[end < len(data)]
    after = after[DIVIDES[data[after]]]
    keep = ~DIVIDES[data]
    keep[after] = True
    data[after] = 32
    place = np.append(0, np.cumsum(keep))
    data, start, end = data[keep], place[start], place[end]
    text = np.repeat(np.arange(len(words)), words)
    found, owner = [], []
    for n in range(1, longest + 1):
        i = np.arange(len(start) - n + 1)
        i = i[text[i] == text[i + n - 1]] if n > 1 else i
        found.append(crc32(data, start[i], end[i + n - 1]))
        owner.append(text[i])
    found, owner = np.concatenate(found), np.concatenate(owner)
    if longest > 1:
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return (found % np.uint32(buckets)).astype(np.int64), np.bincount(owner, minlength=len(words)), words


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features by bucket over all texts: one array from each task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, at in slices(b["text"], PIECE):
                total += np.bincount(features(data, at, longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: thousandths of the log ratio of its smoothed shares, rounded down."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of each row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for b in batches:
            for i, j, data, at in slices(b["text"], PIECE):
                found, n, words = features(data, at, longest, len(gain))
                sums = np.append(0, np.cumsum(gain[found]))
                ends = np.append(0, np.cumsum(n))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(words.astype(np.int64)), pa.array(sums[ends[1:]] - sums[ends[:-1]])], ["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def placed(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with its place from 1 in the order: ranges of it are sorted each, and add the rows of those before. Ties are placed one after another."""
    parts = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_own") + F.col("_before")).alias(out))


def bracket(scores: DataFrame, place: int, rows: int, width: float = 0.005, accuracy: int = 10000) -> tuple[int, int, int, int]:
    """low, high, above, inside: the score at this place from the highest is in low..high. above: rows of scores over high. inside: rows in the bracket.

    The sketch's quantiles around the place are only a guess; counts of all rows decide. A bracket that misses is widened fourfold.
    """
    while True:
        share = 1 - (place - 0.5) / rows
        ends = [max(0.0, share - width), min(1.0, share + width)]
        low, high = scores.agg(F.min("score") if ends[0] == 0 else F.percentile_approx("score", ends[0], accuracy), F.max("score") if ends[1] == 1 else F.percentile_approx("score", ends[1], accuracy)).first()
        above, inside = scores.agg(F.count(F.when(F.col("score") > high, 1)), F.count(F.when(F.col("score").between(low, high), 1))).first()
        if above < place <= above + inside:
            return low, high, above, inside
        width *= 4


def draw(rows: DataFrame, percent: int, least: int) -> DataFrame:
    """rows (saved, with n_words and score) with rank: the best floor(percent * N / 100) of the N rows of at least `least` words."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("n_words")]  # rows that tie in all of these are alike
    fit = rows.where(F.col("n_words") >= least)
    n = fit.count()
    want = percent * n // 100
    if not want:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    low, high, above, _ = bracket(fit.select("score"), want, n)
    within = placed(fit.where(F.col("score").between(low, high)), order, "place")
    drawn = fit.where(F.col("score") > high).unionByName(within.where(F.col("place") <= want - above).drop("place"))
    ranked = placed(drawn, order, "rank").withColumn("rank", F.col("rank").cast("long"))
    # whatever is not drawn: below the bracket, in it beyond the place, or too short
    rest = fit.where(F.col("score") < low).unionByName(within.where(F.col("place") > want - above).drop("place")).unionByName(rows.where(F.col("n_words") < least))
    return ranked.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank for each row of docs(doc_id, text, ...); rank is null where a row is not drawn.

    target(text, ...) is the corpus whose distribution is aimed at. Features are runs of 1 to longest words in buckets of a checksum. Nulls: a null text
    is empty; a null doc_id has the noise of an empty id and comes last among ties. Empty and short texts have a weight and a score but are never drawn. Texts of any length
    are whole. Ties go to the smaller doc_id; rows that repeat a doc_id are drawn each, those of one score in any order. An empty table gives no rows; an empty target
    counts as one whose buckets are all equal. Other columns are dropped.
    """
    rows = saved(scored(docs, gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets)), longest, seed))
    return draw(rows, percent, least)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the target is the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: The same in SQL: the checksum goes byte by byte over the distinct words.
OP11_SQL = r"""
with recursive texts as (select 0 as side, doc_id, row_number() over () as r, coalesce(text, '') as text from documents
  union all select 1, null, row_number() over (), coalesce(text, '') from benchmark),
words as (select side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from texts),
steps(value, c, step) as (select i, i, 0 from range(256) t(i)
  union all select value, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, step + 1 from steps where step < 8),
crc as (select list(c order by value) as t from steps where step = 8),
vocabulary as (select word, hex(encode(word)) as h from (select distinct word from words)),
hashed as (select word, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 as bucket from vocabulary, crc),
placed as (select side, r, bucket from words join hashed using (word)),
counts as (select i as bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from range(10000) b(i) left join placed on bucket = i group by i),
gain as (select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from counts),
weights as (select r, count(*) as n, sum(gain) as weight from placed join gain using (bucket) where side = 0 group by r),
scores as (select doc_id, r, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::bigint + 0.5) / 4294967296))))::bigint as score from texts left join weights using (r) where side = 0),
ranked as (select *, row_number() over (order by score desc, doc_id) as place, count(*) over () as docs from scores where n_features >= 20)
select doc_id, n_features, weight, score, place::bigint as rank from ranked where place <= 10 * docs // 100
union all select doc_id, n_features, weight, score, null from ranked where place > 10 * docs // 100
union all select doc_id, n_features, weight, score, null from scores where n_features < 20
"""
