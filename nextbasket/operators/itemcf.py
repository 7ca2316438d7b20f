"""Item-item collaborative filtering over coordinate rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import top_k
from ..sources.scratch import written
from .popularity import filled, recent, top_popular

#: Pairs of items that a task counts, about.
PAIRS = 1_000_000


def recent_supported(transactions: DataFrame, newest: dt.date, recent_weeks: int = 16, min_support: int = 20) -> DataFrame:
    """Recent rows of articles with at least min_support rows."""
    rows = recent(transactions, newest, recent_weeks)
    kept = rows.groupBy("article_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    return rows.join(kept.select("article_id"), "article_id", "left_semi")


def interactions(rows: DataFrame, max_items: int | None = None) -> DataFrame:
    """Distinct (customer, article); max_items bounds the pairs that one customer makes by keeping the newest, None keeps all."""
    if max_items is None:
        return rows.select("customer_id", "article_id").distinct()
    last = rows.groupBy("customer_id", "article_id").agg(F.max("t_dat").alias("last"))
    return top_k(last, ["customer_id"], [F.desc("last"), F.col("article_id")], max_items).select("customer_id", "article_id")


def item_similarity(pairs: DataFrame, block: int = 256, most: int = PAIRS, of: DataFrame | None = None) -> DataFrame:
    """item_i, item_j, co, sim = co / sqrt(n_i * n_j), both directions, no diagonal. Integer counts first, one division last.

    of(article_id): the items wanted as item_i; all if not given. An item travels with the lists of its customers' items, in lists of about
    `block`, so that no task makes all pairs of one customer; a task counts about `most` pairs, those of an item with more are dealt by item_j.
    """
    n = pairs.groupBy("article_id").agg(F.count("*").alias("n"))
    size = F.count("*").over(Window.partitionBy("customer_id"))
    own = written(pairs.withColumn("size", size).join(n, "article_id").where("size > 1").withColumn("blocks", F.ceil(F.col("size") / block)))
    wanted = own if of is None else own.join(of.select("article_id"), "article_id", "left_semi")
    work = wanted.groupBy("article_id").agg(F.sum("size").alias("work"))
    total, largest = work.agg(F.coalesce(F.sum("work"), F.lit(0)), F.coalesce(F.max("work"), F.lit(0))).first()  # one row
    lists = own.groupBy("customer_id", F.pmod(F.xxhash64("article_id"), "blocks").alias("part")).agg(F.collect_list(F.struct("article_id", "n")).alias("others"))
    each = wanted.select("customer_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"), F.col("article_id").alias("item_i"), F.col("n").alias("n_i"))
    rows, by = each.join(lists, ["customer_id", "part"]).select("item_i", "n_i", "others"), ["item_i"]
    if largest > most:
        dealt = rows.join(work.select(F.col("article_id").alias("item_i"), F.ceil(F.col("work") / most).alias("deals")), "item_i")
        dealt = dealt.select("item_i", "n_i", "others", "deals", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
        rows, by = dealt.withColumn("others", F.filter("others", lambda x: F.pmod(F.xxhash64(x["article_id"]), F.col("deals")) == F.col("deal"))), ["item_i", "deal"]
    # two arrays are shuffled, as they are smaller than one of structs
    sent = rows.select(*by, "n_i", F.col("others.article_id").alias("items"), F.col("others.n").alias("ns")).repartition(max(8, -(-total // most)), *by)
    each_pair = sent.select(*by, "n_i", F.inline(F.arrays_zip(F.col("items").alias("item_j"), F.col("ns").alias("n_j")))).where("item_i != item_j")
    co = each_pair.groupBy(*by, "item_j").agg(F.count("*").alias("co"), F.first("n_i").alias("n_i"), F.first("n_j").alias("n_j"))
    return co.select("item_i", "item_j", "co", F.round(F.col("co") / F.sqrt(F.col("n_i") * F.col("n_j")), 9).alias("sim"))


def item_neighbours(similarity: DataFrame, top: int = 100) -> DataFrame:
    return top_k(similarity, ["item_i"], [F.desc("sim"), F.col("item_j")], top)


def cf_scores(pairs: DataFrame, neighbours: DataFrame, users: DataFrame) -> DataFrame:
    """customer_id, article_id, score: sums over the user's items, without these."""
    own = pairs.join(users.select("customer_id"), "customer_id", "left_semi")
    sums = own.join(neighbours.select(F.col("item_i").alias("article_id"), "item_j", "sim"), "article_id").groupBy("customer_id", F.col("item_j").alias("other")).agg(F.round(F.sum("sim"), 6).alias("score"))
    sums = sums.withColumnRenamed("other", "article_id")
    return sums.where("score > 0").join(own, ["customer_id", "article_id"], "left_anti")


def item_cf(rows: DataFrame, pairs: DataFrame, neighbours: DataFrame, users: DataFrame, k: int = 12, fallback_n: int = 100) -> DataFrame:
    """Best scores first; filled with popular articles that the user has not. Users without a score get the plain list."""
    best = top_k(cf_scores(pairs, neighbours, users), ["customer_id"], [F.desc("score"), F.col("article_id")], k)
    seen = pairs.join(best.select("customer_id").distinct(), "customer_id", "left_semi")
    return filled(users, best, top_popular(rows, fallback_n), k, seen)
