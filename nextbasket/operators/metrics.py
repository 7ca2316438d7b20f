"""Ranking metrics and error analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import age_group


def ap_at_k(predictions: DataFrame, truth: DataFrame, k: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """ap for each truth user (and each value of by, which predictions carry): hits / rank at hits, over min(|truth|, k)."""
    keys = [*by, "customer_id"]
    sizes = truth.groupBy("customer_id").agg(F.count("*").alias("size"))
    hits = predictions.where(F.col("rank") <= k).join(truth, ["customer_id", "article_id"])
    at = F.count("*").over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    sums = hits.select(*keys, (at / F.col("rank")).alias("p")).groupBy(*keys).agg(F.sum("p").alias("p"))
    users = sizes.crossJoin(F.broadcast(predictions.select(*by).distinct())) if by else sizes
    return users.join(sums, keys, "left").select(*keys, (F.coalesce("p", F.lit(0.0)) / F.least("size", F.lit(k))).alias("ap"))


def map_at_k(predictions: DataFrame, truth: DataFrame, k: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """Over truth users; those without a prediction count 0."""
    return ap_at_k(predictions, truth, k, by).groupBy(*by).agg(F.avg("ap").alias("map"), F.count("*").alias("users"))


def compare_models(scores: DataFrame, others: tuple[str, ...] = ("two_stage", "item_cf")) -> DataFrame:
    """model, map, place, lift over the best baseline (null where that is 0): all models but `others` are baselines. A few rows."""
    w = Window.partitionBy(F.lit(1))
    best = F.max(F.when(~F.col("model").isin(*others), F.col("map"))).over(w)
    return scores.select("model", "map", F.row_number().over(w.orderBy(F.desc("map"), "model")).alias("place"), F.try_divide(F.col("map") - best, best).alias("lift"))


def ap_by_age_group(ap: DataFrame, customers: DataFrame) -> DataFrame:
    grouped = ap.join(customers.select("customer_id", age_group(F.col("age")).alias("age_group")), "customer_id")
    return grouped.where("age_group is not null").groupBy("age_group").agg(F.avg("ap").alias("map"), F.count("*").alias("users"))


def ap_by_purchase_bin(ap: DataFrame, before: DataFrame) -> DataFrame:
    """before: the transactions before the test week."""
    counts = before.groupBy("customer_id").agg(F.count("*").alias("n"))
    n = F.col("n")
    bin_ = F.when(n <= 5, "1-5").when(n <= 15, "6-15").when(n <= 30, "16-30").when(n <= 60, "31-60").when(n <= 1000, "61+")
    return ap.join(counts, "customer_id").withColumn("bin", bin_).where("bin is not null").groupBy("bin").agg(F.avg("ap").alias("map"), F.count("*").alias("users"))


def ap_zero_share(ap: DataFrame) -> DataFrame:
    return ap.agg(F.avg((F.col("ap") == 0).cast("double")).alias("zero_share"), F.count("*").alias("users"))


def ap_histogram(ap: DataFrame, bins: int = 50) -> DataFrame:
    return ap.groupBy(F.least(F.floor(F.round(F.col("ap") * bins, 9)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("users"))
