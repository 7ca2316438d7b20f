"""Cleaning, obsolete articles and time splits. Every split is a date filter that reaches the scan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..functions.order import median


def reduce_memory(df: DataFrame) -> DataFrame:
    small = {"double": "float", "bigint": "int"}
    return df.select(*(F.col(c).cast(small.get(t, t)).alias(c) for c, t in df.dtypes))


def week_index(transactions: DataFrame) -> DataFrame:
    """week: 0 is the newest."""
    newest = transactions.agg(F.max("t_dat").alias("newest"))
    return transactions.crossJoin(F.broadcast(newest)).withColumn("week", F.floor(F.datediff("newest", "t_dat") / 7).cast("int")).drop("newest")


def old_sales_ratio(transactions: DataFrame, cutoff: dt.date) -> DataFrame:
    return transactions.groupBy("article_id").agg(F.count("*").alias("total"), F.avg((F.col("t_dat") < F.lit(cutoff)).cast("double")).alias("old_ratio"))


def old_ratio_histogram(ratios: DataFrame, bins: int = 50, threshold: float = 0.95) -> DataFrame:
    """bin, articles, obsolete: articles of old_sales_ratio by equal bins between the smallest and the largest ratio."""
    ends = ratios.agg(F.min("old_ratio").alias("lo"), F.max("old_ratio").alias("hi"))
    return histogram(ratios, "old_ratio", ends, bins).agg(F.count("*").alias("articles"), F.sum((F.col("old_ratio") >= threshold).cast("int")).alias("obsolete"))


def histogram(df: DataFrame, value: str, ends: DataFrame, bins: int) -> GroupedData:
    """df grouped by bin: equal bins between the ends lo and hi (one row), the last one closed; one value alone is in the middle of a range of 1."""
    even = F.col("hi") == F.col("lo")
    at = F.floor(F.round((F.col(value) - F.when(even, F.col("lo") - 0.5).otherwise(F.col("lo"))) / F.when(even, 1.0).otherwise(F.col("hi") - F.col("lo")) * bins, 9))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))


def obsolete_articles(transactions: DataFrame, cutoff: dt.date, threshold: float = 0.95) -> DataFrame:
    """Articles sold almost only before cutoff."""
    return old_sales_ratio(transactions, cutoff).where(F.col("old_ratio") >= threshold).select("article_id")


def drop_obsolete(candidates: DataFrame, obsolete: DataFrame) -> DataFrame:
    return candidates.join(obsolete.select("article_id"), "article_id", "left_anti")


def clean_customers(customers: DataFrame, age: float | None = None) -> DataFrame:
    """age: a fitted median; the exact median of the frame if it is not given."""
    if age is None:
        age = median(customers, "age")
    return customers.fillna({"club_member_status": "UNKNOWN", "fashion_news_frequency": "NONE"} | ({"age": age} if age is not None else {}))


def clean_articles(articles: DataFrame) -> DataFrame:
    return articles.fillna("UNKNOWN", [c for c, t in articles.dtypes if t == "string"])


def week_split(transactions: DataFrame, train_weeks: int = 8, val_weeks: int = 1, test_weeks: int = 1) -> DataFrame:
    """split: test, val or train by week index; older rows are dropped."""
    w, a, b = F.col("week"), test_weeks, test_weeks + val_weeks
    split = F.when(w < a, "test").when(w < b, "val").when(w < b + train_weeks, "train")
    return week_index(transactions).withColumn("split", split).where("split is not null")


@dataclass(frozen=True)
class Bounds:
    """The days at which the canonical split cuts."""

    newest: dt.date
    test_start: dt.date
    val_start: dt.date
    train_start: dt.date


def bounds(transactions: DataFrame, train_start: dt.date, test_days: int = 7, val_days: int = 7) -> Bounds:
    newest = transactions.agg(F.max("t_dat")).first()[0]  # one row
    test = newest - dt.timedelta(days=test_days - 1)
    return Bounds(newest, test, test - dt.timedelta(days=val_days), train_start)


def between(transactions: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """start <= t_dat < end."""
    if start is not None:
        transactions = transactions.where(F.col("t_dat") >= F.lit(start))
    return transactions if end is None else transactions.where(F.col("t_dat") < F.lit(end))


def canonical_split(transactions: DataFrame, b: Bounds) -> dict[str, DataFrame]:
    """train (val is in it), val, test, and train_feat, the history before val."""
    return {"train": between(transactions, b.train_start, b.test_start), "val": between(transactions, b.val_start, b.test_start), "test": between(transactions, b.test_start, None), "train_feat": between(transactions, b.train_start, b.val_start)}


def ground_truth(transactions: DataFrame) -> DataFrame:
    return transactions.select("customer_id", "article_id").distinct()


def ranker_splits(transactions: DataFrame, b: Bounds) -> dict[str, DataFrame]:
    """train_full, train_feat and val, transactions; val_truth and test_truth, distinct pairs."""
    parts = canonical_split(transactions, b)
    return {"train_full": parts["train"], "train_feat": parts["train_feat"], "val": parts["val"], "val_truth": ground_truth(parts["val"]), "test_truth": ground_truth(parts["test"])}


def multi_week_splits(history: DataFrame, test_start: dt.date, n_weeks: int = 3, first_offset_weeks: int = 1) -> list[tuple[dt.date, DataFrame, DataFrame]]:
    """(label start, history before it, label rows) for each of the weeks; a loop over plans, not over data."""
    out = []
    for w in range(first_offset_weeks, first_offset_weeks + n_weeks):
        end = test_start - dt.timedelta(weeks=w)
        start = end - dt.timedelta(days=7)
        out.append((start, between(history, None, start), between(history, start, end)))
    return out


def sample_customers(transactions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The rows of n customers, chosen by a seeded hash."""
    chosen = transactions.select("customer_id").distinct().orderBy(F.md5(F.concat_ws(":", F.col("customer_id").cast("string"), F.lit(seed))), "customer_id").limit(n)
    return transactions.join(chosen, "customer_id", "left_semi")
