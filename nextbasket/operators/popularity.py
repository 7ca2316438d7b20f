"""Popularity and repurchase recommenders. Predictions are rows (customer_id, rank, article_id)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import age_group, top_k


def top_popular(transactions: DataFrame, n: int = 100) -> DataFrame:
    """article_id, n, rank; ties by article_id. The rank is taken over n rows."""
    best = transactions.groupBy("article_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "article_id").limit(n)
    return top_k(best.withColumn("one", F.lit(1)), ["one"], [F.desc("n"), F.col("article_id")], None).drop("one")


def recent(transactions: DataFrame, newest: dt.date, weeks: int) -> DataFrame:
    """Rows from newest - weeks on: 7 * weeks + 1 days."""
    return transactions.where(F.col("t_dat") >= F.lit(newest - dt.timedelta(weeks=weeks)))


def same_for_all(users: DataFrame, top: DataFrame, k: int = 12) -> DataFrame:
    """Every user gets the k rows of the list, which is small by its limit."""
    return users.select("customer_id").crossJoin(F.broadcast(top.where(F.col("rank") <= k).select("rank", "article_id")))


def user_history(transactions: DataFrame, users: DataFrame | None = None, top_n: int = 100) -> DataFrame:
    """Distinct articles of each user, newest first."""
    if users is not None:
        transactions = transactions.join(users.select("customer_id"), "customer_id", "left_semi")
    last = transactions.groupBy("customer_id", "article_id").agg(F.max("t_dat").alias("last"))
    return top_k(last, ["customer_id"], [F.desc("last"), F.col("article_id")], top_n)


def merged_history(state: DataFrame | None, transactions: DataFrame, top_n: int = 100) -> DataFrame:
    """The histories (customer_id, article_id, last, rank) after further days: state holds at most top_n rows of each customer, so a day's merge reads neither older days nor more.

    An article that fell out of a customer's first top_n can come back by a new purchase alone, so the state after many merges is that of the whole history.
    """
    new = transactions.groupBy("customer_id", "article_id").agg(F.max("t_dat").alias("last"))
    if state is not None:
        new = state.select("customer_id", "article_id", "last").unionByName(new).groupBy("customer_id", "article_id").agg(F.max("last").alias("last"))
    return top_k(new, ["customer_id"], [F.desc("last"), F.col("article_id")], top_n)


def filled(users: DataFrame, own: DataFrame, fallback: DataFrame, k: int = 12, seen: DataFrame | None = None) -> DataFrame:
    """own rows (rank <= k), then fallback rows that are not among own (nor seen) until k."""
    own = own.where(F.col("rank") <= k).select("customer_id", F.lit(0).alias("late"), "rank", "article_id")
    more = users.select("customer_id").crossJoin(F.broadcast(fallback.select("rank", "article_id")))
    for known in (own, seen):
        if known is not None:
            more = more.join(known.select("customer_id", "article_id"), ["customer_id", "article_id"], "left_anti")
    both = own.unionByName(more.withColumn("late", F.lit(1))).withColumnRenamed("rank", "place")
    return top_k(both, ["customer_id"], [F.col("late"), F.col("place")], k).select("customer_id", "rank", "article_id")


def repurchase(transactions: DataFrame, users: DataFrame, fallback: DataFrame, k: int = 12, top_n: int = 100) -> DataFrame:
    return filled(users, user_history(transactions, users, min(k, top_n)), fallback.where(F.col("rank") <= 2 * k), k)


def segment_top(transactions: DataFrame, customers: DataFrame, n: int = 100) -> DataFrame:
    """age_group, article_id, n, rank; customers outside the age bins have no segment."""
    groups = customers.select("customer_id", age_group(F.col("age")).alias("age_group")).where("age_group is not null")
    counts = transactions.join(groups, "customer_id").groupBy("age_group", "article_id").agg(F.count("*").alias("n"))
    return top_k(counts, ["age_group"], [F.desc("n"), F.col("article_id")], n)


def age_segmented(users: DataFrame, customers: DataFrame, segments: DataFrame, top: DataFrame, k: int = 12) -> DataFrame:
    """The list of the user's segment, or the global one for users without a segment that has sales."""
    lists = segments.where(F.col("rank") <= k).select("age_group", "rank", "article_id").unionByName(top.where(F.col("rank") <= k).select(F.lit("").alias("age_group"), "rank", "article_id"))
    known = segments.select("age_group").distinct().withColumn("known", F.lit(True))
    grouped = users.select("customer_id").join(customers.select("customer_id", age_group(F.col("age")).alias("age_group")), "customer_id", "left").join(F.broadcast(known), "age_group", "left")
    return grouped.withColumn("age_group", F.when(F.col("known"), F.col("age_group")).otherwise("")).join(F.broadcast(lists), "age_group").select("customer_id", "rank", "article_id")
