"""Candidates and features as of many days, from one pass over the history.

The history becomes a table of (customer, article, day) with row counts and price sums, written once and dealt by customer. Running sums by key and
day come from it; a day's state of a key is its row with t_dat < day <= the key's next day, so each wanted day costs a filter and no join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import top_k
from ..sources.scratch import written
from .features import COMPACT, SOURCE_RANK, derived


def days_table(history: DataFrame) -> DataFrame:
    """customer_id, article_id, t_dat, n, price (a sum), first (whether it is the pair's first day)."""
    days = history.groupBy("customer_id", "article_id", "t_dat").agg(F.count("*").alias("n"), F.sum("price").alias("price"))
    pair = Window.partitionBy("customer_id", "article_id").orderBy("t_dat")
    return written(days.repartition("customer_id").withColumn("first", F.row_number().over(pair) == 1))


def running(days: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """keys, t_dat, until (the key's next day, null for the last) and the sums up to this day. A key has a row for each of its days."""
    w = Window.partitionBy(*keys).orderBy("t_dat")
    by_day = days.groupBy(*keys, "t_dat").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    total = w.rowsBetween(Window.unboundedPreceding, 0)
    return by_day.select(*keys, "t_dat", F.lead("t_dat").over(w).alias("until"), *(F.sum(k).over(total).alias(k) for k in sums))


def as_of(rows: DataFrame, at: Sequence[dt.date]) -> DataFrame:
    """rows (of running) with t: each key's state before each of the days at; keys without a row before a day have none for it."""
    days = F.filter(F.array(*map(F.lit, at)).cast("array<date>"), lambda d: (d > F.col("t_dat")) & (F.col("until").isNull() | (d <= F.col("until"))))
    return rows.select("*", F.explode(days).alias("t")).drop("until").withColumnRenamed("t_dat", "last")


def label_days(days: DataFrame, test_start: dt.date, n_weeks: int) -> list[tuple[dt.date, dt.date]]:
    """(first day, first day with sales) of the weeks before test_start that have sales, the latest first: one small aggregate for all weeks."""
    back = F.floor(F.datediff(F.lit(test_start - dt.timedelta(days=8)), "t_dat") / 7).cast("int")
    weeks = days.select("t_dat", back.alias("week")).where(F.col("week").between(0, n_weeks - 1)).groupBy("week").agg(F.min("t_dat").alias("t")).orderBy("week").collect()  # n_weeks rows
    return [(test_start - dt.timedelta(days=7 * (r["week"] + 2)), r["t"]) for r in weeks]


def popular(articles: DataFrame, at: Sequence[dt.date], window: int, limit: int, source: str) -> DataFrame:
    """t, article_id, source, cand_rank: the best sellers of the days before each t; differences of running sums."""
    shift = {t - dt.timedelta(days=window): t for t in at}
    now = as_of(articles, at).select("t", "article_id", "n")
    then = as_of(articles, list(shift)).select("article_id", F.date_add("t", window).alias("t"), F.col("n").alias("before"))
    sold = now.join(then, ["t", "article_id"], "left").withColumn("n", F.col("n") - F.coalesce("before", F.lit(0))).where("n > 0")
    return top_k(sold, ["t"], [F.desc("n"), F.col("article_id")], limit, "cand_rank").select("t", "article_id", F.lit(source).alias("source"), "cand_rank")


def recent_own(days: DataFrame, users: DataFrame, n: int = 5) -> DataFrame:
    """t, customer_id, article_id, cand_rank: the articles among each user's last n rows before t, by the first of their ranks."""
    rows = days.select("customer_id", "article_id", "t_dat", "n").join(users, "customer_id").where("t_dat < t")
    newest = top_k(rows, ["customer_id", "t"], [F.desc("t_dat"), F.col("article_id")], n, "_at")  # each has a row or more
    w = Window.partitionBy("customer_id", "t").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = newest.withColumn("rank", F.sum("n").over(w) - F.col("n") + 1).where(F.col("rank") <= n)
    return ranked.groupBy("t", "customer_id", "article_id").agg(F.min("rank").cast("int").alias("cand_rank"))


class History:
    """The state of a history at the days `at`, for users(customer_id, t)."""

    def __init__(self, days: DataFrame, at: Sequence[dt.date]):
        self.days, self.at = days, list(at)
        self.articles = written(running(days, ["article_id"], {"n": F.col("n"), "price": F.col("price")}))

    def candidates(self, users: DataFrame, limit: int = 100) -> DataFrame:
        """t, customer_id, article_id, source, cand_rank: pop_7d, pop_14d and recent_user; the first source of an article names it."""
        a, b = (popular(self.articles, self.at, d, limit, f"pop_{d}d") for d in (7, 14))
        lists = written(a.unionByName(b.join(a.select("t", "article_id"), ["t", "article_id"], "left_anti")))  # 2 * limit rows a day at most
        own = recent_own(self.days, users).join(F.broadcast(lists.select("t", "article_id")), ["t", "article_id"], "left_anti").withColumn("source", F.lit("recent_user"))
        return users.join(F.broadcast(lists), "t").unionByName(own)

    def features(self, candidates: DataFrame, users: DataFrame) -> DataFrame:
        """candidates with the compact features at their day; unknown is 0."""
        own = self.days.join(users.select("customer_id").distinct(), "customer_id", "left_semi")
        user = as_of(running(own, ["customer_id"], {"u_tx": F.col("n"), "u_unique": F.col("first").cast("int"), "u_price": F.col("price")}), self.at)
        user = user.select("t", "customer_id", "u_tx", "u_unique", (F.col("u_price") / F.col("u_tx")).alias("u_avg_price"), F.datediff("t", "last").alias("u_recency"))
        pair = as_of(running(own, ["customer_id", "article_id"], {"ui_cnt": F.col("n")}), self.at).select("t", "customer_id", "article_id", "ui_cnt")
        item = as_of(self.articles, self.at).select("t", "article_id", F.col("n").alias("i_tx"), (F.col("price") / F.col("n")).alias("i_avg_price"), F.datediff("t", "last").alias("i_recency"))
        x = candidates.join(user, ["t", "customer_id"], "left").join(pair, ["t", "customer_id", "article_id"], "left").join(item, ["t", "article_id"], "left")
        return x.withColumns(derived()).select(*candidates.columns, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in COMPACT))


def training_frame(history: DataFrame, test_start: dt.date, n_weeks: int = 2) -> DataFrame:
    """customer_id, article_id, source, cand_rank, label, the compact features and label_week: the candidates of each label week's users.

    Whatever the number of weeks, the history is read once.
    """
    days = days_table(history)
    weeks = label_days(days, test_start, n_weeks)
    h = History(days, [t for _, t in weeks])
    week = F.lit(None).cast("date")
    for start, _ in weeks:
        week = F.when(F.col("t_dat").between(F.lit(start), F.lit(start + dt.timedelta(days=6))), F.lit(start)).otherwise(week)
    of = F.lit(None).cast("date")
    for start, t in weeks:
        of = F.when(F.col("label_week") == F.lit(start), F.lit(t)).otherwise(of)
    truth = written(days.select("customer_id", "article_id", week.alias("label_week")).where("label_week is not null").distinct().withColumn("t", of))
    users = truth.select("customer_id", "t", "label_week").distinct()
    rows = h.candidates(users.select("customer_id", "t"))
    frame = h.features(rows, users)
    marks = truth.select("t", "customer_id", "article_id", F.lit(1).alias("label"))
    labelled = frame.join(marks, ["t", "customer_id", "article_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    back = F.lit(None).cast("date")
    for start, t in weeks:
        back = F.when(F.col("t") == F.lit(t), F.lit(start)).otherwise(back)
    return labelled.select("customer_id", "article_id", "source", "cand_rank", "label", *COMPACT, back.alias("label_week"))
