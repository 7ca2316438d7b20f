"""Candidate sources, their union, selection, negatives and recall. Every source looks at t_dat < t alone.

Rows are (customer_id, article_id, source, cand_rank).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import age_group, top_k
from .popularity import same_for_all, segment_top, top_popular
from .prep import between

# Source order, weights and (in quotas) shares.
PRIORITY = {"repurchase_short": 6, "repurchase_long": 5, "product_code_repurchase": 4, "category_popular": 3, "popular_segment": 2, "popular_global": 1}
HARDNESS = {
    "repurchase_short": 1.0, "repurchase_long": 0.9, "co_occurrence": 0.85, "category_personal": 0.8, "product_code_repurchase": 0.75, "popular_decay": 0.5, "popular_1w": 0.45, "popular_2w": 0.4, "popular_4w": 0.35, "popular_30d": 0.3, "popular_global": 0.1,
}


def quotas(n: int) -> dict[str, int]:
    return {"repurchase_short": min(50, n // 4), "repurchase_long": min(30, n // 6), "product_code_repurchase": min(20, n // 8), "popular_global": min(40, n // 4), "popular_segment": min(20, n // 8), "category_popular": min(20, n // 8)}


def window_before(transactions: DataFrame, t: dt.date, days: int) -> DataFrame:
    return between(transactions, t - dt.timedelta(days=days), t)


def labelled(df: DataFrame, source: str) -> DataFrame:
    return df.select("customer_id", "article_id", F.lit(source).alias("source"), F.col("rank").alias("cand_rank"))


def popular(transactions: DataFrame, users: DataFrame, t: dt.date, days: int, source: str, limit: int = 100) -> DataFrame:
    return labelled(same_for_all(users, top_popular(window_before(transactions, t, days), limit), limit), source)


def recent_user(transactions: DataFrame, users: DataFrame | None, t: dt.date, n: int = 5) -> DataFrame:
    """The last n rows of each user, as distinct articles; of all users if none are given."""
    rows = between(transactions, None, t)
    if users is not None:
        rows = rows.join(users.select("customer_id"), "customer_id", "left_semi")
    last = top_k(rows.select("customer_id", "article_id", "t_dat"), ["customer_id"], [F.desc("t_dat"), F.col("article_id")], n)
    return labelled(last.groupBy("customer_id", "article_id").agg(F.min("rank").alias("rank")), "recent_user")


def compact(transactions: DataFrame, users: DataFrame, t: dt.date, limit: int = 100) -> DataFrame:
    """pop_7d, pop_14d, recent_user; the first source of an article names it. The lists are merged before users are joined, so nothing large is deduplicated."""
    a, b = (top_popular(window_before(transactions, t, d), limit).select("article_id", F.col("rank").alias("cand_rank"), F.lit(s).alias("source")) for d, s in ((7, "pop_7d"), (14, "pop_14d")))
    lists = a.unionByName(b.join(F.broadcast(a.select("article_id")), "article_id", "left_anti"))
    own = recent_user(transactions, users, t).join(F.broadcast(lists.select("article_id")), "article_id", "left_anti")
    return users.select("customer_id").crossJoin(F.broadcast(lists)).unionByName(own)


def bought(transactions: DataFrame, users: DataFrame, t: dt.date, days: int) -> DataFrame:
    """Each user's articles of the window, with last day and count."""
    rows = window_before(transactions, t, days).join(users.select("customer_id"), "customer_id", "left_semi")
    return rows.groupBy("customer_id", "article_id").agg(F.max("t_dat").alias("last"), F.count("*").alias("n"))


def repurchase_window(transactions: DataFrame, users: DataFrame, t: dt.date, days: int, source: str, limit: int | None) -> DataFrame:
    return labelled(top_k(bought(transactions, users, t, days), ["customer_id"], [F.desc("last"), F.col("article_id")], limit), source)


def same_product_code(transactions: DataFrame, articles: DataFrame, users: DataFrame, t: dt.date, days: int = 60, limit: int = 30) -> DataFrame:
    """Other articles of the codes that the user bought, by popularity in the window."""
    own, codes = bought(transactions, users, t, days), articles.select("article_id", "product_code")
    counts = window_before(transactions, t, days).groupBy("article_id").agg(F.count("*").alias("sold"))
    liked = own.join(codes, "article_id").select("customer_id", "product_code").distinct()
    others = liked.join(codes, "product_code").join(own, ["customer_id", "article_id"], "left_anti").join(counts, "article_id", "left")
    return labelled(top_k(others, ["customer_id"], [F.desc(F.coalesce("sold", F.lit(0))), F.col("article_id")], limit), "product_code_repurchase")


def popular_segment(transactions: DataFrame, customers: DataFrame, users: DataFrame, t: dt.date, days: int = 14, limit: int = 30) -> DataFrame:
    top = segment_top(window_before(transactions, t, days), customers, limit).select("age_group", "article_id", "rank")
    grouped = users.select("customer_id").join(customers.select("customer_id", age_group(F.col("age")).alias("age_group")), "customer_id")
    return labelled(grouped.join(top, "age_group"), "popular_segment")


def category_popular(transactions: DataFrame, articles: DataFrame, users: DataFrame, t: dt.date, days: int = 14, favourites: int = 3, limit: int = 20, own: DataFrame | None = None) -> DataFrame:
    """The best sellers of the user's favourite product groups (those with the most purchases before t). own: transactions that hold all of the users', if not the first ones."""
    groups = articles.select("article_id", "product_group_name")
    own = between(transactions if own is None else own, None, t).join(users.select("customer_id"), "customer_id", "left_semi").join(groups, "article_id").groupBy("customer_id", "product_group_name").agg(F.count("*").alias("n"))
    liked = top_k(own, ["customer_id"], [F.desc("n"), F.col("product_group_name")], favourites).select("customer_id", "product_group_name")
    sold = window_before(transactions, t, days).join(groups, "article_id").groupBy("product_group_name", "article_id").agg(F.count("*").alias("sold"))
    best = top_k(sold, ["product_group_name"], [F.desc("sold"), F.col("article_id")], limit, "place")
    return labelled(top_k(liked.join(best, "product_group_name"), ["customer_id"], [F.desc("sold"), F.col("article_id")], limit), "category_popular")


def full(transactions: DataFrame, customers: DataFrame, articles: DataFrame, users: DataFrame, t: dt.date, obsolete: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """All six sources; an article keeps its source of the highest priority; obsolete articles are dropped.

    Where own, all rows of the users, is given, transactions need to hold the 60 days before t alone.
    """
    mine = transactions if own is None else own
    parts = [
        repurchase_window(mine, users, t, 14, "repurchase_short", None), repurchase_window(mine, users, t, 60, "repurchase_long", 50), same_product_code(transactions, articles, users, t),
        popular(transactions, users, t, 14, "popular_global"), popular_segment(transactions, customers, users, t), category_popular(transactions, articles, users, t, own=mine),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    if obsolete is not None:
        every = every.join(obsolete.select("article_id"), "article_id", "left_anti")
    return top_k(every, ["customer_id", "article_id"], [F.desc(weight("source", PRIORITY))], 1, "pick").select("customer_id", "article_id", "source", "cand_rank")


def weight(column: str, of: dict[str, float], other: float = 0):
    out = F.lit(other)
    for name, value in of.items():
        out = F.when(F.col(column) == name, value).otherwise(out)
    return out


def stratified(candidates: DataFrame, n: int, quota: dict[str, int] | None = None) -> DataFrame:
    """First the quota of each source in the order of the quotas, then the others by priority, n in all. Input unique on (customer, article)."""
    quota = quotas(n) if quota is None else quota
    place = F.row_number().over(Window.partitionBy("customer_id", "source").orderBy("cand_rank", "article_id"))
    within = candidates.withColumn("place", place).withColumn("first", F.col("place") <= weight("source", quota))
    turn = weight("source", {s: i for i, s in enumerate(quota)}, len(quota))
    order = [F.desc("first"), F.when(F.col("first"), turn).otherwise(-weight("source", PRIORITY)), F.col("cand_rank"), F.col("source"), F.col("article_id")]
    return top_k(within, ["customer_id"], order, n).select("customer_id", "rank", "article_id", "source")


def candidate_labels(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    marks = truth.select("customer_id", "article_id").distinct().withColumn("label", F.lit(1))
    return candidates.join(marks, ["customer_id", "article_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def hard_negatives(candidates: DataFrame, pos_multiplier: int = 50, floor: int = 30) -> DataFrame:
    """All positives; of the negatives the hardest max(floor, positives * pos_multiplier) of each user."""
    positives = F.sum("label").over(Window.partitionBy("customer_id"))
    place = F.row_number().over(Window.partitionBy("customer_id", "label").orderBy(F.desc(weight("source", HARDNESS, 0.1)), "cand_rank", "article_id"))
    kept = candidates.withColumn("positives", positives).withColumn("place", place)
    return kept.where((F.col("label") == 1) | (F.col("place") <= F.greatest(F.lit(floor), F.col("positives") * pos_multiplier))).drop("positives", "place")


def trending_by_category(recent: DataFrame, articles: DataFrame, per_group: int = 5, n: int = 50) -> DataFrame:
    """The best of each product group, groups in alphabetical order, n in all; rank from 1."""
    counts = recent.join(articles.select("article_id", "product_group_name"), "article_id").groupBy("product_group_name", "article_id").agg(F.count("*").alias("n"))
    best = top_k(counts, ["product_group_name"], [F.desc("n"), F.col("article_id")], per_group, "place").orderBy("product_group_name", "place").limit(n)
    return top_k(best.withColumn("one", F.lit(1)), ["one"], [F.col("product_group_name"), F.col("place")], None).select("rank", "product_group_name", "article_id")


def cold_start(users: DataFrame, customers: DataFrame, articles: DataFrame, recent: DataFrame, n: int = 200) -> DataFrame:
    """Age list[:50], category list[:30] and global list[:30] taken in turns; the first occurrence wins. One list for each segment, joined to the users."""
    top = top_popular(recent, 50).select("article_id", "rank")
    segments = segment_top(recent, customers, 50).select("age_group", "article_id", "rank")
    names = segments.select("age_group").distinct().unionByName(recent.sparkSession.createDataFrame([("",)], "age_group string"))
    common = trending_by_category(recent, articles).where("rank <= 30").select("article_id", "rank", F.lit(1).alias("turn")).unionByName(top.where("rank <= 30").withColumn("turn", F.lit(2)))
    lists = segments.withColumn("turn", F.lit(0)).unionByName(top.select(F.lit("").alias("age_group"), "article_id", "rank", F.lit(0).alias("turn"))).unionByName(names.crossJoin(common))
    first = lists.groupBy("age_group", "article_id").agg(F.min(3 * (F.col("rank") - 1) + F.col("turn")).alias("at"))
    ranked = top_k(first, ["age_group"], [F.col("at")], n)
    source = F.element_at(F.array(*map(F.lit, ("cold_start_age", "cold_start_category", "cold_start_global"))), F.col("at") % 3 + 1)
    grouped = users.select("customer_id").join(customers.select("customer_id", age_group(F.col("age")).alias("age_group")), "customer_id", "left")
    grouped = grouped.join(names.withColumn("known", F.lit(True)), "age_group", "left").select("customer_id", F.when(F.col("known"), F.col("age_group")).otherwise("").alias("age_group"))
    return grouped.join(ranked, "age_group").select("customer_id", "rank", "article_id", source.alias("source"))


def candidate_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """source (null: all), users, candidates, recall: over all the mean of the users' recalls and its median; by source hits over the truth of the users that have it."""
    sizes = truth.groupBy("customer_id").agg(F.count("*").alias("size"))
    hits = candidates.join(truth.select("customer_id", "article_id", F.lit(1).alias("hit")), ["customer_id", "article_id"], "left")
    per_user = sizes.join(hits.groupBy("customer_id").agg(F.countDistinct(F.when(F.col("hit") == 1, F.col("article_id"))).alias("hits"), F.count("*").alias("n")), "customer_id", "left").select("n", (F.coalesce("hits", F.lit(0)) / F.col("size")).alias("recall"))
    whole = per_user.agg(F.lit("all").alias("source"), F.count("*").alias("users"), F.sum(F.coalesce("n", F.lit(0))).alias("candidates"), F.avg("recall").alias("recall"), F.median("recall").alias("median_recall"))
    by = hits.groupBy("source", "customer_id").agg(F.count("hit").alias("hits"), F.count("*").alias("n")).join(sizes, "customer_id").groupBy("source").agg(F.count("*").alias("users"), F.sum("n").alias("candidates"), (F.sum("hits") / F.sum("size")).alias("recall")).withColumn("median_recall", F.lit(None).cast("double"))
    return whole.unionByName(by)
