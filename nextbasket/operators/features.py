"""Point-in-time features: history holds t_dat < t alone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import median, running
from ..functions.ranks import age_group, top_k
from .popularity import segment_top

# The names of the compact features, in order.
COMPACT = ("u_tx", "u_unique", "u_avg_price", "u_recency", "i_tx", "i_avg_price", "i_recency", "ui_cnt", "pop_bias", "recency_bias", "user_activity", "price_gap", "source_rank")
# The number of each source.
SOURCE_RANK = {"pop_14d": 1, "pop_7d": 2, "recent_user": 3}
# What an unknown feature becomes; "median" is fitted.
IMPUTE = {
    "n_tx": 0, "n_unique_articles": 0, "n_unique_categories": 0, "tx_14d": 0, "tx_30d": 0, "purchase_count": 0, "category_purchases": 0, "pop_1w": 0, "pop_2w": 0, "pop_4w": 0, "pop_all": 0,
    "days_since_last": 9999, "days_since": 9999, "online_ratio": 0.5, "age": "median", "colour_code": -1, "product_type_code": -1, "section_code": -1, "candidate_source": 0,
}


def user_stats(history: DataFrame, t: dt.date) -> DataFrame:
    return history.groupBy("customer_id").agg(F.count("*").alias("u_tx"), F.countDistinct("article_id").alias("u_unique"), F.avg("price").alias("u_avg_price"), F.datediff(F.lit(t), F.max("t_dat")).alias("u_recency"))


def item_stats(history: DataFrame, t: dt.date) -> DataFrame:
    return history.groupBy("article_id").agg(F.count("*").alias("i_tx"), F.avg("price").alias("i_avg_price"), F.datediff(F.lit(t), F.max("t_dat")).alias("i_recency"))


def user_item_count(history: DataFrame) -> DataFrame:
    return history.groupBy("customer_id", "article_id").agg(F.count("*").alias("ui_cnt"))


def derived() -> dict[str, Column]:
    """Those of the compact features that come from the others and from the candidate's source."""
    rank = F.lit(0)
    for source, r in SOURCE_RANK.items():
        rank = F.when(F.col("source") == source, r).otherwise(rank)
    return {
        "pop_bias": F.log1p(F.coalesce("i_tx", F.lit(0))), "recency_bias": 1 / (1 + F.coalesce("i_recency", F.lit(999))), "user_activity": F.log1p(F.coalesce("u_tx", F.lit(0))),
        "price_gap": F.abs(F.col("u_avg_price") - F.col("i_avg_price")), "source_rank": rank,
    }


def compact(history: DataFrame, candidates: DataFrame, t: dt.date, users: DataFrame | None = None) -> DataFrame:
    """candidates with the 13 compact features; unknown is 0. Statistics of users are made for the candidates' users alone; where these are known, they need not be taken from the candidates."""
    own = history.join((candidates if users is None else users).select("customer_id").distinct(), "customer_id", "left_semi")
    x = candidates.join(user_stats(own, t), "customer_id", "left").join(user_item_count(own), ["customer_id", "article_id"], "left").join(item_stats(history, t), "article_id", "left")
    x = x.withColumns(derived())
    return x.select(*candidates.columns, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in COMPACT))


def user_features_full(history: DataFrame, customers: DataFrame, articles: DataFrame, t: dt.date) -> DataFrame:
    since = lambda days: F.sum((F.col("t_dat") >= F.lit(t - dt.timedelta(days=days))).cast("int"))
    named = history.join(articles.select("article_id", "product_group_name"), "article_id", "left")
    stats = history.groupBy("customer_id").agg(
        F.count("*").alias("n_tx"), F.datediff(F.lit(t), F.max("t_dat")).alias("days_since_last"), F.avg("price").alias("avg_price"), F.stddev_samp("price").alias("price_std"),
        since(14).alias("tx_14d"), since(30).alias("tx_30d"), F.avg((F.col("sales_channel_id") == 2).cast("double")).alias("online_ratio"),
        (F.count("*") / F.greatest(F.lit(1.0), F.datediff(F.lit(t), F.min("t_dat")) / 7)).alias("avg_tx_per_week"),
    )
    again = user_item_count(history).groupBy("customer_id").agg(F.count("article_id").alias("n_unique_articles"), F.avg((F.col("ui_cnt") > 1).cast("double")).alias("repurchase_rate"))
    groups = named.groupBy("customer_id", "product_group_name").agg(F.lit(1).alias("one")).groupBy("customer_id").agg(F.count("product_group_name").alias("n_unique_categories"))
    known = customers.select("customer_id", "age", F.coalesce((F.col("club_member_status") == "ACTIVE").cast("int"), F.lit(0)).alias("is_member"))
    return stats.join(again, "customer_id").join(groups, "customer_id").join(known, "customer_id", "left")


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """column, out: codes from 0 in order of the values of a dimension column (few)."""
    return top_k(df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("one", F.lit(1)), ["one"], [F.col(column)], None, "code").select(column, (F.col("code") - 1).cast("int").alias(out))


def article_features_full(history: DataFrame, articles: DataFrame, t: dt.date) -> DataFrame:
    weeks = lambda w: F.sum((F.col("t_dat") >= F.lit(t - dt.timedelta(weeks=w))).cast("int"))
    sold = history.groupBy("article_id").agg(*(weeks(w).alias(f"pop_{w}w") for w in (1, 2, 4)), F.count("*").alias("pop_all"), F.avg("price").alias("avg_price"))
    x = articles.select("article_id", "product_group_name", "colour_group_name", "product_type_name", "section_no").join(sold, "article_id", "left")
    x = x.withColumns({f"pop_{w}": F.coalesce(f"pop_{w}", F.lit(0)) for w in ("1w", "2w", "4w", "all")})
    group = x.groupBy("product_group_name").agg(F.sum("pop_2w").alias("category_pop_2w"))
    for column, out in (("colour_group_name", "colour_code"), ("product_type_name", "product_type_code"), ("section_no", "section_code")):
        x = x.join(label_encode(articles, column, out), column, "left")
    x = x.join(group, "product_group_name", "left").withColumn("trend", F.col("pop_1w") / (F.col("pop_4w") / 4 + 1))
    return x.select("article_id", "pop_1w", "pop_2w", "pop_4w", "pop_all", "avg_price", "trend", "category_pop_2w", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("colour_code", "product_type_code", "section_code")))


def interaction_features_full(history: DataFrame, candidates: DataFrame, articles: DataFrame, t: dt.date, codes: dict[str, int], own: DataFrame | None = None) -> DataFrame:
    """candidates with the features of their pair; codes: the number of each source; own: rows of history that hold all of the candidates' customers, if they are at hand."""
    own = (history.join(candidates.select("customer_id").distinct(), "customer_id", "left_semi") if own is None else own).join(articles.select("article_id", "product_code", "product_group_name"), "article_id")
    pair = own.groupBy("customer_id", "article_id").agg(F.count("*").alias("purchase_count"), F.max("t_dat").alias("last"))
    code = own.groupBy("customer_id", "product_code").agg(F.countDistinct("article_id").alias("code_articles"))
    group = own.groupBy("customer_id", "product_group_name").agg(F.count("*").alias("category_purchases"))
    mean = own.groupBy("customer_id").agg(F.avg("price").alias("own_price"))
    price = history.groupBy("article_id").agg(F.avg("price").alias("item_price"))
    x = candidates.join(articles.select("article_id", "product_code", "product_group_name"), "article_id", "left").join(pair, ["customer_id", "article_id"], "left")
    x = x.join(code, ["customer_id", "product_code"], "left").join(group, ["customer_id", "product_group_name"], "left").join(mean, "customer_id", "left").join(price, "article_id", "left")
    n, days = F.coalesce("purchase_count", F.lit(0)), F.datediff(F.lit(t), F.col("last"))
    number = F.lit(0)
    for source, c in codes.items():
        number = F.when(F.col("source") == source, c).otherwise(number)
    return x.select(
        "customer_id", "article_id", (n > 0).cast("int").alias("has_purchased"), n.alias("purchase_count"), F.coalesce(days, F.lit(9999)).alias("days_since"), F.coalesce(F.exp(-days / 30), F.lit(0.0)).alias("recency_score"),
        (F.coalesce("code_articles", F.lit(0)) > (n > 0).cast("int")).cast("int").alias("same_product_code"), F.coalesce("category_purchases", F.lit(0)).alias("category_purchases"), F.abs(F.col("own_price") - F.col("item_price")).alias("price_affinity"), number.alias("candidate_source"),
    )


def popularity_ranks(window: DataFrame, customers: DataFrame) -> DataFrame:
    """age_group ('all' for everyone), article_id, n, place by sales. No task sorts all articles of a group."""
    counts = window.groupBy("article_id").agg(F.count("*").alias("n")).withColumn("age_group", F.lit("all"))
    every = counts.select("age_group", "article_id", "n").unionByName(segment_top(window, customers, None).select("age_group", "article_id", "n"))
    placed = running(every.withColumn("less", -F.col("n")), ["age_group"], ["less", "article_id"], F.lit(1), "place")
    return placed.select("age_group", "article_id", "n", F.col("place").cast("int").alias("place"))


def impute(df: DataFrame, rules: dict[str, float | str] | None = None, medians: dict[str, float] | None = None) -> DataFrame:
    """Nulls to the rules' values; a "median" that is not given is the frame's exact one."""
    rules = {c: v for c, v in (IMPUTE if rules is None else rules).items() if c in df.columns}
    fit = [c for c, v in rules.items() if v == "median" and c not in (medians or {})]
    fitted = (medians or {}) | {c: median(df, c) for c in fit}
    values = {c: fitted[c] if v == "median" else v for c, v in rules.items()}
    return df.fillna({c: v for c, v in values.items() if v is not None})


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ("customer_id", "article_id", "label", "label_week")) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def validate(df: DataFrame, columns: list[str], raise_on_missing: bool = True) -> DataFrame:
    """feature, nulls: one pass. Missing columns raise, or are left out."""
    missing = [c for c in columns if c not in df.columns]
    if missing and raise_on_missing:
        raise ValueError(f"missing features: {missing}")
    use = [c for c in columns if c in df.columns]
    return df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in use)).unpivot([], use, "feature", "nulls")


def build_imputed(df: DataFrame, columns: list[str], rules: dict[str, float | str] | None = None) -> DataFrame:
    """Absent columns become their rule's default (0 without a rule, null for a median), then nulls are imputed."""
    rules = IMPUTE if rules is None else rules
    default = lambda c: F.lit(None).cast("double") if rules.get(c) == "median" else F.lit(rules.get(c, 0))
    return impute(df.withColumns({c: default(c) for c in columns if c not in df.columns}), rules)
