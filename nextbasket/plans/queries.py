"""Every operator applied to the whole tables, by key, with its SQL. Doubles are rounded to 6 digits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import age_group
from ..operators import analytics as E
from ..operators import asof as A
from ..operators import candidates as C
from ..operators import features as X
from ..operators import itemcf as I
from ..operators import metrics as M
from ..operators import popularity as P
from ..operators import prep as S
from ..operators import ranker as L
from ..sources import tables as T
from ..sources.scratch import shared_folder, written
from . import sql as Q

TRAIN_START, CUTOFF = dt.date.fromisoformat(Q.TRAIN_START), dt.date.fromisoformat(Q.CUTOFF)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


@dataclass
class Context:
    """The tables and the canonical split, made when first used."""

    spark: SparkSession
    path: str

    store: bool = False  # the transactions are written once, for queries that go over them many times; else each part joins orders and lines anew

    def __post_init__(self) -> None:
        t = T.load_tables(self.spark, self.path)
        self.tx, self.customers, self.articles = written(t.transactions) if self.store else t.transactions, t.customers, t.articles
        self.b = S.bounds(self.tx, TRAIN_START)
        parts = S.canonical_split(self.tx, self.b)
        self.train, self.test, self.val, self.train_feat = parts["train"], parts["test"], parts["val"], parts["train_feat"]
        self.t = self.b.test_start
        self.truth = S.ground_truth(self.test)
        self.users = self.truth.select("customer_id").distinct()
        self.newest = self.b.test_start - dt.timedelta(days=1)

    @property
    def train_newest(self) -> dt.date:
        return self.train.agg(F.max("t_dat")).first()[0]  # one row

    def past(self) -> DataFrame:
        return S.between(self.tx, None, self.t)

    def recent(self) -> DataFrame:
        return P.recent(self.train, self.train_newest, 2)

    def obsolete(self) -> DataFrame:
        return S.obsolete_articles(self.tx, CUTOFF)

    def repurchase(self) -> DataFrame:
        return P.repurchase(self.train, self.users, P.top_popular(self.recent(), 100))

    def models(self) -> dict[str, DataFrame]:
        top = P.top_popular(self.train, 100)
        return {
            "age_segmented": P.age_segmented(self.users, self.customers, P.segment_top(self.train, self.customers), top), "global": P.same_for_all(self.users, top),
            "recent": P.same_for_all(self.users, P.top_popular(self.recent(), 100)), "repurchase": self.repurchase(),
        }

    def all_models(self) -> DataFrame:
        out = None
        for name, p in self.models().items():
            p = p.select(F.lit(name).alias("model"), "customer_id", "rank", "article_id")
            out = p if out is None else out.unionByName(p)
        return out

    def scores(self) -> DataFrame:
        return M.map_at_k(self.all_models(), self.truth, by=("model",))

    def compared(self) -> DataFrame:
        """The baselines and item CF."""
        return self.scores().unionByName(M.map_at_k(self.item_cf(), self.truth).withColumn("model", F.lit("item_cf")))

    def shares(self) -> DataFrame:
        return E.monthly_category_share(self.tx, self.articles)

    def cf(self) -> tuple[DataFrame, DataFrame]:
        rows = I.recent_supported(self.train, self.train_newest, 104, 5)
        return rows, written(I.interactions(rows))

    def users_near(self, pairs: DataFrame) -> DataFrame:
        """The neighbours of the items that the users of the test week have: no others count for them."""
        own = pairs.join(self.users, "customer_id", "left_semi").select("article_id").distinct()
        return I.item_neighbours(I.item_similarity(pairs, of=own))

    def item_cf(self) -> DataFrame:
        rows, pairs = self.cf()
        return I.item_cf(rows, pairs, self.users_near(pairs), self.users)

    def compact(self) -> DataFrame:
        return C.compact(self.past(), self.users, self.t)

    def compact_features(self) -> DataFrame:
        return X.compact(self.past(), self.compact(), self.t, self.users)

    def full(self) -> DataFrame:
        """Written once: the queries over it use it in many places."""
        return written(C.full(self.past(), self.customers, self.articles, self.users, self.t, self.obsolete()))

    def own(self) -> DataFrame:
        return self.past().join(self.users, "customer_id", "left_semi")

    def ap(self) -> DataFrame:
        return M.ap_at_k(self.repurchase(), self.truth)

    def frame(self, n_weeks: int = 2) -> DataFrame:
        return A.training_frame(self.train, self.b.test_start, n_weeks)

    def two_stage(self, n_weeks: int = 2, settings: L.B.Settings | None = None) -> tuple[DataFrame, L.B.Forest, DataFrame]:
        """Fitted on the whole frame, without a choice of negatives."""
        frame = written(self.frame(n_weeks))
        model = L.fit(frame, settings=settings)
        return L.score(model, self.compact_features()), model, frame


def two_stage_full(c: Context) -> DataFrame:
    """The whole model: six candidate sources, all features, listwise trees; twelve articles for each customer of the test week."""
    frame = written(L.full_training_frame(c.train, c.customers, c.articles, c.b.test_start, 2, c.obsolete()))
    return L.best(L.score(L.fit(frame, X.feature_columns(frame)), L.full_rows(c.tx, c.customers, c.articles, c.users, c.t, c.obsolete())))


def linear(c: Context) -> DataFrame:
    x = rounded(X.compact(c.past(), c.compact(), c.t))
    return L.best(x.withColumn("score", F.round(F.col("ui_cnt") + F.col("pop_bias") + F.col("recency_bias"), 6)))


def cf_scores(c: Context) -> DataFrame:
    pairs = c.cf()[1]
    return I.cf_scores(pairs, c.users_near(pairs), c.users)


def fused(c: Context) -> DataFrame:
    lists = [(m, p) for m, p in c.models().items() if m in ("recent", "repurchase")] + [("item_cf", c.item_cf())]
    out = None
    for name, p in lists:
        p = p.select(F.lit(name).alias("model"), "customer_id", "rank", "article_id")
        out = p if out is None else out.unionByName(p)
    return L.rrf(out, {"repurchase": 3.0, "item_cf": 2.0, "recent": 1.0})


def ensemble(c: Context) -> DataFrame:
    """The ranker, repurchase and item CF, fused; each scored."""
    parts = {"two_stage": L.best(c.two_stage()[0]), "repurchase": c.repurchase(), "item_cf": c.item_cf()}
    rows = None
    for name, p in parts.items():
        p = p.select(F.lit(name).alias("model"), "customer_id", "rank", "article_id")
        rows = p if rows is None else rows.unionByName(p)
    rows = written(rows)  # every list is used for itself and for the fusion
    rows = rows.unionByName(L.rrf(rows, {"two_stage": 3.0, "repurchase": 2.0, "item_cf": 1.0}).select(F.lit("fusion").alias("model"), "customer_id", "rank", "article_id"))
    return M.map_at_k(rows, c.truth, by=("model",))


def encoded(c: Context) -> DataFrame:
    return T.encode_ids(c.tx, "customer_id", "customer_id_int")


def appended(c: Context) -> DataFrame:
    """A dictionary of the customers of all but the last 60 days, then loaded again with all."""
    old = T.encode_ids(S.between(c.tx, None, c.b.newest - dt.timedelta(days=60)), "customer_id", "customer_id_int")
    return T.encode_ids(c.tx, "customer_id", "customer_id_int", written(old))


def layout(c: Context) -> T.Layout:
    customers, articles = S.clean_customers(S.reduce_memory(c.customers)), S.clean_articles(c.articles)
    return T.write_layout(S.week_index(S.reduce_memory(c.tx)), customers, articles, c.obsolete(), shared_folder(c.spark), T.buckets_for(c.tx))


def stored_splits(c: Context) -> DataFrame:
    out = None
    for name, rows in layout(c).splits().items():
        rows = rows.select(F.lit(name).alias("split"), "t_dat", "customer_id", "article_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def daily_history(c: Context) -> DataFrame:
    """The histories from a state that three days were merged into one by one."""
    days = [c.b.newest - dt.timedelta(days=k) for k in range(9, 6, -1)]  # the last of the training rows
    state = written(P.merged_history(None, S.between(c.train, None, days[0])))
    for day in days:
        state = written(P.merged_history(state, S.between(c.train, day, day + dt.timedelta(days=1))))
    return state


def profiles(c: Context) -> DataFrame:
    out = None
    for name, rows in (("articles", c.articles), ("customers", c.customers), ("transactions", c.tx)):
        one = E.profile_table(rows).drop("dtype").select(F.lit(name).alias("table"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def multi_week(c: Context) -> DataFrame:
    out = None
    for start, past, labels in S.multi_week_splits(c.train, c.b.test_start, 3):
        row = labels.groupBy(F.lit(start).alias("label_week")).agg(F.count("*").alias("labels")).crossJoin(past.agg(F.count("*").alias("history")))
        out = row if out is None else out.unionByName(row)
    return out


def ranker_splits(c: Context) -> DataFrame:
    out = None
    for name, rows in S.ranker_splits(c.tx, c.b).items():
        day = F.col("t_dat") if "t_dat" in rows.columns else F.lit(None).cast("date")
        rows = rows.select(F.lit(name).alias("part"), day.alias("t_dat"), "customer_id", "article_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def value_counts(c: Context) -> DataFrame:
    (_, of_articles), (_, of_customers) = Q.VALUE_COLUMNS
    return E.value_counts(c.articles, of_articles).unionByName(E.value_counts(c.customers, of_customers))


def imputed(c: Context) -> DataFrame:
    wide = c.users.join(X.user_features_full(c.own(), c.customers, c.articles, c.t), "customer_id", "left")
    return X.build_imputed(wide.select("customer_id", "age", "n_tx", "days_since_last", "online_ratio"), ["colour_code"])


def saved_model(c: Context) -> DataFrame:
    scored, model, _ = c.two_stage()
    again = L.save_model(model, c.spark, shared_folder(c.spark))
    return L.best(L.score(again, scored.drop("score")))


Q_HIST = Q.CTES + Q.F0
#: key: (Spark, SQL or None)
PAIRS: dict[str, tuple[Callable[[Context], DataFrame], str | None]] = {
    "load_tables": (lambda c: c.tx, f"{Q.CTES} SELECT * FROM tx"),
    "load_pruned": (lambda c: c.tx.select("t_dat", "customer_id", "article_id"), f"{Q.CTES} SELECT t_dat, customer_id, article_id FROM tx"),
    "normalise_types": (lambda c: T.normalise_types(c.tx).withColumn("price", F.round(F.col("price").cast("double"), 2)), f"{Q.CTES} SELECT t_dat, CAST(customer_id AS VARCHAR) AS customer_id, CAST(article_id AS INTEGER) AS article_id, round(CAST(CAST(price AS FLOAT) AS DOUBLE), 2) AS price, sales_channel_id FROM tx"),
    "encode_ids": (encoded, f"{Q.CTES} SELECT customer_id, CAST(row_number() OVER (ORDER BY customer_id) - 1 AS INTEGER) AS customer_id_int FROM (SELECT DISTINCT customer_id FROM tx)"),
    "encode_ids_appended": (appended, f"{Q.CTES}, {Q.APPENDED}"),
    "stored_splits": (stored_splits, f"{Q.CTES} SELECT CASE WHEN week < 1 THEN 'test' WHEN week < 2 THEN 'val' ELSE 'train' END AS split, t_dat, customer_id, article_id FROM {Q.WEEKS} WHERE week < 10"),
    "stored_obsolete": (lambda c: layout(c).obsolete, f"{Q.CTES} {Q.OBSOLETE}"),
    "stored_customers": (lambda c: layout(c).transactions.groupBy("customer_id").agg(F.count("*").alias("tx"), F.max("week").alias("oldest")), f"{Q.CTES} SELECT customer_id, count(*) AS tx, max(week) AS oldest FROM {Q.WEEKS} GROUP BY 1"),
    "write_processed": (lambda c: layout(c).transactions.groupBy("week").agg(F.count("*").alias("tx")), f"{Q.CTES} SELECT CAST(floor((mx - t_dat) / 7.0) AS INTEGER) AS week, count(*) AS tx FROM tx, b GROUP BY 1"),
    "write_results": (lambda c: T.write_results(rounded(c.scores()), shared_folder(c.spark)), f"{Q.CTES} SELECT model, round(map, 6) AS map, users FROM ({Q.SCORES})"),
    "save_model": (saved_model, None),
    "reduce_memory": (lambda c: S.reduce_memory(c.tx).withColumn("price", F.round(F.col("price").cast("double"), 2)), f"{Q.CTES} SELECT t_dat, CAST(customer_id AS INTEGER) AS customer_id, CAST(article_id AS INTEGER) AS article_id, round(CAST(CAST(price AS FLOAT) AS DOUBLE), 2) AS price, sales_channel_id FROM tx"),
    "week_index": (lambda c: S.week_index(c.tx.select("t_dat", "customer_id")), f"{Q.CTES} SELECT t_dat, customer_id, CAST(floor((mx - t_dat) / 7.0) AS INTEGER) AS week FROM tx, b"),
    "obsolete_articles": (lambda c: c.obsolete(), f"{Q.CTES} {Q.OBSOLETE}"),
    "drop_obsolete": (lambda c: S.drop_obsolete(c.articles.select("article_id"), c.obsolete()), f"{Q.CTES} SELECT article_id FROM art WHERE article_id NOT IN ({Q.OBSOLETE})"),
    "clean_customers": (lambda c: S.clean_customers(c.customers), f"{Q.CTES} SELECT customer_id, coalesce(age, (SELECT median(age) FROM cust)) AS age, coalesce(club_member_status, 'UNKNOWN') AS club_member_status, coalesce(fashion_news_frequency, 'NONE') AS fashion_news_frequency FROM cust"),
    "clean_articles": (lambda c: S.clean_articles(c.articles.select("article_id", "colour_group_name", "product_type_name")), f"{Q.CTES} SELECT article_id, coalesce(colour_group_name, 'UNKNOWN') AS colour_group_name, coalesce(product_type_name, 'UNKNOWN') AS product_type_name FROM art"),
    "week_split": (lambda c: S.week_split(c.tx).groupBy("split").agg(F.count("*").alias("tx")), f"{Q.CTES} SELECT CASE WHEN w < 1 THEN 'test' WHEN w < 2 THEN 'val' ELSE 'train' END AS split, count(*) AS tx FROM (SELECT floor((mx - t_dat) / 7.0) AS w FROM tx, b) WHERE w < 10 GROUP BY 1"),
    "canonical_split": (lambda c: c.train.select(F.lit("train").alias("split"), "t_dat", "customer_id", "article_id").unionByName(c.test.select(F.lit("test").alias("split"), "t_dat", "customer_id", "article_id")).unionByName(c.val.select(F.lit("val").alias("split"), "t_dat", "customer_id", "article_id")), f"{Q.CTES} SELECT 'train' AS split, t_dat, customer_id, article_id FROM train UNION ALL SELECT 'test', t_dat, customer_id, article_id FROM test UNION ALL SELECT 'val', t_dat, customer_id, article_id FROM train, b WHERE t_dat >= val_start"),
    "ground_truth": (lambda c: c.truth, f"{Q.CTES} SELECT * FROM truth"),
    "train_feat_split": (lambda c: c.train_feat.select("t_dat", "customer_id", "article_id"), f"{Q.CTES} SELECT t_dat, customer_id, article_id FROM train, b WHERE t_dat < val_start"),
    "ranker_splits": (lambda c: ranker_splits(c), f"{Q.CTES} SELECT 'train_full' AS part, t_dat, customer_id, article_id FROM train UNION ALL SELECT 'train_feat', t_dat, customer_id, article_id FROM train, b WHERE t_dat < val_start UNION ALL SELECT 'val', t_dat, customer_id, article_id FROM train, b WHERE t_dat >= val_start UNION ALL SELECT DISTINCT 'val_truth', CAST(NULL AS DATE), customer_id, article_id FROM train, b WHERE t_dat >= val_start UNION ALL SELECT 'test_truth', NULL, customer_id, article_id FROM truth"),
    "multi_week_splits": (multi_week, f"{Q.CTES} SELECT start AS label_week, (SELECT count(*) FROM train WHERE t_dat >= start AND t_dat < start + 7) AS labels, (SELECT count(*) FROM train WHERE t_dat < start) AS history FROM (SELECT test_start - 7 * (w + 1) AS start FROM b, (VALUES (1), (2), (3)) v(w))"),
    "sample_customers": (lambda c: S.sample_customers(c.tx, 200), f"{Q.CTES} SELECT * FROM tx WHERE customer_id IN (SELECT customer_id FROM {Q.sample('tx', 200)})"),
    "sample_eval_users": (lambda c: M.map_at_k(c.repurchase(), S.sample_customers(c.truth, 20)), f"{Q.CTES} SELECT round(avg(ap), 6) AS map, count(*) AS users FROM ({Q.ap(Q.REPURCHASE)}) WHERE customer_id IN (SELECT customer_id FROM {Q.sample('truth', 20)})"),
    "top_popular": (lambda c: P.top_popular(c.train), f"{Q.CTES} {Q.top('train', 100)}"),
    "global_popularity": (lambda c: c.models()["global"], f"{Q.CTES} {Q.GLOBAL}"),
    "recent_popularity": (lambda c: c.models()["recent"], f"{Q.CTES} {Q.RECENT_POP}"),
    "user_history": (lambda c: P.user_history(c.train), f"{Q.CTES} {Q.history(100, False)}"),
    "user_history_daily": (daily_history, f"{Q.CTES} {Q.history(100, False)}"),
    "repurchase": (lambda c: c.repurchase(), f"{Q.CTES} {Q.REPURCHASE}"),
    "age_group": (lambda c: c.customers.select("customer_id", age_group(F.col("age")).alias("age_group")), f"{Q.CTES} SELECT customer_id, age_group FROM cust"),
    "segment_top": (lambda c: P.segment_top(c.train, c.customers), f"{Q.CTES} {Q.segment('train', 100)}"),
    "age_segmented_popularity": (lambda c: c.models()["age_segmented"], f"{Q.CTES} {Q.SEGMENTED}"),
    "run_baselines": (lambda c: c.scores(), f"{Q.CTES} SELECT model, round(map, 6) AS map, users FROM ({Q.SCORES})"),
    "cf_interactions": (lambda c: c.cf()[1], f"{Q.CTES}{Q.CF} SELECT * FROM cf_pairs"),
    "item_similarity": (lambda c: I.item_similarity(c.cf()[1]), f"{Q.CTES}{Q.CF} SELECT item_i, item_j, co, round(sim, 6) AS sim FROM cf_sim"),
    "item_neighbours": (lambda c: I.item_neighbours(I.item_similarity(c.cf()[1])), f"{Q.CTES}{Q.CF} SELECT item_i, item_j, co, round(sim, 6) AS sim, rank FROM cf_near"),
    "cf_scores": (lambda c: cf_scores(c), f"{Q.CTES}{Q.CF} SELECT * FROM cf_kept"),
    "item_cf": (lambda c: c.item_cf(), f"{Q.CTES}{Q.CF} {Q.ITEM_CF}"),
    "cand_pop_7d": (lambda c: C.popular(c.past(), c.users, c.t, 7, "pop_7d"), f"{Q.CTES} {Q.POP['pop_7d']}"),
    "cand_pop_14d": (lambda c: C.popular(c.past(), c.users, c.t, 14, "pop_14d"), f"{Q.CTES} {Q.POP['pop_14d']}"),
    "cand_recent_user": (lambda c: C.recent_user(c.tx, c.users, c.t), f"{Q.CTES} {Q.RECENT_USER}"),
    "candidates_compact": (lambda c: c.compact(), f"{Q.CTES} {Q.COMPACT}"),
    "cand_repurchase_short": (lambda c: C.repurchase_window(c.tx, c.users, c.t, 14, "repurchase_short", None), f"{Q.CTES} {Q.SHORT}"),
    "cand_repurchase_long": (lambda c: C.repurchase_window(c.tx, c.users, c.t, 60, "repurchase_long", 50), f"{Q.CTES} {Q.LONG}"),
    "cand_product_code": (lambda c: C.same_product_code(c.tx, c.articles, c.users, c.t), f"{Q.CTES} {Q.CODE}"),
    "cand_popular_global": (lambda c: C.popular(c.tx, c.users, c.t, 14, "popular_global"), f"{Q.CTES} {Q.POP['popular_global']}"),
    "cand_popular_segment": (lambda c: C.popular_segment(c.tx, c.customers, c.users, c.t), f"{Q.CTES} {Q.SEGMENT}"),
    "cand_category_popular": (lambda c: C.category_popular(c.tx, c.articles, c.users, c.t), f"{Q.CTES} {Q.CATEGORY}"),
    "candidates_full": (lambda c: c.full(), f"{Q.CTES} {Q.FULL}"),
    "stratified_candidates": (lambda c: C.stratified(c.full(), 40), f"{Q.CTES}{Q.G} {Q.STRATIFIED}"),
    "hard_negatives": (lambda c: C.hard_negatives(C.candidate_labels(c.full(), c.truth)), f"{Q.CTES}{Q.G} {Q.NEGATIVES}"),
    "trending_by_category": (lambda c: C.trending_by_category(c.recent(), c.articles), f"{Q.CTES}{Q.R2} {Q.TRENDING}"),
    "cold_start": (lambda c: C.cold_start(c.users, c.customers, c.articles, c.recent()), f"{Q.CTES}{Q.COLD_CTES} {Q.COLD}"),
    "candidate_labels": (lambda c: C.candidate_labels(c.full(), c.truth), f"{Q.CTES}{Q.G} {Q.LABELS}"),
    "candidate_recall": (lambda c: C.candidate_recall(c.full(), c.truth), f"{Q.CTES}{Q.H} {Q.RECALL}"),
    "user_stats": (lambda c: X.user_stats(c.own(), c.t), f"{Q_HIST} {Q.USTATS}"),
    "item_stats": (lambda c: X.item_stats(c.past(), c.t), f"{Q_HIST} {Q.ISTATS}"),
    "user_item_count": (lambda c: X.user_item_count(c.own()), f"{Q_HIST} {Q.UI}"),
    "features_compact": (lambda c: c.compact_features(), f"{Q_HIST} {Q.feature_sql(Q.COMPACT, 'hist', Q.T0)}"),
    "user_features_full": (lambda c: X.user_features_full(c.own(), c.customers, c.articles, c.t), f"{Q_HIST} {Q.USER_FULL}"),
    "article_features_full": (lambda c: X.article_features_full(c.past(), c.articles, c.t), f"{Q_HIST} {Q.ARTICLE_FULL}"),
    "interaction_features_full": (lambda c: X.interaction_features_full(c.past(), c.full(), c.articles, c.t, C.PRIORITY), f"{Q_HIST}{Q.G}, o AS (SELECT own.*, product_code, product_group_name FROM own JOIN art USING (article_id)) {Q.INTERACTION}"),
    "popularity_ranks": (lambda c: X.popularity_ranks(C.window_before(c.tx, c.t, 14), c.customers), f"{Q.CTES} {Q.PLACES}"),
    "label_encode": (lambda c: X.label_encode(c.articles, "product_type_name", "code"), f"{Q.CTES} {Q.code_sql('product_type_name')}"),
    "impute_features": (lambda c: X.impute(c.customers.select("customer_id", "age")), f"{Q.CTES} SELECT customer_id, coalesce(age, (SELECT median(age) FROM cust)) AS age FROM cust"),
    "feature_columns": (lambda c: c.users.agg(F.count("*").alias("users")).select("users", F.explode(F.array(*map(F.lit, X.feature_columns(X.compact(c.past(), c.compact(), c.t))))).alias("feature")), f"{Q.CTES} SELECT (SELECT count(*) FROM users) AS users, feature FROM (SELECT unnest(['cand_rank', {', '.join(repr(x) for x in X.COMPACT)}]) AS feature)"),
    "validate_features": (lambda c: X.validate(c.customers, ["age", "club_member_status"]), f"{Q.CTES} SELECT 'age' AS feature, count(*) - count(age) AS nulls FROM cust UNION ALL SELECT 'club_member_status', count(*) - count(club_member_status) FROM cust"),
    "build_features_imputed": (imputed, f"""{Q_HIST}, j AS (SELECT users.customer_id, u.* EXCLUDE (customer_id) FROM users LEFT JOIN ({Q.USER_FULL}) u USING (customer_id)) SELECT customer_id, coalesce(age, (SELECT median(age) FROM j)) AS age, coalesce(n_tx, 0) AS n_tx, coalesce(days_since_last, 9999) AS days_since_last, coalesce(online_ratio, 0.5) AS online_ratio, -1 AS colour_code FROM j"""),
    "training_frame": (lambda c: c.frame(), f"{Q.CTES} {Q.FRAME}"),
    "group_sizes": (lambda c: L.group_sizes(c.frame()), f"{Q.CTES} SELECT label_week, customer_id, count(*) AS n FROM ({Q.FRAME}) GROUP BY 1, 2"),
    "fit_ranker": (lambda c: c.two_stage()[0].select("customer_id", "article_id", "score"), None),
    "two_stage_full": (two_stage_full, None),
    "score_top_k": (linear, f"{Q_HIST}, f AS ({Q.feature_sql(Q.COMPACT, 'hist', Q.T0)}) {Q.ranked('customer_id, article_id, score', 'customer_id', 'score DESC, article_id', '(SELECT customer_id, article_id, round(ui_cnt + pop_bias + recency_bias, 6) AS score FROM f)', 12)}"),
    "feature_importance": (lambda c: L.feature_importance(*c.two_stage()[1:]), None),
    "rrf_fusion": (fused, f"{Q.CTES}{Q.CF} SELECT customer_id, rank, article_id, round(score, 6) AS score FROM ({Q.ranked('customer_id, article_id, score', 'customer_id', 'score DESC, article_id', f'(SELECT customer_id, article_id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT 3.0::DOUBLE AS w, customer_id, rank, article_id FROM ({Q.REPURCHASE}) UNION ALL SELECT 2.0, customer_id, rank, article_id FROM ({Q.ITEM_CF}) UNION ALL SELECT 1.0, customer_id, rank, article_id FROM ({Q.RECENT_POP})) GROUP BY 1, 2)', 12)})"),
    "run_ensemble": (ensemble, None),
    "ap_at_k": (lambda c: c.ap(), f"{Q.CTES} SELECT customer_id, round(ap, 6) AS ap FROM ({Q.ap(Q.REPURCHASE)})"),
    "map_at_k": (lambda c: M.map_at_k(c.repurchase(), c.truth), f"{Q.CTES} SELECT round(avg(ap), 6) AS map, count(*) AS users FROM ({Q.ap(Q.REPURCHASE)})"),
    "compare_models": (lambda c: M.compare_models(rounded(c.compared())), f"{Q.CTES}{Q.CF} SELECT model, map, CAST(row_number() OVER (ORDER BY map DESC, model) AS INTEGER) AS place, round((map - best) / nullif(best, 0), 6) AS lift FROM (SELECT *, max(map) FILTER (model <> 'item_cf') OVER () AS best FROM (SELECT model, round(map, 6) AS map FROM ({Q.SCORES} UNION ALL SELECT 'item_cf', avg(ap), count(*) FROM ({Q.ap(Q.ITEM_CF)}))))"),
    "ap_by_age_group": (lambda c: M.ap_by_age_group(c.ap(), c.customers), f"{Q.CTES} SELECT age_group, round(avg(ap), 6) AS map, count(*) AS users FROM ({Q.ap(Q.REPURCHASE)}) JOIN cust USING (customer_id) WHERE age_group IS NOT NULL GROUP BY 1"),
    "ap_by_purchase_bin": (lambda c: M.ap_by_purchase_bin(c.ap(), c.past()), f"{Q.CTES} SELECT bin, round(avg(ap), 6) AS map, count(*) AS users FROM (SELECT customer_id, CASE WHEN n <= 5 THEN '1-5' WHEN n <= 15 THEN '6-15' WHEN n <= 30 THEN '16-30' WHEN n <= 60 THEN '31-60' WHEN n <= 1000 THEN '61+' END AS bin FROM (SELECT customer_id, count(*) AS n FROM tx, b WHERE t_dat < test_start GROUP BY 1)) JOIN ({Q.ap(Q.REPURCHASE)}) USING (customer_id) WHERE bin IS NOT NULL GROUP BY 1"),
    "ap_zero_share": (lambda c: M.ap_zero_share(c.ap()), f"{Q.CTES} SELECT round(avg(CASE WHEN ap = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, count(*) AS users FROM ({Q.ap(Q.REPURCHASE)})"),
    "ap_histogram": (lambda c: M.ap_histogram(c.ap()), f"{Q.CTES} SELECT CAST(least(floor(round(ap * 50, 9)), 49) AS INTEGER) AS bin, count(*) AS users FROM ({Q.ap(Q.REPURCHASE)}) GROUP BY 1"),
    "profile_table": (lambda c: profiles(c), f"{Q.CTES} {Q.PROFILE}"),
    "weekly_activity": (lambda c: E.weekly_activity(c.tx).withColumn("revenue", F.round("revenue", 4)), f"{Q.CTES} {Q.WEEKLY}"),
    "weekly_activity_sketched": (lambda c: E.activity(written(E.daily_sketches(c.tx))), None),
    "channel_summary": (lambda c: E.channel_summary(c.tx), f"{Q.CTES} SELECT sales_channel_id, count(*) AS tx, round(avg(price), 6) AS mean_price, round(count(*) / (SELECT count(*) FROM tx), 6) AS share FROM tx GROUP BY 1"),
    "price_histogram": (lambda c: E.price_histogram(c.tx), f"{Q.CTES} SELECT CAST(least(floor((price - lo) / (hi - lo) * 80), 79) AS INTEGER) AS bin, count(*) AS n FROM tx, (SELECT min(price) AS lo, max(price) AS hi FROM tx) GROUP BY 1"),
    "price_quantiles": (lambda c: E.price_quantiles(c.tx), f"{Q.CTES} {Q.QUANTILES}"),
    "price_box": (lambda c: E.price_box(c.tx), f"{Q.CTES} {Q.BOX}"),
    "age_distribution": (lambda c: E.age_distribution(c.customers), f"{Q.CTES} SELECT round(avg(age), 6) AS mean, median(age) AS median, count(age) AS n FROM cust"),
    "age_histogram": (lambda c: E.age_histogram(c.customers), f"{Q.CTES} {Q.histogram('cust', 'age', 50, 'count(*) AS customers')}"),
    "value_counts": (lambda c: value_counts(c), f"{Q.CTES} {Q.VALUES}"),
    "purchase_frequency": (lambda c: E.purchase_frequency(c.tx), f"{Q.CTES} SELECT least(c, 100) AS purchases, count(*) AS customers FROM {Q.PER} GROUP BY 1"),
    "purchase_stats": (lambda c: E.purchase_stats(c.tx), f"{Q.CTES} SELECT * FROM ({Q.PURCHASES})"),
    "purchase_cdf": (lambda c: E.purchase_cdf(c.tx), f"{Q.CTES} SELECT purchases, customers, round(cdf, 6) AS cdf FROM ({Q.CDF})"),
    "cdf_thresholds": (lambda c: E.cdf_thresholds(E.purchase_cdf(c.tx)), f"{Q.CTES} SELECT min(purchases) FILTER (cdf >= 0.5) AS p50, min(purchases) FILTER (cdf >= 0.8) AS p80, min(purchases) FILTER (cdf >= 0.95) AS p95 FROM ({Q.CDF})"),
    "top_articles": (lambda c: E.top_articles(c.tx, c.articles), f"{Q.CTES} SELECT article_id, prod_name, n FROM (SELECT article_id, count(*) AS n FROM tx GROUP BY 1 ORDER BY n DESC, article_id LIMIT 20) LEFT JOIN art USING (article_id)"),
    "article_histogram": (lambda c: E.article_histogram(c.tx), f"{Q.CTES} {Q.histogram('(SELECT least(count(*), 3000) AS c FROM tx GROUP BY article_id)', 'c', 60, 'count(*) AS articles')}"),
    "unsold_articles": (lambda c: E.unsold_articles(c.tx, c.articles), f"{Q.CTES} SELECT count(*) FILTER (article_id NOT IN (SELECT article_id FROM tx)) AS unsold, count(*) FILTER (article_id IN (SELECT article_id FROM tx)) AS sold FROM art"),
    "age_product_pivot": (lambda c: E.age_product_pivot(c.tx, c.customers, c.articles), f"{Q.CTES}{Q.PIVOT_CTE} {Q.PIVOT}"),
    "repeat_rate": (lambda c: E.repeat_rate(c.tx), f"{Q.CTES} {Q.REPEAT}"),
    "monthly_price_ci": (lambda c: E.monthly_price_ci(c.tx, c.articles, Q.GROUPS), f"{Q.CTES} {Q.MONTHLY}"),
    "monthly_category_share": (lambda c: c.shares(), f"{Q.CTES}{Q.SHARE_CTE} {Q.SHARE}"),
    "season_clusters": (lambda c: E.season_clusters(written(c.shares())), None),
    "old_sales_ratio": (lambda c: S.old_sales_ratio(c.tx, CUTOFF), f"{Q.CTES} SELECT article_id, count(*) AS total, round(avg(CASE WHEN t_dat < DATE '{Q.CUTOFF}' THEN 1.0 ELSE 0.0 END), 6) AS old_ratio FROM tx GROUP BY 1"),
    "old_ratio_histogram": (lambda c: S.old_ratio_histogram(S.old_sales_ratio(c.tx, CUTOFF)), f"{Q.CTES} {Q.histogram(Q.OLD_RATIOS, 'old_ratio', 50, 'count(*) AS articles, count(*) FILTER (v >= 0.95) AS obsolete')}"),
    "repurchase_rate": (lambda c: _repurchase_rate(c), f"{Q.CTES} {Q.AGAIN}"),
    "word_counts": (lambda c: E.word_counts(c.articles), f"{Q.CTES} {Q.WORDS}"),
}


def _repurchase_rate(c: Context) -> DataFrame:
    tx = c.tx.join(c.articles.select("article_id", "product_code", "product_group_name"), "article_id")
    return E.repurchase_rate(tx, "article_id").unionByName(E.repurchase_rate(tx, "product_code")).unionByName(E.repurchase_rate(tx, "product_group_name"))


#: One division of stored doubles: equal to the last bit, and often a tie of rounding.
EXACT = {"load_tables", "sample_customers"}
#: Queries that use the transactions in many places.
STORED = {"run_baselines", "write_results", "compare_models", "item_cf", "rrf_fusion", "run_ensemble", "candidates_full", "profile_table", "interaction_features_full", "stratified_candidates", "hard_negatives", "candidate_labels", "candidate_recall", "write_processed", "stored_splits", "stored_customers", "stored_obsolete", "item_similarity", "item_neighbours", "cf_scores", "features_compact", "training_frame", "group_sizes", "fit_ranker", "save_model", "feature_importance", "user_history_daily", "two_stage_full"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: (lambda spark, path, f=f, store=k in STORED, r=(lambda df: df) if k in EXACT else rounded: r(f(Context(spark, path, store)))) for k, (f, _) in PAIRS.items()}
ORACLE_SQL: dict[str, str] = {k: s for k, (_, s) in PAIRS.items() if s}
