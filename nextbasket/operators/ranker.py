"""Rankers (listwise boosted trees, or pointwise ones), scoring and rank fusion."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import top_k
from ..sources.scratch import written
from . import boosting as B
from . import candidates as C
from . import features as X
from .prep import between, ground_truth, multi_week_splits


def full_rows(history: DataFrame, customers: DataFrame, articles: DataFrame, users: DataFrame, t: dt.date, obsolete: DataFrame | None = None) -> DataFrame:
    """customer_id, article_id, source and all features at t: the candidates of all six sources for users, with the features of the user, the article and the pair; unknown ones are imputed, the age by its median.

    Only rows before t count, whatever history holds.
    """
    history = between(history, None, t)
    # the users' rows and the last 60 days are written, so that the whole history is read a few times only
    own, last = written(history.join(users.select("customer_id"), "customer_id", "left_semi")), written(C.window_before(history, t, 60))
    candidates = written(C.full(last, customers, articles, users, t, obsolete, own))
    user = X.user_features_full(own, customers, articles, t)
    article = X.article_features_full(history, articles, t).withColumnRenamed("avg_price", "article_avg_price")
    pair = X.interaction_features_full(history, candidates, articles, t, C.PRIORITY, own)
    rows = candidates.select("customer_id", "article_id", "source").join(pair, ["customer_id", "article_id"]).join(user, "customer_id", "left").join(article, "article_id", "left")
    return X.impute(written(rows))


def full_training_frame(history: DataFrame, customers: DataFrame, articles: DataFrame, test_start: dt.date, n_weeks: int = 2, obsolete: DataFrame | None = None) -> DataFrame:
    """full_rows of each label week's users at the week's first day with sales, with label and label_week. Weeks without sales give no rows; None where all have none."""
    out = None
    for start, _, labels in multi_week_splits(history, test_start, n_weeks):
        t = labels.agg(F.min("t_dat")).first()[0]  # one row
        if t is None:
            continue
        rows = full_rows(history, customers, articles, labels.select("customer_id").distinct(), t, obsolete)
        rows = C.candidate_labels(rows, ground_truth(labels)).withColumn("label_week", F.lit(start))
        out = rows if out is None else out.unionByName(rows)
    return out


def group_sizes(frame: DataFrame) -> DataFrame:
    return frame.groupBy("label_week", "customer_id").agg(F.count("*").alias("n"))


def fit(frame: DataFrame, columns: Sequence[str] = X.COMPACT, settings: B.Settings | None = None) -> B.Forest:
    """Listwise: the order within (label_week, customer_id) is what is learnt."""
    return B.fit(frame, columns, settings=settings)


def fit_pointwise(frame: DataFrame, columns: Sequence[str] = X.COMPACT, trees: int = 10, depth: int = 4, rate: float = 0.1, seed: int = 42) -> PipelineModel:
    """Each candidate by itself: a classifier of its label."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="features"), GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)]
    return Pipeline(stages=stages).fit(frame)


def save_model(model: B.Forest | PipelineModel, spark: SparkSession, path: str) -> B.Forest | PipelineModel:
    """Writes the model, without data, and loads it again."""
    if isinstance(model, B.Forest):
        B.save(model, spark, path)
        return B.load(spark, path)
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def score(model: B.Forest | PipelineModel, frame: DataFrame) -> DataFrame:
    if isinstance(model, B.Forest):
        return B.score(model, frame)
    return model.transform(frame).withColumn("score", F.round(vector_to_array("probability")[1], 9)).select(*frame.columns, "score")


def best(scored: DataFrame, k: int = 12) -> DataFrame:
    return top_k(scored, ["customer_id"], [F.desc("score"), F.col("article_id")], k).select("customer_id", "rank", "article_id", "score")


def feature_importance(model: B.Forest | PipelineModel, frame: DataFrame, columns: Sequence[str] = X.COMPACT) -> DataFrame:
    """feature, kind, importance: shares of the gain of all splits."""
    kind = lambda c: "user" if c.startswith("u_") or c == "user_activity" else "article" if c.startswith("i_") or c in ("pop_bias", "recency_bias") else "user-article"
    gains = model.gains() if isinstance(model, B.Forest) else dict(zip(columns, map(float, model.stages[-1].featureImportances.toArray()), strict=True))
    return frame.sparkSession.createDataFrame([(c, kind(c), v) for c, v in gains.items()], "feature string, kind string, importance double")


def list_weights(models: Sequence[str], weights: Sequence[float]) -> dict[str, float]:
    """The weight of each model's list; 1.0 each where there are not as many weights as lists."""
    return dict(zip(models, weights, strict=True)) if len(models) == len(weights) else dict.fromkeys(models, 1.0)


def rrf(predictions: DataFrame, weights: dict[str, float], k: int = 12, lists: int = 50, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rows (model, customer_id, rank, article_id): sum of weight / (constant + rank)."""
    w = C.weight("model", weights)
    sums = predictions.where(F.col("rank") <= lists).groupBy("customer_id", "article_id").agg(F.round(F.sum(w / (constant + F.col("rank"))), 9).alias("score"))
    return best(sums, k)
