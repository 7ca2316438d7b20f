"""Listwise boosting against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nextbasket.operators import boosting as B
from nextbasket.operators import candidates as C
from nextbasket.operators import features as X
from nextbasket.operators import metrics as M
from nextbasket.operators import ranker as L

COLUMNS = ("a", "b", "c")


def plain_lambdas(score, label):
    """Of one group, pair by pair."""
    n = len(score)
    order = sorted(range(n), key=lambda i: (-score[i], i))
    rank = {i: k for k, i in enumerate(order)}
    dcg = lambda k: 1 / math.log2(k + 2)
    ideal = sum((2**x - 1) * dcg(k) for k, x in enumerate(sorted(label, reverse=True)))
    g, h = [0.0] * n, [0.0] * n
    for i in range(n):
        for j in range(n):
            if label[i] > label[j]:
                p = 1 / (1 + math.exp(score[i] - score[j]))
                w = abs(dcg(rank[i]) - dcg(rank[j])) * (2 ** label[i] - 2 ** label[j]) / ideal
                g[i] += w * p
                g[j] -= w * p
                h[i] += w * p * (1 - p)
                h[j] += w * p * (1 - p)
    return g, h


def test_lambdas_equal_plain_loops():
    r = random.Random(1)
    groups = [[(r.choice([0.0, 0.5, r.random()]), r.choice([0, 0, 0, 1, 2])) for _ in range(r.randrange(1, 12))] for _ in range(60)]
    groups += [[(0.1, 0)] * 4, [(0.3, 1)] * 3, [(900.0, 0), (-900.0, 1)]]
    start = np.append(0, np.cumsum([len(g) for g in groups]))
    first, second = B.lambdas(*(np.array([x[k] for g in groups for x in g]) for k in (0, 1)), start)
    for g, a, b in zip(groups, start, start[1:]):
        want = plain_lambdas([x[0] for x in g], [x[1] for x in g])
        assert first[a:b] == pytest.approx(want[0]) and second[a:b] == pytest.approx(want[1])


def frame(spark, n=120, seed=3):
    """c decides, a helps, b is noise; some features are unknown."""
    r = random.Random(seed)
    rows = []
    for week in (1, 2):
        for u in range(n):
            c = [r.random() for _ in range(15)]
            top = sorted(c)[-2:]
            rows += [(week, u, k, int(x in top and r.random() < 0.9), x + 3 * r.random() if r.random() > 0.1 else None, r.random(), x) for k, x in enumerate(c)]
    return spark.createDataFrame(rows, "label_week int, customer_id long, article_id long, label int, a double, b double, c double")


def plain_fit(rows, columns, cuts, s):
    """The same model on one machine: rows in memory, each split by trying all bins."""
    keys = sorted({(r["label_week"], r["customer_id"]) for r in rows})
    x = np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in rows])
    bins = np.stack([np.where(np.isnan(x[:, k]), 0, [int((cuts[k] < v).sum()) for v in x[:, k]]) for k in range(len(columns))], 1)
    draws, score = np.random.default_rng(s.seed), np.zeros(len(rows))
    for _ in range(s.trees):
        g, h = np.zeros(len(rows)), np.zeros(len(rows))
        for key in keys:
            own = [i for i, r in enumerate(rows) if (r["label_week"], r["customer_id"]) == key]
            g[own], h[own] = plain_lambdas(score[own].tolist(), [rows[i]["label"] for i in own])
        use = sorted(draws.permutation(len(columns))[: max(1, round(s.columns_share * len(columns)))])

        def grow(own, depth, value):
            best = (s.least_gain, None)
            worth = lambda i: g[i].sum() ** 2 / (h[i].sum() + s.l2)  # noqa: B023, E731
            for f in use if depth else []:
                for b in range(s.bins - 1):
                    left = bins[own, f] <= b
                    if min(left.sum(), (~left).sum()) >= s.least_rows:
                        gain = worth(own[left]) + worth(own[~left]) - worth(own)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, b))
            if best[1] is None:
                score[own] += value
                return
            left = bins[own, best[1][0]] <= best[1][1]
            for side in (own[left], own[~left]):
                grow(side, depth - 1, s.rate * g[side].sum() / (h[side].sum() + s.l2))

        grow(np.arange(len(rows)), s.depth, 0.0)
    return score


def test_model_equals_one_machine(spark):
    data = frame(spark, 25).repartition(5)
    s = B.Settings(trees=5, depth=3, bins=16, least_rows=20, rows_share=1.0, columns_share=0.7, keep=2, rate=0.3)
    model = B.fit(data, COLUMNS, settings=s)
    rows = sorted((r.asDict() for r in data.collect()), key=lambda r: (r["label_week"], r["customer_id"], r["article_id"]))
    got = {(r["label_week"], r["customer_id"], r["article_id"]): r["score"] for r in B.score(model, data).collect()}
    want = plain_fit(rows, COLUMNS, B.cut_points(data, COLUMNS, s.bins), s)
    assert [got[r["label_week"], r["customer_id"], r["article_id"]] for r in rows] == pytest.approx(want.tolist(), abs=1e-6)


def test_model_does_not_depend_on_partitions_and_survives_a_save(spark, tmp_path):
    data, s = frame(spark), B.Settings(trees=4, depth=3, least_rows=10)
    one, two = (B.fit(data.repartition(k), COLUMNS, settings=s) for k in (1, 7))
    again = L.save_model(two, spark, str(tmp_path / "m"))
    for x in (two, again):
        assert (x.columns, x.depth, len(x.trees)) == (one.columns, one.depth, 4)
        for t, u in zip(one.trees, x.trees):
            assert all(np.array_equal(getattr(t, k), getattr(u, k)) for k in ("feature", "threshold", "gain", "value"))
    importance = {r["feature"]: r["importance"] for r in L.feature_importance(one, data, COLUMNS).collect()}
    assert sum(importance.values()) == pytest.approx(1) and importance["c"] > 0.6


def test_order_is_learnt_within_customers(spark):
    train, test = frame(spark), frame(spark, seed=9)
    model = B.fit(train, COLUMNS, settings=B.Settings(trees=15, depth=3, rate=0.2, least_rows=20))
    truth = test.where("label = 1 and label_week = 1").select("customer_id", "article_id")
    found = lambda scored: M.map_at_k(L.best(scored.where("label_week = 1"), 12), truth).first()["map"]
    learnt = found(L.score(model, test))
    assert learnt > 0.9 > 0.6 > found(test.selectExpr("*", "b as score"))


def test_edges(spark):
    none = frame(spark, 0)
    s = B.Settings(trees=2, depth=2)
    assert B.score(B.fit(none, COLUMNS, settings=s), none).count() == 0
    same = frame(spark, 5).selectExpr("label_week", "customer_id", "article_id", "0 as label", "a", "b", "c")
    assert {r["score"] for r in B.score(B.fit(same, COLUMNS, settings=s), same).collect()} == {0.0}


def test_full_frame_holds_all_features_and_nothing_from_later_days(spark):
    day, r = dt.date(2020, 9, 22), random.Random(5)
    rows = [(day - dt.timedelta(days=r.randrange(80)), r.randrange(20), r.randrange(40), float(r.randrange(1, 50)), 1 + r.randrange(2)) for _ in range(900)]
    tx = spark.createDataFrame(rows, "t_dat date, customer_id long, article_id long, price double, sales_channel_id int")
    customers = spark.createDataFrame([(i, 20.0 + i if i % 4 else None, "ACTIVE") for i in range(20)], "customer_id long, age double, club_member_status string")
    text = lambda e, c: F.concat(F.lit(c), (F.col("id") % e).cast("string")).alias
    articles = spark.range(40).select(F.col("id").alias("article_id"), text(20, "p")("product_code"), text(5, "g")("product_group_name"), text(4, "c")("colour_group_name"), text(3, "t")("product_type_name"), (F.col("id") % 2).cast("int").alias("section_no"))
    test_start = day - dt.timedelta(days=6)
    frame = L.full_training_frame(tx, customers, articles, test_start, 2)
    weeks = {x["label_week"] for x in frame.select("label_week").distinct().collect()}
    assert weeks == {test_start - dt.timedelta(days=d) for d in (14, 21)}
    found = frame.collect()
    keys = [(x["label_week"], x["customer_id"], x["article_id"]) for x in found]
    assert len(set(keys)) == len(keys) and {x["label"] for x in found} == {0, 1} and {x["source"] for x in found} >= {"repurchase_short", "popular_global"}
    features = X.feature_columns(frame)
    assert {"n_unique_categories", "trend", "recency_score", "age", "candidate_source", "article_avg_price"} <= set(features)
    assert all(x["age"] is not None for x in found)
    # the same from a history that ends where the later label week begins
    earlier = tx.where(F.col("t_dat") < F.lit(max(weeks)))
    again = L.full_training_frame(earlier, customers, articles, test_start, 2).where(F.col("label_week") == F.lit(min(weeks)))
    key = lambda x: tuple(round(v, 9) if isinstance(v, float) else str(v) for v in (x[c] for c in sorted(features + ["customer_id", "article_id", "label"])))
    assert sorted(map(key, again.collect())) == sorted(key(x) for x in found if x["label_week"] == min(weeks))
    best = L.best(L.score(L.fit(frame, features, B.Settings(trees=2, depth=2, least_rows=5)), frame.where(F.col("label_week") == F.lit(max(weeks)))))
    assert best.groupBy("customer_id").count().agg(F.max("count")).first()[0] == 12


def test_the_users_rows_and_sixty_days_give_the_candidates_of_the_whole_history(spark):
    day, r = dt.date(2020, 9, 22), random.Random(31)
    rows = [(day - dt.timedelta(days=r.randrange(1, 120)), r.randrange(30), int(r.expovariate(1 / 15)), float(r.randrange(1, 90)), 1) for _ in range(2500)]
    history = spark.createDataFrame(rows, "t_dat date, customer_id long, article_id long, price double, sales_channel_id int")
    articles = history.select("article_id", (F.col("article_id") % 9).cast("string").alias("product_code"), (F.col("article_id") % 4).cast("string").alias("product_group_name")).distinct()
    customers = history.select("customer_id", (F.col("customer_id") + 16.0).alias("age")).distinct()
    users = spark.createDataFrame([(c,) for c in (1, 4, 9, 99)], "customer_id long")
    own, last = history.join(users, "customer_id", "left_semi"), C.window_before(history, day, 60)
    got, want = (c.sort("customer_id", "article_id") for c in (C.full(last, customers, articles, users, day, own=own), C.full(history, customers, articles, users, day)))
    assert got.collect() == want.collect() and want.count() > 100
    pair = lambda **k: X.interaction_features_full(history, want, articles, day, C.PRIORITY, **k).sort("customer_id", "article_id").collect()
    assert pair(own=own) == pair()
