"""Hand-made rows with hand-computed answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nextbasket.functions.ranks import age_group
from nextbasket.operators import analytics, candidates, features, itemcf, metrics, popularity, prep, ranker
from nextbasket.sources import tables

DAY = dt.date(2020, 9, 22)


def tx(spark, rows):
    """(day offset back from DAY, customer, article)"""
    return spark.createDataFrame([(DAY - dt.timedelta(days=d), c, a, 1.0, 2) for d, c, a in rows], "t_dat date, customer_id string, article_id string, price double, sales_channel_id int")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def preds(spark, by_user):
    return spark.createDataFrame([(u, i + 1, a) for u, items in by_user.items() for i, a in enumerate(items)], "customer_id string, rank int, article_id string")


def truth(spark, by_user):
    return spark.createDataFrame([(u, a) for u, items in by_user.items() for a in items], "customer_id string, article_id string")


@pytest.mark.parametrize(
    ("predicted", "actual", "k", "expected"),
    [("abc", "abc", 3, 1.0), ("xyz", "ab", 3, 0.0), ("axb", "ab", 3, (1 + 2 / 3) / 2), ("xyza", "a", 3, 0.0), ("", "a", 12, 0.0)],
)
def test_ap(spark, predicted, actual, k, expected):
    got = metrics.ap_at_k(preds(spark, {"u": predicted}), truth(spark, {"u": actual}), k).collect()
    assert [r["ap"] for r in got] == pytest.approx([expected])


def test_map(spark):
    p = preds(spark, {"u1": "ab", "u2": "xy", "u3": "a"})
    assert metrics.map_at_k(p, truth(spark, {"u1": "a", "u2": "a"}), 2).first()["map"] == pytest.approx(0.5)


def test_weeks_and_splits(spark):
    t = tx(spark, [(7 * w, f"c{w}", "a") for w in range(12) for _ in range(2)])
    assert rows(prep.week_index(t).where("week < 3").distinct(), "customer_id", "week") == [("c0", 0), ("c1", 1), ("c2", 2)]
    split = {r["split"]: r["n"] for r in prep.week_split(t).groupBy("split").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert split == {"test": 2, "val": 2, "train": 16}
    assert dict(prep.reduce_memory(spark.createDataFrame([(1.0, 1)], "a double, b long")).dtypes) == {"a": "float", "b": "int"}


def test_obsolete(spark):
    t = tx(spark, [(900, "c", "old")] * 10 + [(1, "c", "new")] * 10)
    assert rows(prep.obsolete_articles(t, dt.date(2019, 1, 1)), "article_id") == [("old",)]


def test_cleaning(spark):
    c = spark.createDataFrame([("a", 20.0, None, None), ("b", 40.0, "ACTIVE", "x"), ("c", None, None, "x")], "customer_id string, age double, club_member_status string, fashion_news_frequency string")
    assert rows(prep.clean_customers(c), "*")[2] == ("c", 30.0, "UNKNOWN", "x")


def test_age_bins(spark):
    d = spark.createDataFrame([(15.0,), (16.0,), (25.0,), (26.0,), (100.0,), (101.0,), (None,)], "age double")
    assert [r[0] for r in d.select(age_group(d["age"])).collect()] == [None, "16-24", "16-24", "25-34", "65+", None, None]


def test_repurchase_example(spark):
    users = spark.createDataFrame([("u",), ("v",)], "customer_id string")
    fallback = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "rank int, article_id string")
    got = popularity.repurchase(tx(spark, [(1, "u", "a"), (3, "u", "a")]), users, fallback, 3)
    assert rows(got, "customer_id", "rank", "article_id") == [("u", 1, "a"), ("u", 2, "b"), ("u", 3, "c"), ("v", 1, "b"), ("v", 2, "a"), ("v", 3, "c")]


def test_stratified_example(spark):
    c = spark.createDataFrame([("u", "a", "repurchase_short", 1), ("u", "b", "repurchase_short", 2), ("u", "c", "popular_global", 1), ("u", "d", "popular_global", 2)], "customer_id string, article_id string, source string, cand_rank int")
    got = candidates.stratified(c, 3, {"repurchase_short": 1, "popular_global": 1})
    assert [r["article_id"] for r in got.orderBy("rank").collect()] == ["a", "c", "b"]


def test_compact_keeps_first_source(spark):
    t = tx(spark, [(1, "u", "a"), (1, "v", "a"), (9, "u", "b"), (30, "u", "c")])
    users = spark.createDataFrame([("u",)], "customer_id string")
    got = candidates.compact(t, users, DAY)
    assert rows(got, "article_id", "source") == [("a", "pop_7d"), ("b", "pop_14d"), ("c", "recent_user")]


def test_hard_negatives(spark):
    c = spark.createDataFrame([("u", str(i), "popular_global" if i % 2 else "repurchase_short", i, int(i == 7)) for i in range(100)], "customer_id string, article_id string, source string, cand_rank int, label int")
    got = candidates.hard_negatives(c, 10, 30)
    assert got.count() == 31 and got.where("label = 1").count() == 1 and got.where("source = 'repurchase_short'").count() == 30


def test_item_cf(spark):
    t = tx(spark, [(1, "u", "a"), (1, "u", "b"), (1, "v", "a"), (1, "v", "b"), (1, "w", "a"), (1, "w", "c")])
    pairs = itemcf.interactions(t)
    sim = itemcf.item_similarity(pairs)
    assert rows(sim.where("item_i = 'a'"), "item_j", "co", "sim") == [("b", 2, round(2 / 6**0.5, 9)), ("c", 1, round(1 / 3**0.5, 9))]
    assert rows(sim, "item_i", "item_j", "sim") == rows(sim, "item_j", "item_i", "sim")
    users = spark.createDataFrame([("u",), ("x",)], "customer_id string")
    got = itemcf.item_cf(t, pairs, itemcf.item_neighbours(sim), users, 2)
    assert rows(got, "customer_id", "rank", "article_id") == [("u", 1, "c"), ("x", 1, "a"), ("x", 2, "b")]


def test_no_future_in_features(spark):
    past = tx(spark, [(3, "u", "a"), (5, "u", "b"), (2, "v", "a")])
    c = spark.createDataFrame([("u", "a", "recent_user", 1), ("n", "z", "pop_7d", 1)], "customer_id string, article_id string, source string, cand_rank int")
    future = past.unionByName(tx(spark, [(-1, "u", "a")]))
    a, b = (features.compact(prep.between(x, None, DAY), c, DAY) for x in (past, future))
    assert rows(a, "*") == rows(b, "*")
    assert rows(a, "customer_id", "u_tx", "i_tx", "ui_cnt", "i_recency") == [("n", 0.0, 0.0, 0.0, 0.0), ("u", 2.0, 2.0, 1.0, 2.0)]


def test_multi_week(spark):
    t = tx(spark, [(d, "u", "a") for d in range(60)])
    got = prep.multi_week_splits(t, DAY, 2)
    assert [s for s, _, _ in got] == [DAY - dt.timedelta(days=14), DAY - dt.timedelta(days=21)]
    assert all(label.count() == 7 for _, _, label in got)


def test_rrf_is_invariant_under_scaling(spark):
    p = spark.createDataFrame([("m", "u", 1, "a"), ("m", "u", 2, "b"), ("n", "u", 1, "b"), ("n", "u", 2, "c")], "model string, customer_id string, rank int, article_id string")
    one, two = (ranker.rrf(p, {"m": 3.0 * s, "n": 1.0 * s}).orderBy("rank").collect() for s in (1, 2))
    assert [r["article_id"] for r in one] == [r["article_id"] for r in two] == ["b", "a", "c"]


def test_ranker_finds_a_planted_signal(spark):
    rows_ = [(f"u{u}", str(i), "pop_7d", i, int(i == 0)) + tuple(float(i == 0) if c == "ui_cnt" else 0.0 for c in features.COMPACT) for u in range(30) for i in range(8)]
    names = ", ".join(f"{c} double" for c in features.COMPACT)
    frame = spark.createDataFrame(rows_, f"customer_id string, article_id string, source string, cand_rank int, label int, {names}")
    model = ranker.fit_pointwise(frame, trees=2, depth=2)
    best = ranker.best(ranker.score(model, frame), 1)
    assert {r["article_id"] for r in best.collect()} == {"0"}
    assert ranker.feature_importance(model, frame).orderBy("importance", ascending=False).first()["feature"] == "ui_cnt"


def test_repurchase_rate_counts_the_next_row_alone(spark):
    t = tx(spark, [(20, "u", "a"), (15, "u", "a"), (15, "u", "a"), (0, "u", "a")])
    assert rows(analytics.repurchase_rate(t, "article_id"), "w1", "w2", "w3") == [(25.0, 25.0, 50.0)]


def test_encode_ids(spark):
    got = tables.encode_ids(spark.range(1000).selectExpr("id * 3 as id").union(spark.range(10)), "id", "code")
    ids = sorted({*range(0, 3000, 3), *range(10)})
    assert rows(got, "id", "code") == [(x, i) for i, x in enumerate(ids)]


def test_impute_and_validate(spark):
    d = spark.createDataFrame([(None, 1.0, 2), (5.0, None, None)], "age double, online_ratio double, n_tx int")
    assert rows(features.impute(d), "*") == [(5.0, 0.5, 0), (5.0, 1.0, 2)]
    assert rows(features.validate(d, ["age", "n_tx"]), "*") == [("age", 1), ("n_tx", 1)]
    with pytest.raises(ValueError, match="missing"):
        features.validate(d, ["nope"])


def test_running_totals_and_quantiles(spark):
    import random

    from nextbasket.functions.order import quantiles, running

    r = random.Random(1)
    data = [(k, r.randint(0, 50), i) for k in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(data, "k string, v int, i int").repartition(8)
    got = {(x["k"], x["i"]): x["total"] for x in running(df, ["k"], ["v", "i"], df["v"], "total").collect()}
    for k in ("a", "b", None):
        total = 0
        for _, v, i in sorted((x for x in data if x[0] == k), key=lambda x: x[1:]):
            total += v
            assert got[k, i] == total
    q = {(x["k"], x["p"]): x["q"] for x in quantiles(df.union(spark.sql("select 'a', cast(null as int), 0")), "k", "v", (0.0, 0.3, 0.5, 1.0)).collect()}
    for k in ("a", "b", None):
        values = sorted(x[1] for x in data if x[0] == k)
        for p in (0.0, 0.3, 0.5, 1.0):
            at = p * (len(values) - 1)
            lo = int(at)
            want = values[lo] + (at - lo) * (values[min(lo + 1, len(values) - 1)] - values[lo])
            assert q[k, p] == pytest.approx(want)
    assert quantiles(df.limit(0), "k", "v", (0.5,)).count() == 0


def test_similarity_is_the_same_in_blocks(spark):
    import random

    r = random.Random(2)
    pairs = spark.createDataFrame([(c, a) for c in range(12) for a in range(40) if r.random() < (0.9 if c == 0 else 0.2)], "customer_id int, article_id int")
    whole, split = (sorted(map(tuple, itemcf.item_similarity(pairs, block).collect())) for block in (256, 3))
    assert whole == split and whole


def test_similarity_is_the_same_dealt_over_tasks_of_few_pairs(spark):
    import random

    r = random.Random(3)
    pairs = spark.createDataFrame([(c, a) for c in range(30) for a in range(25) if r.random() < (1 if a == 0 else 0.2)], "customer_id int, article_id int")
    whole = sorted(map(tuple, itemcf.item_similarity(pairs).collect()))
    for most in (20, 90, 400):  # article 0 has more pairs than a task counts
        dealt = itemcf.item_similarity(pairs, 4, most)
        assert sorted(map(tuple, dealt.collect())) == whole
        sizes = [x["count"] for x in dealt.groupBy(F.spark_partition_id()).count().collect()] if most == 20 else []
        assert not sizes or len(sizes) > 10
    few = itemcf.item_similarity(pairs, of=spark.createDataFrame([(3,), (7,), (99,)], "article_id int"))
    assert sorted(map(tuple, few.collect())) == [x for x in whole if x[0] in (3, 7)]
    assert itemcf.item_similarity(pairs.limit(0)).count() == 0


def test_comparison_with_the_best_baseline(spark):
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("item_cf", 0.3), ("two_stage", 0.5)], "model string, map double")
    got = {x["model"]: (x["place"], x["lift"]) for x in metrics.compare_models(scores).collect()}
    assert got["two_stage"] == (1, pytest.approx(1.5)) and got["b"] == (3, 0.0) and got["a"] == (4, pytest.approx(-0.5))


def test_list_weights():
    assert ranker.list_weights(["x", "y"], [3.0, 2.0]) == {"x": 3.0, "y": 2.0}
    assert ranker.list_weights(["x", "y"], [3.0]) == {"x": 1.0, "y": 1.0}


def test_histograms(spark):
    ages = spark.createDataFrame([(float(a),) for a in (20, 20, 45, 70)] + [(None,)], "age double")
    assert rows(analytics.age_histogram(ages, 5), "bin", "customers") == [(0, 2), (2, 1), (4, 1)]
    assert rows(analytics.age_histogram(ages.where("age = 20"), 5), "bin", "customers") == [(2, 2)]
    ratios = prep.old_sales_ratio(tx(spark, [(900, "c", "old")] * 3 + [(1, "c", "new"), (900, "c", "mid"), (1, "c", "mid")]), dt.date(2019, 1, 1))
    assert rows(prep.old_ratio_histogram(ratios, 4), "bin", "articles", "obsolete") == [(0, 1, 0), (2, 1, 0), (3, 1, 1)]


def test_shares_of_real_months_and_clusters(spark):
    t = spark.createDataFrame([(dt.date(y, m, 3), f"a{k}") for k in range(40) for y in (2019, 2020) for m in (range(1, 7) if k % 2 else range(7, 13)) for _ in range(1 + k % 3)], "t_dat date, article_id string")
    a = spark.createDataFrame([(f"a{k}", "g", "i", f"type{k}") for k in range(40)] + [("a0", None, "i", "x")], "article_id string, index_group_name string, index_name string, product_type_name string")
    shares = analytics.monthly_category_share(t, a)
    assert shares.count() == 40 * 24
    one = {str(x["month"]): x["pct"] for x in shares.where("category = 'g | i | type1'").collect()}
    assert one["2019-01-01"] == pytest.approx(100 / 12) and one["2020-12-01"] == 0
    sizes = sorted(x["n"] for x in analytics.season_clusters(shares, k=2).collect())
    assert sizes == [20, 20]


def test_ranker_splits(spark):
    t = tx(spark, [(1, "c", "x"), (8, "c", "y"), (8, "c", "y"), (20, "d", "z")])
    parts = prep.ranker_splits(t, prep.bounds(t, dt.date(2000, 1, 1)))
    assert {k: v.count() for k, v in parts.items()} == {"train_full": 3, "train_feat": 1, "val": 2, "val_truth": 1, "test_truth": 1}
