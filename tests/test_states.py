"""What is kept from one load to the next: dictionaries, the stored layout, histories and sketches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nextbasket.functions import order
from nextbasket.operators import analytics, features, popularity, prep
from nextbasket.sources import tables

DAY = dt.date(2020, 9, 22)


@pytest.fixture(scope="module")
def tx(spark):
    r = random.Random(12)
    rows = [(DAY - dt.timedelta(days=r.randrange(70)), r.randrange(60), int(r.expovariate(1 / 20)), round(r.random() * 30, 2), 1 + r.randrange(2)) for _ in range(2500)]
    rows += [(DAY - dt.timedelta(days=r.randrange(70)), 7, 3, 9.5, 1) for _ in range(800)]  # one customer has a quarter of all rows
    return spark.createDataFrame(rows, "t_dat date, customer_id long, article_id long, price double, sales_channel_id int").cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_old_codes_stay_and_codes_are_dense(spark):
    load = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    one = tables.encode_ids(load(["m", "c", None, "x", "c"]), "name", "code")
    two = tables.encode_ids(load(["a", "m", "z", None, "b", "x"]), "name", "code", one)
    assert {r["name"]: r["code"] for r in one.collect()} == {"c": 0, "m": 1, "x": 2}
    assert {r["name"]: r["code"] for r in two.collect()} == {"c": 0, "m": 1, "x": 2, "a": 3, "b": 4, "z": 5}
    assert {r["name"]: r["code"] for r in tables.encode_ids(load(["b", "a"]), "name", "code", one.limit(0)).collect()} == {"a": 0, "b": 1}
    assert tables.encode_ids(load([None]), "name", "code", one).count() == 3


@pytest.fixture(scope="module")
def layout(spark, tx, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "l")
    customers = tx.select("customer_id").distinct().withColumn("age", F.lit(30.0))
    written = tables.write_layout(prep.week_index(tx), customers, tx.select("article_id").distinct(), tx.select("article_id").where("article_id < 3").distinct(), path, 4)
    return written, tables.open_layout(spark, path, 4), path


def test_layout_holds_all_parts_and_splits(spark, tx, layout):
    for l in layout[:2]:
        assert sorted(map(str, l.transactions.select(*tx.columns).collect())) == sorted(map(str, tx.collect()))
        assert (l.customers.count(), l.articles.count(), l.obsolete.count()) == (tx.select("customer_id").distinct().count(), tx.select("article_id").distinct().count(), 3)
        want = {r["split"]: r["n"] for r in prep.week_split(tx).groupBy("split").agg(F.count("*").alias("n")).collect()}
        assert {k: v.count() for k, v in l.splits().items()} == want


def test_layout_reads_few_folders_and_needs_no_exchange_by_customer(spark, layout):
    l = layout[1]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = l.transactions.join(l.customers, "customer_id").groupBy("customer_id").agg(F.sum("price"))
        assert "Exchange" not in plan(joined) and "Bucketed: true" in plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    test = l.splits()["test"]
    assert "PartitionFilters: [isnotnull(week" in plan(test) and {f.split("week=")[1].split("/")[0] for f in test.inputFiles()} >= {"0"}
    assert test.select(F.input_file_name().alias("f")).where("f not like '%/week=0/%'").count() == 0


def test_a_bucket_does_not_grow_with_the_table(spark):
    n = [tables.buckets_for(spark.range(k * 1000), rows=700) for k in (0, 1, 6, 60)]
    assert n == [2, 2, 9, 86]
    assert tables.buckets_for(spark.range(3 * tables.BUCKET_ROWS + 1)) == 4


def test_history_of_daily_merges_is_that_of_all_days(spark, tx):
    for top in (3, 100):
        state, days = popularity.merged_history(None, prep.between(tx, None, DAY - dt.timedelta(days=4)), top), range(4, -1, -1)
        for k in days:
            day = DAY - dt.timedelta(days=k)
            state = popularity.merged_history(state, prep.between(tx, day, day + dt.timedelta(days=1)), top)
        assert sorted(map(tuple, state.collect())) == sorted(map(tuple, popularity.user_history(tx, top_n=top).select(state.columns).collect()))


def test_distinct_counts_need_no_copies_of_rows(spark, tx):
    articles = tx.select("article_id", (F.col("article_id") % 5).cast("string").alias("product_group_name")).distinct()
    customers = tx.select("customer_id", F.lit(30.0).alias("age"), F.lit("ACTIVE").alias("club_member_status")).distinct()
    full = features.user_features_full(tx, customers, articles, DAY)
    for df in (analytics.profile_table(tx), analytics.weekly_activity(tx), full):
        assert "Expand" not in plan(df)
    got = {r["column"]: (r["rows"], r["non_null"], r["n_distinct"]) for r in analytics.profile_table(tx.withColumn("none", F.lit(None).cast("int"))).collect()}
    n = tx.count()
    assert got == {c: (n, n, tx.select(c).distinct().count()) for c in tx.columns} | {"none": (n, 0, 0)}
    assert [tuple(r)[1:4] for r in analytics.profile_table(tx.limit(0)).collect()] == [(t, 0, 0) for _, t in tx.dtypes]
    want = {r[0]: (r[1], r[2]) for r in tx.join(articles, "article_id").groupBy("customer_id").agg(F.countDistinct("article_id"), F.countDistinct("product_group_name")).collect()}
    assert {r["customer_id"]: (r["n_unique_articles"], r["n_unique_categories"]) for r in full.collect()} == want


def test_sketches_of_days_answer_for_weeks_within_their_error(spark):
    many = spark.range(400_000).selectExpr("date_add(date'2020-09-07', cast(id % 7 as int)) as t_dat", "pmod(xxhash64(id), 150000) as customer_id", "id % 977 as article_id", "1.0D as price")
    got = analytics.activity(analytics.daily_sketches(many)).first()
    customers = many.select("customer_id").distinct().count()
    assert got["tx"] == 400_000 and abs(got["customers"] / customers - 1) < 4 * 1.04 / 64 and abs(got["articles"] / 977 - 1) < 4 * 1.04 / 64


def test_quantiles_of_merged_sketches_are_near_in_rank(spark):
    rows = spark.range(120_000).selectExpr("id % 2 as channel", "cast(id % 9 as int) as day", "pow(pmod(xxhash64(id), 100000), 1.3) as price", "case when id % 11 = 0 then null else 1 end as some")
    rows = rows.withColumn("price", F.when(F.col("some").isNotNull(), F.col("price")))
    at = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
    exact = order.quantiles(rows, "channel", "price", at)
    found = order.sketch_quantiles(order.quantile_sketches(rows, ["channel", "day"], "price"), ["channel"], at)
    both = exact.join(found.withColumnRenamed("q", "near"), ["channel", "p"])
    shares = rows.where("price is not null").join(F.broadcast(both), "channel").groupBy("channel", "p").agg(F.avg((F.col("price") <= F.col("near")).cast("int")).alias("rank")).collect()
    assert len(shares) == 14 and max(abs(r["rank"] - r["p"]) for r in shares) < 2 * 2.3 / 800
    assert order.median(rows, "price") == pytest.approx(rows.agg(F.median("price")).first()[0]) and order.median(rows.limit(0), "price") is None


def test_no_folder_of_the_drivers_own_on_a_cluster(spark, monkeypatch):
    from nextbasket.sources import scratch

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch.shared_folder(Session)
