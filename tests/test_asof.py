"""As-of features against a pass over the history for each week."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nextbasket.operators import asof, candidates, features, prep

DAY = dt.date(2020, 9, 22)
COLUMNS = ["customer_id", "article_id", "source", "cand_rank", "label", *features.COMPACT, "label_week"]


def by_weeks(history, test_start, n_weeks):
    """The same frame, week after week, each from the rows before it."""
    out = []
    for start, past, labels in prep.multi_week_splits(history, test_start, n_weeks):
        t = labels.agg(F.min("t_dat")).first()[0]
        if t is None:
            continue
        past = prep.between(history, None, t)
        rows = candidates.candidate_labels(candidates.compact(past, labels.select("customer_id").distinct(), t), prep.ground_truth(labels))
        out += [tuple(r) for r in features.compact(past, rows, t).withColumn("label_week", F.lit(start)).select(COLUMNS).collect()]
    return sorted(map(rounded, out))


def rounded(r):
    return tuple(str(round(x, 6) + 0.0 if isinstance(x, float) else x) for x in r)


@pytest.fixture(scope="module")
def history(spark):
    r = random.Random(8)
    rows = [(DAY - dt.timedelta(days=int(r.expovariate(1 / 25)) + 1), f"c{r.randrange(40)}", f"a{int(r.expovariate(1 / 30))}", float(r.randrange(1, 900)) / 4) for _ in range(3000)]
    rows += [(DAY - dt.timedelta(days=r.randrange(1, 60)), "c0", "a1", 2.5) for _ in range(900)]  # one customer and article have a fifth of all rows
    rows = [x for x in rows if not 14 <= (DAY - x[0]).days <= 16]  # a week whose first days have no sales
    return spark.createDataFrame(rows, "t_dat date, customer_id string, article_id string, price double")


@pytest.mark.parametrize("n_weeks", [1, 2, 3, 4])
def test_frame_equals_a_pass_for_each_week(history, n_weeks):
    got = asof.training_frame(history, DAY, n_weeks)
    want = by_weeks(history, DAY, n_weeks)
    assert got.columns == COLUMNS
    assert sorted(map(rounded, got.collect())) == want and len(want) > 1000 * n_weeks


def test_weeks_without_sales_give_no_rows(spark, history):
    old = history.where(F.col("t_dat") < DAY - dt.timedelta(days=21))
    assert asof.training_frame(old, DAY, 2).count() == 0
    assert {r[0] for r in asof.training_frame(old, DAY, 4).select("label_week").distinct().collect()} == {DAY - dt.timedelta(days=28), DAY - dt.timedelta(days=35)}
    assert asof.training_frame(history.limit(0), DAY, 2).count() == 0


def test_state_before_a_day(history):
    days = asof.days_table(history)
    at = [DAY - dt.timedelta(days=k) for k in (0, 3, 17, 500)]
    got = {(r["t"], r["customer_id"]): (r["n"], r["last"]) for r in asof.as_of(asof.running(days, ["customer_id"], {"n": F.col("n")}), at).collect()}
    want = {}
    for t in at:
        for c, n, last in history.where(F.col("t_dat") < F.lit(t)).groupBy("customer_id").agg(F.count("*"), F.max("t_dat")).collect():
            want[t, c] = (n, last)
    assert got == want


def test_history_is_read_once(spark, tmp_path, history):
    """Whatever the number of weeks, the files of the history are in the plan of one write alone; all else reads the days."""
    history.write.parquet(f"{tmp_path}/history_once")
    rows = spark.read.parquet(f"{tmp_path}/history_once")
    scans, of = [], lambda df: sum("history_once" in f for f in df.inputFiles())
    plain = asof.written
    try:
        asof.written = lambda df: scans.append(of(df)) or plain(df)
        frame = asof.training_frame(rows, DAY, 4)
    finally:
        asof.written = plain
    assert scans[0] > 0 and sum(scans) == scans[0] and of(frame) == 0
    assert frame._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 12
