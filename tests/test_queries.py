"""Registered queries against their SQL on the smallest tables, and what their plans may not hold."""

import math
import os

import pytest

from nextbasket.plans.queries import ORACLE_SQL, QUERIES

PATH = "/root/testdata/sf0.001"
CHOSEN = ("repurchase", "age_segmented_popularity", "item_cf", "candidates_compact", "stratified_candidates", "cold_start", "candidate_recall", "features_compact", "article_features_full", "compare_models", "purchase_cdf", "monthly_category_share", "repurchase_rate")
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="no test tables")


def text(v):
    return "None" if v is None or isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{PATH}/{t}.parquet'")
    df, rel = QUERIES[name](spark, PATH), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(text(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["repurchase", "item_neighbours", "user_features_full", "candidates_full"])
def test_plans_are_native(spark, name):
    plan = QUERIES[name](spark, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
