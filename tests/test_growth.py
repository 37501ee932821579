"""Queries whose tables have larger keys, repeated readings or crowded groups than the small tables have, against their SQL."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import aggregates, joins
from sluice.plans import catalogue, collection  # noqa: F401  # which registers its queries, too
from sluice.sources import limit_tables
from tests.test_catalogue import rows


def orders(spark, folder, made):
    """``orders`` of (o_orderkey, o_custkey, o_orderdate) rows."""
    df = spark.createDataFrame(made, "o_orderkey long, o_custkey long, day string").selectExpr("o_orderkey", "o_custkey", "cast(day as timestamp_ntz) as o_orderdate", "'1-URGENT' as o_orderpriority", "'O' as o_orderstatus", "1.5D as o_totalprice")
    df.coalesce(1).write.parquet(f"{folder}/orders.parquet")


def same(spark, folder, name):
    """The query's rows, once they are found to be those of its SQL."""
    duck = duckdb.connect()
    for table in os.listdir(folder):
        duck.sql(f"create view {table[:-8]} as select * from '{folder}/{table}/*.parquet'")
    df, want = catalogue.QUERIES[name](spark, str(folder)), duck.sql(catalogue.SQL[name])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(want.columns) and got == rows(want.columns, want.fetchall())
    return got


def steps(plan):
    """All nodes of an executed plan."""
    yield plan
    inner = [plan.executedPlan()] if plan.nodeName().startswith("AdaptiveSparkPlan") else [plan.plan()] if "QueryStage" in plan.getClass().getName() else []
    for p in [plan.children().apply(i) for i in range(plan.children().size())] + inner:
        yield from steps(p)


def most_rows(df):
    """The most rows that a step of the plan of ``df``, which has been collected, gave out."""
    counts = [p.metrics().get("numOutputRows") for p in steps(df._jdf.queryExecution().executedPlan())]
    return max(c.get().value() for c in counts if c.isDefined())


def test_scalar_functions_with_keys_of_more_than_five_digits(spark, tmp_path):
    orders(spark, tmp_path, [(k, c, "1999-03-04") for k in range(6) for c in (7, 99_999, 100_000, 123_456, 12_345_678)])
    assert len(same(spark, tmp_path, "scalar_functions")) == 30


def test_name_match_compares_names_not_rows(spark, tmp_path):
    made = [(k, n, "B", "T") for k, n in enumerate(["old ring", "old ring", "old ring", "hot ring", "ring", "big red ring", "big red plate", "a", "limited co", "", None, "big red, plate", "x-y m/s zz", "big red"])]
    made += [(20, "ring", "C", "T"), (21, "alone", "D", "T"), (22, "old ring", None, "T")]
    made += [(100 + k, ("cold bolt", "cold gear set", "gear set cold")[k % 3], "E", "T") for k in range(2400)]
    spark.createDataFrame(made, "p_partkey long, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = joins.match_names(*[catalogue.table(spark, tmp_path, "part").withColumn("block", F.concat("p_brand", "p_type"))] * 2, "block", "p_name", "p_partkey", apart=True)
    got = {r["key"]: (r["other"], r["inside"], r["shared"]) for r in df.collect()}
    assert [got.get(k) for k in (0, 1, 2, 4)] == [(1, True, 2), (0, True, 2), (0, True, 2), (0, True, 1)]
    assert 10 not in got and 20 not in got and 21 not in got and 22 not in got
    assert got[100] == (103, True, 2) and got[103] == (100, True, 2) and got[101] == (104, True, 3) and got[107] == (101, True, 3) and len(got) == 2400 + 13 and most_rows(df) < 10_000  # row by row the crowd makes millions of pairs
    assert len(same(spark, tmp_path, "name_match")) == len(got)


def test_match_names_of_two_tables_with_repeated_and_missing_keys(spark):
    left = spark.createDataFrame([(1, "g", "alpha beta"), (1, "g", "gamma"), (2, "g", "alpha beta"), (None, "g", "gamma")], "k int, g string, n string")
    right = spark.createDataFrame([(1, "g", "alpha beta"), (2, "g", "beta alpha"), (2, "g", "gamma x"), (None, "g", "gamma"), (3, "h", "alpha beta")], "k int, g string, n string")
    both = lambda **o: {r["key"]: r["other"] for r in joins.match_names(left, right, "g", "n", "k", **o).collect()}
    assert both() == {1: None, 2: 1, None: None} and both(apart=True) == {1: 2, 2: 1}


def events(spark, folder, rows=3000):
    """``events`` of which each is there twice under two ids, every third time with another value."""
    one = spark.range(rows).selectExpr("id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 700) as ts", "pmod(hash(id), 1000) / 10.0D as v", "pmod(hash(id, 1), 60) as u", "pmod(hash(id, 2), 5) as e", "pmod(hash(id, 3), 100) as k")
    both = one.crossJoin(spark.range(2).withColumnRenamed("id", "copy"))
    named = "element_at(array('click', 'error', 'purchase', 'signup', 'view'), cast(e + 1 as int)) as event_type"
    both.selectExpr(f"id + copy * {rows} as event_id", "ts", "cast(u as long) as user_id", named, "v + if(id % 3 = 0, copy, 0) as value", "concat('{\"k\": ', k, '}') as props").coalesce(1).write.parquet(f"{folder}/events.parquet")


def test_feature_matrix_of_repeated_readings(spark, tmp_path):
    events(spark, tmp_path)
    assert len(same(spark, tmp_path, "feature_matrix_rows")) > 5000


def test_fingerprint_scores_of_repeated_readings(spark, tmp_path):
    events(spark, tmp_path)
    assert len(same(spark, tmp_path, "fingerprint_scores")) == 4


@pytest.mark.parametrize("name", ["iso_scores", "kernel_shap", "seed_stability", "tamper_model_loo", "tamper_probability"])
def test_models_of_repeated_readings(spark, tmp_path, name):
    events(spark, tmp_path)
    got = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == {"iso_scores": 4, "seed_stability": 4, "kernel_shap": 4 * len(catalogue._RAW)}.get(name, 33)


def test_exact_medians(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), float(k % 3), None, float(k) if k == 7 else None, float(k // 2) if k < 10 else None, float(-k) if k % 2 else float(k)) for k, x in enumerate(rng.normal(size=20_001))]
    df = spark.createDataFrame(rows, "`a.b` double, ties double, none double, one double, few double, spread double").repartition(7)
    got = aggregates.exact_medians(df, df.columns)
    want = df.agg(*(F.percentile(f"`{c}`", F.lit(0.5)).alias(str(i)) for i, c in enumerate(df.columns))).first()
    assert [got[c] for c in df.columns] == list(want)
    assert aggregates.exact_medians(df.limit(0), ["ties"]) == {"ties": None} and aggregates.exact_medians(df, []) == {}
    # ranges that miss the middle are found out
    assert list(aggregates.exact_medians(df, df.columns, near=-0.3).values()) == list(want)


def test_overlapping_terms_meet_once(spark, tmp_path):
    orders(spark, tmp_path, [(k, 50 * (k % 3), f"1999-03-{1 + k % 9:02d}") for k in range(1500)])
    assert len(same(spark, tmp_path, "interval_overlap")) > 100_000
    plan = catalogue.interval_overlap(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # only one side is cut into days: a pair does not meet on each day that it shares


def test_limit_cells_are_read_once(spark):
    cells = [["row", "pH", "5.5 to 9", "mg/ l"], ["Parameter", "limit"], ["pH", "from 6 - 8 KLD", "max 1,000"], None, [None, "SO2 ", "1.2.3"], ["BOD (3 days)", "Nil"]]
    tables = spark.createDataFrame([(1, cells), (2, [["pH", "7"]]), (3, [["a", "b"], ["c", "5"]]), (4, None), (5, [None, ["nox", "", "ppm 7 to x"]])], "k int, cells array<array<string>>")
    out = limit_tables.limit_rows(tables, ["k"])
    got = sorted(tuple(r)[:-1] for r in out.collect())
    assert got == [(1, 0, "pH", 5.5, 9.0, "mg/l", "5.5 to 9"), (1, 2, "pH", 6.0, 1000.0, "KLD", "max 1,000"), (5, 1, "nox", None, 7.0, "mg/Nm3", "ppm 7 to x")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast(") <= 6  # not once for each place that a bound is used in
