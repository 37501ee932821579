"""Every registered telemetry query against its SQL in DuckDB, on the smallest tables."""

import datetime
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sluice.plans import catalogue, collection  # noqa: F401  # which registers its queries, too


def plain(v):
    if v is None or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 5)
    if isinstance(v, (pd.Timestamp, datetime.date)):
        return pd.Timestamp(v).isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, tables, name):
    df = catalogue.QUERIES[name](spark, tables)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    assert len(got) == len(expected)
    for g, w in zip(got, expected):
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 2e-4) for a, b in zip(g, w)), (g, w)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, tables, name):
    df = catalogue.QUERIES[name](spark, tables)
    got = df.toPandas()
    assert len(got) > 0 and list(got.columns) == df.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_kernel_shap_takes_the_defaults(spark, tables, monkeypatch):
    from sluice.operators import models
    from sluice.plans import catalogue

    asked = []
    monkeypatch.setattr(models, "fit_isolation_forest", lambda *a, **b: asked.append(b))
    monkeypatch.setattr(models, "kernel_attribution", lambda *a, **b: asked.append(b))
    catalogue.kernel_shap(spark, tables)
    assert asked == [{}, {}]  # the forest of iso_scores, 150 readings a factory
