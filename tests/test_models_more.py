"""Seed stability, clustered background and exact shares, injection without overlaps, and the stream of runs against the batch."""

import datetime as dt
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.config import FeatureConfig
from sluice.operators import inject, models, windows
from sluice.streaming import series


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        spread = 8.0 if k % 2 else 0.01  # factory b: all alike, so that seeds disagree on their order
        rows.append(("a" if k % 2 else "b", k, float(rng.normal() * spread), float(rng.normal() * spread), float(rng.normal() * spread), float(rng.normal()) if k % 5 else None))
    return spark.createDataFrame([*rows, ("c", 9999, 0.0, 0.0, 0.0, 0.0)], "factory_id string, k int, w double, x double, y double, z double")


COLUMNS = ["w", "x", "y", "z"]


def test_seed_stability_orders_factories(spark, cloud):
    forests = models.fit_seeds(cloud, COLUMNS, ["k"], [1, 2, 3], trees=40)
    same = models.fit_isolation_forest(cloud, COLUMNS, ["k"], trees=40)
    x = np.random.default_rng(2).normal(size=(50, 4))
    assert (models.fit_seeds(cloud, COLUMNS, ["k"], [42, 42], trees=40)[0].score(x) == same.score(x)).all()
    got = {r["factory_id"]: r for r in models.seed_stability(cloud, forests, "factory_id", COLUMNS, ["k"]).collect()}
    assert got["a"]["n"] == 300 and 0.6 < got["a"]["stability"] <= 1 and got["b"]["stability"] < got["a"]["stability"] and got["c"]["stability"] is None
    ones = models.seed_stability(cloud, [same, same], "factory_id", COLUMNS, ["k"])
    mean = models.mean_stability(ones).first()
    assert mean["factories"] == 2 and mean["mean_stability"] == pytest.approx(1)
    assert {r["n"] for r in models.seed_stability(cloud, forests, "factory_id", COLUMNS, ["k"], rows=50).collect()} == {50, 1}


def test_centres_are_weighted_and_made_of_values():
    rng = np.random.default_rng(3)
    x = np.round(np.vstack([rng.normal(0, 0.1, (300, 2)), rng.normal(10, 0.1, (100, 2))]), 3)
    rows, share = models.centres(x, 2)
    assert sorted(share) == [0.25, 0.75] and all(v in x[:, c] for r in rows for c, v in enumerate(r))
    rows, share = models.centres(np.array([[1.0, 2.0]] * 3 + [[3.0, 4.0]]), 30)
    assert sorted(map(tuple, rows)) == [(1.0, 2.0), (3.0, 4.0)] and sorted(share) == [0.25, 0.75]
    assert share.sum() == 1 and models.centres(x, 30)[1].sum() == pytest.approx(1) and len(models.centres(x, 30)[0]) <= 30


def exact(of, row, base, share):
    """Shapley values by all orders."""
    k = len(row)
    value = lambda s: float(of(np.where([i in s for i in range(k)], row, base)) @ share)
    out = np.zeros(k)
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        for n in range(k):
            for s in itertools.combinations(rest, n):
                out[i] += math.factorial(n) * math.factorial(k - n - 1) / math.factorial(k) * (value({*s, i}) - value(set(s)))
    return out


def test_kernel_shares_are_exact_for_few_features(spark, cloud):
    model = models.fit_isolation_forest(cloud, COLUMNS, ["k"], trees=20)
    base, share = models.background_of(cloud, model, COLUMNS, ["k"], clusters=12)
    assert len(base) <= 12 and share.sum() == pytest.approx(1)
    x = np.array([[9.0, 0.0, -7.0, 1.0], [0.0, 0.0, 0.0, 0.0]])
    mask, weight = models.coalitions(4, 100, np.random.default_rng(0))
    assert len(mask) == 14
    got = models.shapley(model.score, x, base, share, mask, weight)
    for row, phi in zip(x, got):
        assert phi == pytest.approx(exact(model.score, row, base, share), abs=1e-8)
        assert phi.sum() == pytest.approx(model.score(row[None])[0] - model.score(base) @ share)
    out = models.kernel_attribution(cloud, model, "factory_id", COLUMNS, ["k"], rows=20, background=12)
    sums = {r["factory_id"]: r["s"] for r in out.groupBy("factory_id").agg(F.sum("shap").alias("s")).collect()}
    assert sums["c"] == pytest.approx(model.score(np.zeros((1, 4)))[0] - model.score(base) @ share)


def test_drawn_coalitions_still_sum_to_the_score():
    rng = np.random.default_rng(5)
    model = models.IsolationForest(trees=10).fit(rng.normal(size=(300, 12)))
    base, share = models.centres(rng.normal(size=(200, 12)), 10)
    mask, weight = models.coalitions(12, 100, rng)
    assert 80 < len(mask) <= 100
    x = rng.normal(size=(3, 12))
    assert models.shapley(model.score, x, base, share, mask, weight).sum(1) == pytest.approx(model.score(x) - model.score(base) @ share)


@pytest.fixture(scope="module")
def year(spark):
    t = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 900).cast("timestamp_ntz")
    base = spark.range(366 * 96).select(t.alias("timestamp"))
    series_of = spark.createDataFrame([("f1", "ETP-pH"), ("f1", "ETP-BOD"), ("f1", "ETP-COD"), ("f2", "ETP-pH")], "factory_id string, parameter_id string")
    rows = base.crossJoin(F.broadcast(series_of)).select("factory_id", "parameter_id", "timestamp", F.lit(100.0).alias("value"))
    return rows.withColumn("row", F.xxhash64("factory_id", "parameter_id", "timestamp")).withColumn("tamper_type", F.when((F.col("factory_id") == "f1") & (F.dayofyear("timestamp") == 1), "IMPOSSIBLE PH RANGE"))


def test_drawn_events_do_not_overlap(spark, year):
    at = lambda m, d, h=0: dt.datetime(2024, m, d, h)
    given = spark.createDataFrame([("f1", "ETP-BOD", "FLATLINE", at(1, 1), at(5, 30), "low"), ("f1", "ETP-COD", "BDL GAMING", at(9, 1), at(9, 2), "low"), ("f1", None, "FLATLINE", at(1, 1), at(12, 31), "low"), ("f1", "ETP-COD", "IMPOSSIBLE PH RANGE", at(3, 1), at(3, 2), "low")], inject.LABELS)
    drawn = inject.draw_labels(year, given).collect()
    again = inject.draw_labels(year.repartition(5), given).collect()
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, again))
    assert Counter((r["factory_id"], r["tamper_type"]) for r in drawn) == {(f, k): n for f in ("f1", "f2") for k, n in (("BDL GAMING", 4), ("NEGATIVE VALUES", 4), ("DUPLICATE RUN", 16))}
    spans = [(r["factory_id"], r["parameter_id"], r["start_timestamp"], r["end_timestamp"]) for r in [*drawn, *given.filter("parameter_id is not null").collect()]]
    for a, b in itertools.combinations(spans, 2):
        assert a[:2] != b[:2] or a[3] < b[2] or b[3] < a[2] or (a in [tuple(g)[:2] + tuple(g)[3:5] for g in given.collect()] and b in [tuple(g)[:2] + tuple(g)[3:5] for g in given.collect()])
    for r in drawn:
        _, least, most, days, starts, spares = inject.EVENTS[r["tamper_type"]]
        steps = (r["end_timestamp"] - r["start_timestamp"]) / dt.timedelta(minutes=15) + 1
        assert least <= steps <= most and r["start_timestamp"].minute % 15 == 0
        assert not (spares and r["factory_id"] == "f1" and r["parameter_id"] == "ETP-pH")
        assert any(dt.datetime(2024, m, d) <= r["start_timestamp"] < dt.datetime(2024, m, d) + dt.timedelta(days=days + 1) for m, d in starts)
    # without room, events are left out
    full = spark.createDataFrame([("f2", "ETP-pH", "FLATLINE", at(1, 1), dt.datetime(2025, 1, 1), "low")], inject.LABELS)
    assert {r["factory_id"] for r in inject.draw_labels(year, full).collect()} == {"f1"}


def test_injected_readings(spark, year):
    given = spark.createDataFrame([("f1", "ETP-COD", "IMPOSSIBLE PH RANGE", dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 2), "low"), ("f1", "ETP-COD", "DUPLICATE RUN", dt.datetime(2024, 4, 1), dt.datetime(2024, 4, 2), "low")], inject.LABELS)
    drawn = inject.draw_labels(year, given)
    rows, labels = inject.inject_events(year, given, drawn, "row")
    assert Counter(r["tamper_type"] for r in labels.collect()) == {"NEGATIVE VALUES": 9, "BDL GAMING": 8, "DUPLICATE RUN": 32}  # the earlier injection is gone, the other label renamed
    rows = rows.cache()
    assert rows.count() == year.count() and rows.filter("tamper_type = 'IMPOSSIBLE PH RANGE'").count() == 0
    quiet = rows.filter("tamper_type is null").agg(F.avg((F.col("quality_code") == "L").cast("double")), F.max(F.when(F.col("quality_code") == "L", F.col("value")))).first()
    assert 0.006 < quiet[0] < 0.010 and quiet[1] < 0.05
    events = [r.asDict() for r in drawn.collect()]
    for e in events[::4]:
        inside = rows.filter((F.col("factory_id") == e["factory_id"]) & (F.col("parameter_id") == e["parameter_id"]) & F.col("timestamp").between(e["start_timestamp"], e["end_timestamp"])).collect()
        assert {r["tamper_type"] for r in inside} == {e["tamper_type"]}
        values, low = [r["value"] for r in inside], [r for r in inside if r["quality_code"] == "L"]
        if e["tamper_type"] == "BDL GAMING":
            assert len(low) >= int(0.85 * len(inside)) and all(0 <= r["value"] < 0.05 for r in low)
        elif e["tamper_type"] == "NEGATIVE VALUES":
            assert all(-50 <= v <= -2 for v in values) and not low and len(set(values)) > 1
        else:
            assert len(set(values)) == 1 and 10 <= values[0] <= 85 and not low
    again, _ = inject.inject_events(year.repartition(7), given, drawn, "row")
    assert rows.exceptAll(again).count() == 0
    rows.unpersist()


def test_stream_of_runs_equals_the_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = []
    for name in ("p", "q"):
        for k in range(60):
            v = None if rng.random() < 0.05 else float(rng.integers(0, 3)) if name == "p" else float(rng.normal())
            rows.append(("f", name, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * k), v))
    kind = "factory_id string, parameter_id string, timestamp timestamp, value double"
    for part in range(4):  # files in order of time, rows of a file in any
        rng.shuffle(own := [r for r in rows if part * 15 <= (r[2].hour * 4 + r[2].minute // 15) < part * 15 + 15])
        spark.createDataFrame(own, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = series.run_and_lag(stream, lag=6).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    got = {(r["parameter_id"], r["timestamp"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    df = spark.createDataFrame(rows, kind).withColumn("quality_code", F.lit("Raw"))
    batch = windows.autocorrelation(windows.run_length(df, windows.series()), FeatureConfig(lag_rows=6), windows.series()).collect()
    assert len(got) == len(batch) == 120
    for r in batch:
        g = got[r["parameter_id"], r["timestamp"]]
        assert g["duplicate_run_length"] == r["duplicate_run_length"] and g["value"] == r["value"]
        assert g["autocorrelation"] == pytest.approx(r["autocorrelation"]) if r["autocorrelation"] is not None else g["autocorrelation"] is None


def test_a_late_reading_is_left_out():
    t = [dt.datetime(2024, 1, 1, h) for h in range(4)]
    state, out = series._advance((0.0, None, None, []), [t[0], t[2], t[1], t[3]], [1.0, 1.0, 5.0, 1.0], 2)
    assert [(o[0], o[2]) for o in out] == [(t[0], 1.0), (t[2], 2.0), (t[3], 3.0)] and state[3] == [1.0, 1.0, 1.0]
