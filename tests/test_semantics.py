"""Nulls, ties, frames and guards of the telemetry operators, on tiny frames."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.config import FeatureConfig, rows_of
from sluice.functions import numeric, scalars
from sluice.operators import aggregates, fingerprints, inject, joins, models, profile, risk, windows
from sluice.plans import feature_matrix
from sluice.sources import sinks, telemetry

SCHEMA = "factory_id string, parameter_id string, t int, value double, quality_code string"


def readings(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(*r[:3], None if r[3] is None else float(r[3]), r[4]) for r in rows], schema)
    return df.withColumn("timestamp", F.timestamp_seconds(F.lit(1704067200) + F.col("t") * 900).cast("timestamp_ntz"))


def series(spark, values, codes=None, p="p"):
    return readings(spark, [("f", p, i, v, (codes or {}).get(i, "Raw")) for i, v in enumerate(values)])


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_window_sizes():
    assert [rows_of(x) for x in ("2H", "24h", "7D", "30min")] == [8, 96, 672, 2]
    with pytest.raises(ValueError):
        rows_of("soon")


def test_quality_report_counts_null_codes_as_dropped(spark):
    df = readings(spark, [("f", "p", 0, 1.0, "Raw"), ("f", "p", 1, 1.0, None), ("f", "p", 2, 1.0, "O"), ("f", "p", 3, 1.0, "L")])
    assert telemetry.quality_report(df).first()[1:] == (4, 2, 2, 0.5)
    assert telemetry.quality_filter(df).count() == 2


def test_rolling_needs_full_frames(spark):
    v = [1.0, 2, 3, 4, 5, 6, 7, 8, None, 10]
    out = windows.rolling_stats(series(spark, v), FeatureConfig(), windows.series())
    assert column(out, "rolling_mean") == [None] * 7 + [4.5, None, None]
    assert column(out, "rolling_std")[7] == pytest.approx(np.std(v[:8], ddof=1))
    zero = windows.rolling_stats(series(spark, [1.0, -1.0] * 4), FeatureConfig(), windows.series())
    assert column(zero, "rolling_cov")[7] is None


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(6)], "t int, a double, b double")
    from pyspark.sql import Window as W

    w = W.orderBy("t").rowsBetween(-2, 0)
    assert {r.r for r in df.select(numeric.pearson(F.col("a"), F.col("b"), w, 3).alias("r")).collect()} == {None}
    out = [r.r for r in df.select("t", numeric.pearson(F.col("b"), F.col("b"), w, 3).alias("r")).orderBy("t").collect()]
    assert out[:2] == [None, None] and all(abs(x - 1) < 1e-12 for x in out[2:])


def test_flatline_rules_differ_on_nulls(spark):
    v = [5.0] * 8 + [None] + [1.0, 9, 2, 8, 3, 7, 4, 6, 5, 1, 9, 2]
    measured = column(windows.flatline_measured(series(spark, v), FeatureConfig(), windows.series()), "flatline_flag")
    fixed = column(windows.flatline_fixed(series(spark, v), FeatureConfig(), windows.series()), "flatline_flag")
    assert measured[:7] == fixed[:7] == [None] * 7
    assert measured[7] == fixed[7] == 1.0
    assert measured[8] is None and fixed[8] == 0.0


def test_runs_and_rates(spark):
    v = [1.0, 1.0, None, None, 2.0, 2.0, 2.0]
    assert column(windows.run_length(series(spark, v), windows.series()), "duplicate_run_length") == [1, 2, 1, 1, 1, 2, 3]
    out = windows.rates(series(spark, v, {0: "L", 4: None}), FeatureConfig(rate_rows=4), windows.series())
    assert column(out, "missing_rate") == [None] * 3 + [50.0, 50.0, 50.0, 25.0]
    assert column(out, "bdl_rate") == [None] * 3 + [25.0, 0.0, 0.0, 0.0]


def test_limit_hugging_null_value_is_zero(spark):
    lim = spark.createDataFrame([("f", "p", 10.0, None), ("f", "q", None, 1.0)], "factory_id string, parameter_id string, upper_limit double, lower_limit double")
    df = series(spark, [9.6, None, 5.0, 11.0]).unionByName(series(spark, [1.0], p="q"))
    out = windows.limit_hugging(df, lim, FeatureConfig())
    assert [r.limit_hugging for r in out.orderBy("parameter_id", "t").collect()] == [1.0, 0.0, 0.0, 0.0, None]


def test_pivot_refuses_duplicates(spark):
    df = readings(spark, [("f", "p", 0, 1.0, "Raw"), ("f", "p", 0, 2.0, "Raw")])
    with pytest.raises(Exception, match="duplicate reading"):
        windows.wide(df, ("p",)).collect()


def test_percentages_and_medians(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 0.0), ("b", None)], "g string, flag double")
    out = dict(df.groupBy("g").agg(numeric.percent_of(F.col("flag") == 1, F.col("flag")).alias("x")).collect())
    assert out == {"a": 0.0, "b": 50.0}
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double")
    assert {r.z for r in aggregates.from_median(same, "v", "z").collect()} == {0.0}


def test_label_intervals_last_one_wins(spark):
    df = series(spark, [1.0] * 4)
    lab = spark.createDataFrame([("f", "p", "a", 0, 2, "low", 1), ("f", None, "b", 1, 1, "high", 2)], "factory_id string, parameter_id string, tamper_type string, s int, e int, severity string, label_order int")
    at = lambda c: F.timestamp_seconds(F.lit(1704067200) + F.col(c) * 900).cast("timestamp_ntz")
    out = joins.label_intervals(df, lab.withColumns({"start_timestamp": at("s"), "end_timestamp": at("e")}), ["t"])
    assert column(out, "tamper_type") == ["a", "b", "a", None]
    assert column(out, "n_labels") == [1, 2, 1, 0] and column(out, "is_tampered") == [True, True, True, False]


def test_as_of_is_strict(spark):
    left = spark.sql("select 'f' as factory_id, timestamp_ntz'2024-01-02 00:00:00' as at union all select 'g', timestamp_ntz'2024-01-02 00:00:00'")
    right = spark.sql("select 'f' as factory_id, timestamp_ntz'2024-01-02 00:00:00' as ts union all select 'f', timestamp_ntz'2024-01-01 00:00:00'")
    out = {r.factory_id: r.latest for r in joins.as_of_before(left, right, "factory_id", "at", "ts", "latest").collect()}
    assert str(out["f"])[:10] == "2024-01-01" and out["g"] is None


def test_inspection_dip(spark):
    rows = [("f", "p", i, 100.0 if i < 96 * 27 else 50.0, "Raw") for i in range(0, 96 * 30, 12)]
    visits = spark.sql("select 'f' as factory_id, date'2024-01-31' as inspection_date, 'Completed' as status union all select 'f', date'2024-01-10', 'Scheduled'")
    assert fingerprints.inspection_dip(readings(spark, rows), visits).first().inspection_dip == pytest.approx(-50.0)


def test_triggers_and_risk(spark):
    cols = ", ".join(f"{k} double" for k in fingerprints.ORDER)
    df = spark.createDataFrame([("a", 0.1, -30.0, 6.0, 6.0, -1.0, 2.0, 2.0, 2.0, 0.0, 0.9, -0.7), ("b", 0.0, None, 0.0, 0.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, -0.3)], f"factory_id string, {cols}, threshold double, probability double, anomaly_score double")
    out = risk.composite(fingerprints.triggers(df)).orderBy("factory_id").collect()
    assert [r.total_fingerprints_triggered for r in out] == [8, 0]
    assert [r.risk_category for r in out] == ["CRITICAL", "LOW"] and out[0].risk_score == pytest.approx(99.0) and out[1].triggered_fingerprints == []


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("factory_id,parameter_id,timestamp,value,quality_code\nf,p,2024-01-01 00:00:00,1.5,Raw\nf,p,2024-01-01 00:15:00,x,L\nf,p,2024-01-01 00:30:00,2,Error\n")
    got, report = telemetry.read_telemetry(spark, str(tmp_path / "t.csv"))
    assert [r.value for r in got.orderBy("timestamp").collect()] == [1.5, None] and report.first().error_rate == pytest.approx(0.3333)
    (tmp_path / "bad.csv").write_text("factory_id,parameter_id,timestamp,value,quality_code\nf,p,yesterday,1.5,Raw\n")
    with pytest.raises(Exception, match="not a time stamp"):
        telemetry.read_telemetry(spark, str(tmp_path / "bad.csv"))[0].collect()
    (tmp_path / "x_v2.csv").write_text("")
    assert telemetry.versioned(spark, str(tmp_path), "x").endswith("x_v2.csv")
    with pytest.raises(FileNotFoundError):
        telemetry.versioned(spark, str(tmp_path), "y")
    assert telemetry.with_defaults(got.drop("quality_code")).filter("is_valid").count() == 1
    sinks.write_features(got, str(tmp_path / "features"))
    sinks.write_csv(report, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "features")).count() == 2
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "id int, v string, w int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["id"]).collect())) == [(1, "a", None), (2, "c", 1), (3, "d", 1)]
    assert [r.id for r in sinks.insert_ignore(old, new.select("id", "v"), ["id"]).collect()] == [3]
    assert sinks.replace_children(old, new, "id").count() == 3
    body = spark.createDataFrame([("eyJwYXJhbWV0ZXJEZXRhaWxzIjp7ImJvZHlDb250ZW50IjpbeyJhIjoxfSx7ImEiOjJ9XX19",)], "b string")
    assert [r.a for r in telemetry.decode_response(body, "b", "struct<a:int>").collect()] == [1, 2]


def test_profile(spark):
    health = spark.createDataFrame([(10.0, 5.0, 50.0, 150, 20.0), (0.0, 0.0, 0.0, 30, None), (None, 0.0, 0.0, 0, 0.0)], "missing_percentage double, duplicate_percentage double, zero_percentage double, number_of_outages int, other double")
    score = [r.sensor_health_score for r in profile.sensor_health(health).collect()]
    assert score[:2] == pytest.approx([1 - 0.04 - 0.01 - 0.1 - 0.2, 1 - 0.06]) and score[2] is None
    with pytest.raises(KeyError):
        profile.sensor_health(health.drop("number_of_outages"))
    v = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 1.0), ("c", 3.0, 2.0)], "k string, x double, y double")
    assert profile.most_similar(profile.standardised(v, ["x", "y"], "k"), "k").count() == 6
    day = spark.sql("select 'f' as factory_id, 'ETP-pH' as parameter_id, timestamp_ntz'2024-01-01 00:00:00' as timestamp, 7.0D as value union all select 'f', 'ETP-pH', timestamp_ntz'2024-05-01 00:00:00', 8.0D")
    assert profile.temporal_shift(day).first()[1:] == (True, "pH: Q_min=7.00, Q_max=8.00 (shift=1.00)")
    assert profile.temporal_shift(day.limit(1)).first()[1:] == (False, "No monitored parameters with quarterly data")


def test_feature_matrix_keeps_rows(spark):
    cfg = FeatureConfig(correlation_rows=4, lag_rows=4, rate_rows=4, parameters=("ETP-BOD", "ETP-COD"))
    df = readings(spark, [("f", p, i, float((i * 7 + len(p)) % 5), "Raw") for p in ("ETP-BOD", "ETP-COD") for i in range(20)])
    lim = spark.createDataFrame([(1, "f", "bod (3 days)", 1.0, 30.0, 0.9, None), (2, "f", "BOD", 1.0, 10.0, 0.5, None)], "id int, factory_id string, parameter_id string, lower_limit double, upper_limit double, extraction_confidence double, proxy_source_factory_id string")
    own = feature_matrix.own_limits(lim)
    assert own.first().upper_limit == 30.0
    out = feature_matrix.build(df, telemetry.quality_report(df), own, cfg)
    assert out.count() == 40 and "corr_ETP-BOD_ETP-COD" in out.columns


def test_models(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(500, 2)), [[9.0, 9.0]]])
    s = models.IsolationForest(trees=50).fit(x).score(x)
    forest = models.IsolationForest(trees=5).fit(x)
    models.save_forest(spark, forest, str(tmp_path / "forest"))
    assert np.allclose(models.load_forest(spark, str(tmp_path / "forest")).score(x), forest.score(x))
    assert s.argmin() == 500 and -1 <= s.min() < s.max() <= 0
    y = (x[:, 0] > 0).astype(int)
    coef, bias = models.fit_logistic(models.standardise(x)[0], y)
    assert coef[0] > 5 * abs(coef[1]) and math.isfinite(bias)
    rows = spark.createDataFrame([(f"f{i}", float(i), int(i > 10)) for i in range(20)], "k string, a double, y int")
    out = models.leave_one_out(rows, "k", ["a"], "y")
    assert models.gates(out, 0.45).first().auc > 0.95


def test_injection_is_seeded_and_disjoint(spark):
    df = series(spark, [float(i % 17) for i in range(3000)])
    plan = inject.plan(df)
    spans = sorted((r["first"], r["last"]) for r in plan.filter("half = 1").collect())
    assert len(spans) == 12 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    one, two = (inject.inject(df.repartition(n), "t").orderBy("t").collect() for n in (1, 3))
    assert one == two and {r.tamper_type for r in one} == {None, *inject.KINDS}


def test_scalars(spark):
    df = spark.createDataFrame([("unit - mgd", 0.5), (None, None)], "s string, v double")
    out = df.select(scalars.labelled_unit(F.col("s")).alias("u"), scalars.file_name(F.lit(" a b?.pdf ")).alias("f"), scalars.header(F.lit(" My  Col ")).alias("h"), numeric.half_even(F.lit(2.5), 0).alias("r")).collect()
    assert out[0][:] == ("mgd", "a_b_.pdf", "my_col", 2.0) and out[1].u is None
    names = spark.createDataFrame([("M/s. Acme (Old) Bio-Tech Pvt. Ltd. Unit-2",), ("India Co",), (None,)], "s string")
    assert [r.t for r in names.select(scalars.name_tokens(F.col("s")).alias("t")).collect()] == [["acme", "bio", "tech"], [], None]
    cells = spark.createDataFrame([(c,) for c in ("[37.61, 'U']", "['NA', 'E']", '["NA", "E"]', "", "[x, 'U']", "[1,2,3]", None)], "s string")
    assert [r.c and tuple(r.c) for r in cells.select(scalars.cell(F.col("s")).alias("c")).collect()] == [(37.61, "U")] + [None] * 6
    limits = spark.createDataFrame([(c,) for c in ("5.5 - 9.0", "5.5 TO 9.0", "<= 250", "1,000", "N/A")], "s string")
    assert [tuple(r.c) for r in limits.select(scalars.limit_range(F.col("s")).alias("c")).collect()] == [(5.5, 9.0), (5.5, 9.0), (None, 250.0), (None, 1000.0), (None, None)]
    words = spark.createDataFrame([("Alpha Bio (P) Ltd",), ("Alphabet Bio",)], "s string")
    assert [r.w for r in words.select(scalars.has_all_words(F.col("s"), ["alpha", "bio"]).alias("w")).collect()] == [True, False]


def test_streaming(spark, tmp_path):
    from sluice.streaming import telemetry as stream

    rows = spark.sql("select 'f' as factory_id, 'p' as parameter_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,15*id) as timestamp, if(id % 5 = 0, null, double(id)) as value, 'Raw' as quality_code from range(40)")
    rows.write.parquet(str(tmp_path / "in"))
    s = stream.windowed_stats(stream.read(spark, str(tmp_path / "in"), rows.schema), size="2 hours", slide="2 hours")
    q = s.writeStream.outputMode("complete").format("memory").queryName("stats").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) n, sum(missing) m from stats").first()[:] == (40, 8)


def test_running_total_over_ranges(spark):
    v = [5.0, None, 3.0, 3.0, 9.0, -1.0, 3.0, None, 7.0]
    df = spark.createDataFrame(list(enumerate(v)), "k int, x double")
    up = sorted(range(len(v)), key=lambda i: (v[i] is not None, v[i] or 0, i))
    down = sorted(range(len(v)), key=lambda i: (v[i] is None, -(v[i] or 0), i))
    for ranges in (1, 2, 50):
        got = {r.k: r.n for r in windows.running_total(df, F.lit(1), "n", "x", ["k"], ranges=ranges).collect()}
        assert got == {k: i + 1 for i, k in enumerate(up)}
        got = {r.k: r.n for r in windows.running_total(df, F.col("k"), "n", "x", ["k"], descending=True, ranges=ranges).collect()}
        assert got == {k: sum(down[: i + 1]) for i, k in enumerate(down)}
    text = df.select("k", F.lit("a").alias("x"))
    assert [r.position for r in windows.ranks(text, "x", "k").orderBy("k").collect()] == list(range(1, 10))
    assert windows.every_kth(df.filter("k < 0"), 3, "x", ["k"]).count() == 0


def test_windows_of_days(spark):
    at = lambda s: datetime.datetime.fromisoformat(s)
    a = spark.createDataFrame([("f", 1, at("2024-01-01 23:00"), at("2024-01-03 00:00")), ("f", 2, at("2024-01-02 00:00"), at("2024-01-02 00:00")), ("g", 3, at("2024-01-02 00:00"), None)], "factory_id string, a int, s timestamp_ntz, e timestamp_ntz")
    r = spark.createDataFrame([("f", "p", at(t), 1.0) for t in ("2024-01-01 22:59", "2024-01-01 23:00", "2024-01-02 12:00", "2024-01-02 23:59:59", "2024-01-03 00:00")] + [("g", "p", at("2024-01-02 01:00"), 1.0)], "factory_id string, parameter_id string, timestamp timestamp_ntz, value double")
    assert [tuple(x) for x in joins.in_windows(a, r, ["a"], "s", "e", [F.count("value").alias("n")]).collect()] == [(1, "p", 3)]


def test_tamper_model(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(f"f{i:02}", float(x), float(x > 0.5) * 4 + float(y), int(x > 0.4)) for i, (x, y) in enumerate(rng.random((30, 2))) for _ in range(1)]
    rows = spark.createDataFrame(data, "factory_id string, a_mean double, b_std double, y int")
    model = models.fit_tamper_model(rows, ["a_mean", "b_std"], "y")
    models.save_tamper_model(spark, model, f"{tmp_path}/m")
    assert models.load_tamper_model(spark, f"{tmp_path}/m") == model
    x = np.array([r[1:3] for r in data])
    want = 1 / (1 + np.exp(-((x - model.mean) / model.scale @ model.coefficients + model.bias)))
    got = [r.p for r in rows.select("factory_id", model.probability(rows.columns).alias("p")).orderBy("factory_id").collect()]
    assert np.allclose(got, want)
    # a column that the row lacks counts as 0, as does a null
    assert rows.select(model.probability(["b_std"]).alias("p")).first().p == rows.withColumn("a_mean", F.lit(None)).select(model.probability(rows.columns).alias("p")).first().p
    one = spark.createDataFrame([("f", 2.0), ("g", 1.0), ("g", 3.0), ("h", None)], "factory_id string, v double")
    assert [tuple(r) for r in models.factory_aggregates(one, ["v"]).orderBy("factory_id").collect()] == [("f", 2.0, 0.0), ("g", 2.0, 2.0**0.5), ("h", None, 0.0)]
    assert models.complete_columns(models.factory_aggregates(one, ["v"]), ["v_mean", "v_std"]) == ["v_std"]
    with pytest.raises(ValueError):
        models.fit_tamper_model(rows, ["a_mean"], "y", most=29)


def test_gates_judge_the_order_of_triggers(spark):
    rows = spark.createDataFrame([(0.9, 1, 1), (0.8, 1, 2), (0.2, 0, 3), (0.1, 0, 4)], "probability double, label int, n int")
    assert [models.gates(rows, count=c).first().passes for c in (None, "n")] == [True, False]
    assert models.gates(rows, count="n").first().spearman == pytest.approx(-1.0)


def test_oversight_mean_is_exact(spark):
    """The scores sum to 353.0, and their mean 44.125 is a tie; summed as doubles in this order they come out above it."""
    from sluice.plans import views

    scores = [40.1, 40.2, 40.4, 40.7, 40.7, 49.5, 50.7, 50.7]
    order = next(x for x in __import__("itertools").permutations(scores) if __import__("functools").reduce(lambda a, b: a + b, x, 0.0) > 353)
    rows = [("a", x) for x in order] + [("b", 44.1), ("b", 44.2), ("b", 44.3), ("b", None), ("c", None), ("d", float("nan")), ("d", 1.0)]
    df = spark.createDataFrame(rows, "region string, tsi_score double").withColumn("risk_tier", F.lit("Low")).coalesce(1)
    got = {r.region: r.avg_tsi_score for r in views.oversight(df).collect()}
    assert (got["a"], got["b"], got["c"]) == (44.12, 44.2, 0.0) and math.isnan(got["d"])
