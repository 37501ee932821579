"""Scans by name, exact rounding, dates and regions, read views, and the sinks, on constructed files and rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice.functions import numeric, scalars
from sluice.operators import joins, profile, risk
from sluice.plans import views
from sluice.sources import sinks, telemetry

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_telemetry_by_name_in_any_order(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("timestamp,extra,value,quality_code,parameter_id,factory_id\n2024-01-01 00:00:00,1,1.5,Raw,p,f\n2024-01-01 00:15:00,2,x,L,p,f\n2024-01-01 00:30:00,3,2,Error,p,g\n")
    rows, report = telemetry.read_telemetry(spark, str(f))
    assert [(r["factory_id"], r["value"]) for r in rows.orderBy("timestamp").collect()] == [("f", 1.5), ("f", None)]
    assert {r["factory_id"]: r["error_rate"] for r in report.collect()} == {"f": 0.0, "g": 1.0}
    f.write_text("timestamp,value,parameter_id,factory_id\n2024-01-01 00:00:00,1.5,p,f\n")
    with pytest.raises(ValueError, match="quality_code"):
        telemetry.read_telemetry(spark, str(f))


def test_limits_by_name(spark, tmp_path):
    f = tmp_path / "l.csv"
    f.write_text("maximum_limit,unit,minimum_limit,factory_id,parameter\n30,mg/l,x,f1,BOD\n,pH,5.5,f1,pH\n")
    rows = {r["parameter_id"]: r for r in telemetry.read_limits(spark, str(f)).collect()}
    assert (rows["BOD"]["factory_id"], rows["BOD"]["lower_limit"], rows["BOD"]["upper_limit"], rows["BOD"]["unit"], rows["BOD"]["id"]) == ("f1", None, 30.0, "mg/l", None)
    assert (rows["pH"]["lower_limit"], rows["pH"]["upper_limit"]) == (5.5, None)
    f.write_text("factory_id,parameter,minimum_limit\nf,p,1\n")
    with pytest.raises(ValueError, match="maximum_limit"):
        telemetry.read_limits(spark, str(f))


def test_synthetic_readings_and_labels(spark, tmp_path):
    (tmp_path / "m.csv").write_text("factory_id,timestamp,value,parameter_id\nf,2024-01-01 00:00:00,,p\nf,2024-01-01 00:15:00,2,p\n")
    (tmp_path / "l.csv").write_text(
        "severity,factory_id,parameter_id,tamper_type,start_timestamp,end_timestamp\nlow,f,p,A,2024-01-01 00:00:00,2024-01-01 01:00:00\nhigh,f,,B,2024-01-01 00:15:00,2024-01-01 00:15:00\n"
    )
    rows, labels = telemetry.read_synthetic(spark, str(tmp_path / "m.csv"), str(tmp_path / "l.csv"))
    assert [(r["quality_code"], r["is_valid"]) for r in rows.orderBy("timestamp").collect()] == [("Raw", False), ("Raw", True)]
    out = joins.label_intervals(rows, labels, ["timestamp"])
    assert [r["tamper_type"] for r in out.orderBy("timestamp").collect()] == ["A", "B"]


def test_reference_tables_prefer_the_second_version(spark, tmp_path):
    for k in ("coverage", "quality", "statistics", "parameter"):
        (tmp_path / f"dataset_{k}_summary.csv").write_text("factory_id,v\nf,1\n")
    (tmp_path / "dataset_quality_summary_v2.csv").write_text("factory_id,v\nf,2\n")
    spark.range(3).write.parquet(str(tmp_path / "real_features.parquet"))
    got = telemetry.read_reference(spark, str(tmp_path))
    assert {k: t.first()["v"] for k, t in got.items() if k != "features"} == {"coverage": "1", "quality": "2", "statistics": "1", "parameter": "1"} and got["features"].count() == 3
    (tmp_path / "dataset_coverage_summary.csv").unlink()
    with pytest.raises(FileNotFoundError):
        telemetry.read_reference(spark, str(tmp_path))


def test_rounding_by_exact_values(spark):
    values = [0.15, 2.675, 0.25, 0.35, 1.005, -0.15, -2.5, 2.5, 3.5, 0.0, 1e17, 44.125, 1234567.8905] + [k / 200 + 0.0025 for k in range(-400, 400)] + [k / 16 for k in range(-64, 64)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3):
        assert [r[0] for r in df.select(numeric.half_even(F.col("x"), digits)).collect()] == [round(v, digits) for v in values]
    assert one(spark, numeric.half_even(F.lit(None).cast("double"), 1)) is None


@pytest.mark.parametrize(
    ("text", "day"),
    [("January 5, 2026", D(2026, 1, 5)), ("Jan 5, 2026", D(2026, 1, 5)), (" december 25,  2025 ", D(2025, 12, 25)), ("2026-01-05", D(2026, 1, 5)), ("05-01-2026", D(2026, 1, 5)), ("on 05.01.2026.", D(2026, 1, 5)), ("5th of May", None), (None, None), ("February 30, 2026", None)],
)
def test_dates_in_texts(spark, text, day):
    assert one(spark, scalars.any_date(F.lit(text).cast("string"))) == day


@pytest.mark.parametrize(
    ("text", "region"), [("A. Rao (FO-Tarapur I)", "Tarapur I"), ("(SRO - Thane II)", "Thane II"), ("x (RO Pune) (y)", "Pune"), ("(ro-)", ""), ("none", None), ("(- Mahad)", "Mahad"), (None, None)]
)
def test_offices_lose_their_prefix(spark, text, region):
    assert one(spark, scalars.office(F.lit(text).cast("string"))) == region
    assert one(spark, scalars.region(F.lit("Office (FO-Tarapur I)"))) == "Tarapur I"


def test_districts_and_areas(spark):
    assert [one(spark, scalars.district(F.lit(x))) for x in ("Dist: Thane", "DISTRICT palghar 401", "no word")] == ["Thane", "palghar", None]
    assert [one(spark, scalars.industrial_area(F.lit(x))) for x in ("Plot 1, MIDC Tarapur-2", "Taloja MIDC, x", "midc  mahad", "none")] == ["Tarapur-2", "Taloja", "mahad", None]


def test_chunks_of_spans(spark):
    spans = spark.createDataFrame([("a", D(2024, 1, 30), D(2024, 2, 10)), ("b", D(2024, 1, 1), D(2024, 1, 1)), ("c", D(2024, 1, 2), D(2024, 1, 1)), ("d", None, D(2024, 1, 1))], "k string, a date, b date")
    got = [tuple(r) for r in telemetry.chunks(spans, "a", "b").select("k", "start", "end").orderBy("k", "start").collect()]
    assert got == [("a", D(2024, 1, 30), D(2024, 2, 5)), ("a", D(2024, 2, 6), D(2024, 2, 10)), ("b", D(2024, 1, 1), D(2024, 1, 1))]


def test_overlaps_meet_once(spark):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [(1, "g", t(1), t(5)), (2, "g", t(2, 12), t(9)), (3, "g", t(5), t(5)), (4, "g", t(5, 1), t(6)), (5, "h", t(1), t(9)), (6, "g", t(8), t(7)), (7, "g", None, t(9)), (8, None, t(1), t(9))]
    got = joins.overlapping(spark.createDataFrame(rows, "k int, g string, s timestamp_ntz, e timestamp_ntz"), "k", "g", "s", "e").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 3), (2, 3), (2, 4)]


def scores(spark):
    return spark.createDataFrame([("a", 80.0, "CRITICAL", 0.5, 6.0, -30.0, 1), ("b", 30.0, "MEDIUM", 0.2, 0.0, None, None), ("c", 30.0, "odd", 0.1, 0.0, 1.0, 0)], "factory_id string, risk_score double, risk_category string, anomaly_norm double, flatline double, inspection_dip double, trig_coordinated_missing_data int").withColumns(
        {k: F.lit(0.0) for k in ("copy_paste", "limit_hugging", "impossible_ph_range")}
    )


def test_views_of_factories_without_entries(spark):
    s = scores(spark)
    names = spark.createDataFrame([("a", "Alpha", "Mahad", "Dyes")], "factory_id string, name string, region string, industry string")
    view = views.score_view(s.select("factory_id", "risk_score", "risk_category", "anomaly_norm"), s.filter("factory_id <> 'c'"), names)
    rows = {r["factory_id"]: r for r in view.collect()}
    assert (rows["a"]["rank"], rows["a"]["risk_tier"], rows["a"]["true_risk_category"], rows["a"]["flatline_rate"], rows["a"]["region"]) == (1, "High", "CRITICAL", 0.06, "Mahad")
    assert (rows["b"]["rank"], rows["b"]["name"], rows["b"]["region"], rows["b"]["pre_dip_mean"], rows["b"]["coordinated_missing_flag"]) == (2, "Industrial Site b", "Taloja", 0.0, 0)
    assert (rows["c"]["risk_tier"], rows["c"]["flatline_rate"], rows["c"]["bod_cod_vol_mean"]) == ("Low", None, None)
    assert views.summary(view).first()[:] == (3, 1, 1, 1)
    assert [r["factory_id"] for r in views.listing(view, sort="name").collect()] == ["a", "b", "c"] and views.listing(view, "MAHAD", "high").count() == 1
    assert views.admin_listing(view, " ", "All industries").count() == 3 and views.admin_listing(view, "taloja", None).count() == 2
    assert {r["factory_id"]: r["tag"] for r in views.tagged(view).collect()} == {"a": "Critical", "b": "Routine", "c": "Routine"}
    assert [(r["factory_id"], r["priority"]) for r in views.dispatch_queue(view, 2).collect()] == [("a", "CRITICAL - IMMEDIATE UNANNOUNCED AUDIT"), ("b", "HIGH - MANDATE SENSOR CALIBRATION")]
    quality = spark.createDataFrame([("a", 60.0, 50.0, 2)], "factory_id string, coverage_percentage double, readiness_score double, parameter_count int")
    means = spark.createDataFrame([("a", "ETP-BOD", 3.5)], "factory_id string, parameter_id string, mean double")
    page = {r["factory_id"]: r for r in views.details(view, quality, means, view.filter("factory_id = 'b'"), {"avg_bod": "ETP-BOD"}).collect()}
    assert (page["a"]["missing_percentage"], page["a"]["avg_bod"], page["a"]["context_warning"], page["b"]["coverage_percentage"], page["b"]["has_cto_context"]) == (40.0, 3.5, None, 92.5, False)
    assert page["a"]["note"] == "Risk score is being driven by fingerprint checks: flatline, coordinated missing data." and page["b"]["note"] is None
    stability = spark.createDataFrame([("a", 0.99)], "factory_id string, stability double")
    assert {r["factory_id"]: r["seed_stability_index"] for r in views.predictions(view, stability).collect()} == {"a": 0.99, "b": 0.942, "c": 0.942}


def test_defaults_and_fallback(spark):
    limits = views.default_limits(spark).collect()
    assert len(limits) == 7 and [r["category"] for r in limits] == sorted(r["category"] for r in limits) and views.default_thresholds(spark).count() == 4
    static = spark.createDataFrame([("a", "A", "x"), ("b", "B", "y")], "k string, name string, region string")
    live = spark.createDataFrame([("a", "new", None), ("c", "C", "z")], "k string, name string, region string")
    assert sorted(map(tuple, views.with_fallback(static, live, "k").collect())) == [("a", "new", "x"), ("b", "B", "y"), ("c", "C", "z")]
    assert views.with_fallback(static, None, "k").count() == 2


def test_profile_of_an_expected_number(spark):
    parts = [spark.createDataFrame([("a", i), ("b", i)], f"factory_id string, v{i} int") for i in range(4)]
    assert views.factory_profile(parts, 2).columns == ["factory_id", "v0", "v1", "v2", "v3"]
    with pytest.raises(ValueError, match="2 factories, 33 expected"):
        views.factory_profile(parts, 33)
    both = views.joined(parts[0].withColumn("n", F.lit(1)), parts[1].withColumn("n", F.lit(2)), "factory_id")
    assert both.columns == ["factory_id", "v0", "n", "v1", "n_fp"]


def test_alert_and_check_texts(spark):
    rows = scores(spark).withColumns({"total_fingerprints_triggered": F.lit(3), "recommended_action": F.lit("Act.")})
    got = risk.alerts(rows, spark.createDataFrame([("a", "Alpha")], "factory_id string, name string")).collect()
    assert [r["message"] for r in got] == ["Alpha triggered 3 tampering fingerprints. Act."] and got[0]["alert_type"] == "Tamper Fingerprint Triggered"
    assert risk.alerts(rows).first()["message"].startswith("a triggered")
    full = rows.withColumns({k: F.lit(-0.5) for k in ("correlation_break", "coordinated_missing_data", "data_integrity")} | {f"trig_{k}": F.lit(0) for k in risk.CHECKS})
    told = {r["key"]: r["threshold_desc"] for r in risk.checks(full.withColumn("threshold", F.lit(-0.12345)).filter("factory_id = 'a'")).collect()}
    assert told["correlation_break"] == "< -0.1235 (dataset mean - 1 std dev)" and told["flatline"] == "> 5.0% of readings"
    told = {r["key"]: r["threshold_desc"] for r in risk.checks(full.withColumn("threshold", F.lit(None).cast("double"))).collect()}
    assert told["correlation_break"] == risk.NO_THRESHOLD


def test_quality_summary_counts_visits_by_name(spark):
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * k)
    rows = spark.createDataFrame([("a", "p", at(0), 1.0), ("a", "p", at(1), None), ("a", "p", at(5), -1.0)], "factory_id string, parameter_id string, timestamp timestamp_ntz, value double")
    limits = spark.createDataFrame([("a", "p")], "factory_id string, parameter_id string")
    visits = spark.createDataFrame([("Acme works unit 2",), ("ACME Unit-2 (x)",), ("Acme unit 3",)], "factory_name string")
    factories = spark.createDataFrame([("a", "M/s Acme Pvt Ltd Unit 2", "Dyes"), ("b", "Other Works", "Metal")], "factory_id string, name string, category string")
    got = {r["factory_id"]: r for r in profile.quality_summary(rows, limits, visits, factories=factories).collect()}
    a, b = got["a"], got["b"]
    assert (a["inspections"], a["inspection_schedule_available"], a["cto_available"], a["missing_intervals"], a["factory_name"], a["industry_category"]) == (2, True, True, 3, "M/s Acme Pvt Ltd Unit 2", "Dyes")
    assert (b["inspections"], b["inspection_schedule_available"], b["cto_available"], b["total_records"], b["expected_records"], b["coverage_percentage"], b["quality_grade"], b["parameter_count"]) == (0, False, False, 0, 0, 0.0, "F", 0)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", dt.datetime(2024, 1, 1, 0, 15), 1.5), ("a", "q", dt.datetime(2024, 1, 1), 2.0), ("b", "p", dt.datetime(2024, 1, 1), 3.0)], "factory_id string, parameter_id string, timestamp timestamp_ntz, value double")
    sinks.export_by_factory(rows, ["p", "q"], str(tmp_path / "x"))
    lines = [x.read_text().splitlines() for x in (tmp_path / "x" / "factory_id=a").glob("*.csv")]
    assert lines == [["time,p,q", '2024-01-01 00:00,"",2.0', '2024-01-01 00:15,1.5,""']] or lines == [["time,p,q", "2024-01-01 00:00,,2.0", "2024-01-01 00:15,1.5,"]]
    nested = rows.select("factory_id", F.struct("value", "parameter_id").alias("s"))
    sinks.write_json(nested, str(tmp_path / "j"))
    back = sinks.read_json(spark, str(tmp_path / "j"), "factory_id string, s struct<value: double, parameter_id: string>")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, nested.collect()))
    path = str(tmp_path / "t")
    sinks.replace_slice(rows, path, "parameter_id")
    sinks.replace_slice(rows.filter("factory_id = 'b'"), path, "parameter_id")  # only p is replaced
    assert sorted((r["factory_id"], r["parameter_id"]) for r in spark.read.parquet(path).collect()) == [("a", "q"), ("b", "p")]
    for _ in range(2):
        sinks.append_log(rows.limit(1), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
