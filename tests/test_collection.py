"""The collecting side: coverage, HTML and document tables, names, constraints, keys and runs, on constructed rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import coverage, names
from sluice.plans import collector
from sluice.sources import constraints, html, limit_tables, sinks

D = dt.date


# -- coverage ----------------------------------------------------------------------------------------------------


def readings(spark, times, factory="f", parameter="p"):
    return spark.createDataFrame([(factory, parameter, t) for t in times], "factory_id string, parameter_id string, timestamp timestamp_ntz")


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def test_gap_sessions_of_a_hand_made_day(spark):
    # two runs: 00:00-01:00 (5 slots, one of them twice, one off the grid) and 03:15-03:30; then one slot a day later
    times = [at(1, 0, 0), at(1, 0, 15), at(1, 0, 15), at(1, 0, 31, 7), at(1, 0, 45), at(1, 1, 0), at(1, 3, 15), at(1, 3, 30), at(3, 3, 30), None]
    r = coverage.gap_summary(readings(spark, times)).first()
    assert (r["expected_records"], r["missing_records"], r["missing_intervals"]) == (288, 280, 280)
    assert (r["missing_percentage"], r["missing_days"]) == (97.22, 2.92)
    assert (r["longest_missing_duration"], r["largest_continuous_offline"], r["largest_continuous_online"]) == (48.0, 48.0, 1.25)
    assert r["avg_gap_duration"] == (135 + 2880) / 2 and r["outage_count"] == 2
    assert r["gap_distribution"] == {"0-15m": 5, "15m-1h": 0, "1h-6h": 1, "6h-24h": 0, ">24h": 1}
    assert r["online_hours"] == pytest.approx(72 * (1 - 0.9722))


def test_gap_class_bounds_are_closed_above(spark):
    starts, t = [at(1)], at(1)
    for minutes in (15, 30, 60, 75, 360, 375, 1440, 1455):
        t += dt.timedelta(minutes=minutes)
        starts.append(t)
    r = coverage.gap_summary(readings(spark, starts)).first()
    assert r["gap_distribution"] == {"0-15m": 1, "15m-1h": 2, "1h-6h": 2, "6h-24h": 2, ">24h": 1} and r["outage_count"] == 4


def test_one_reading_and_none(spark):
    r = coverage.gap_summary(readings(spark, [at(1, 5)])).first()
    assert (r["missing_records"], r["largest_continuous_online"], r["longest_missing_duration"], r["avg_gap_duration"], r["outage_count"]) == (95, 0.25, None, None, 0)
    assert coverage.gap_summary(readings(spark, [])).count() == coverage.calendar_summary(readings(spark, [])).count() == 0
    c = coverage.calendar_summary(readings(spark, [at(1, 5)])).first()
    assert (c["max_interval"], c["monitoring_duration"], c["hourly_coverage"][5], c["monthly_coverage"][1]) == (None, 0.0, 100.0, 100.0)
    with pytest.raises(ValueError):
        coverage.gap_summary(readings(spark, []), minutes=7)


def test_calendar_of_two_whole_weeks(spark):
    every = [at(1) + dt.timedelta(minutes=15 * k) for k in range(14 * 96)]
    r = coverage.calendar_summary(readings(spark, every)).first()
    assert all(r[c] == pytest.approx(100) for c in ("weekend_coverage", "weekday_coverage", "night_coverage", "business_hours_coverage", "timestamp_consistency"))
    assert sum(r["hourly_coverage"].values()) == pytest.approx(100, abs=0.2) and r["monthly_coverage"] == {1: 100.0} | dict.fromkeys(range(2, 13), 0.0)
    assert (r["avg_interval"], r["min_interval"], r["max_interval"], r["monitoring_duration"]) == (15, 15, 15, 13.99)
    # 1 January 2024 was a Monday; without its two weekends, nights and half of the readings off the grid by a second
    some = [t + dt.timedelta(seconds=t.minute // 15 % 2) for t in every if t.weekday() < 5 and 6 <= t.hour < 22]
    r = coverage.calendar_summary(readings(spark, some)).first()
    assert r["weekend_coverage"] == 0 and r["night_coverage"] == 0 and r["timestamp_consistency"] == 50
    assert r["weekday_coverage"] == pytest.approx(100 * 10 * 64 / (12 * 96 * 5 / 7)) and r["business_hours_coverage"] == pytest.approx(100 * 10 * 36 / (12 * 36))


def test_coverage_by_other_keys_counts_a_slot_once(spark):
    both = readings(spark, [at(1), at(1, 0, 15)]).union(readings(spark, [at(1), at(1, 0, 30)], parameter="q"))
    assert coverage.gap_summary(both, ["factory_id"]).first()["missing_records"] == 93
    assert coverage.gap_summary(both).count() == 2


# -- HTML --------------------------------------------------------------------------------------------------------


def test_schedule_rows_carry_the_date_over_a_span(spark):
    td = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    rest = ["Acme &amp; Sons", "Plot 7, Tarapur MIDC, District Palghar", "MPCB<br>High Risk", "A. B. Rao (FO-Tarapur I)", "022"]
    page = "<table><thead><tr><th>x</th></tr></thead><tbody>" + td("0", *rest) + td("1", " January 5, 2026 ", *rest) + td("2", *rest[:2], "", "No office", "") + td("short", "row") + td("3", "Feb 30, 2026", *rest) + td("4", *rest) + "</tbody></table>"
    lazy = "<TABLE><TR><TD>1<TD>05-01-2026<TD>a<TD>MIDC Mahad<TD>HQ<p>Routine</p><TD>x (SRO - Thane) (y)<TD>z<TR><TD>2<TD>b<TD>c<TD>d<TD>(RO)<TD>f</TABLE>"
    pages = spark.createDataFrame([(1, page), (2, lazy), (3, None), (4, "no rows"), (5, "<!-- <tr><td>1</td></tr> --><script>'<tr><td>2'</script>")], "id int, html string")
    rows = html.table_rows(pages, ["id"])
    assert [(r.id, r.row, len(r.cells)) for r in rows.orderBy("id", "row").collect()] == [(1, 1, 6), (1, 2, 7), (1, 3, 6), (1, 4, 2), (1, 5, 7), (1, 6, 6), (2, 0, 7), (2, 1, 6)]
    today = D(2030, 1, 1)
    got = {(r["id"], r["row"]): r for r in html.inspection_rows(rows, ["id"], F.lit(today)).collect()}
    assert {k: r["inspection_date"] for k, r in got.items()} == {(1, 1): today, (1, 2): D(2026, 1, 5), (1, 3): D(2026, 1, 5), (1, 5): today, (1, 6): today, (2, 0): D(2026, 1, 5), (2, 1): D(2026, 1, 5)}
    r = got[1, 2]
    assert (r["factory_name"], r["region"], r["district"], r["midc"], r["officer_name"], r["inspection_dept"], r["inspection_type"], r["contact_details"], r["status"]) == ("Acme & Sons", "Tarapur I", "Palghar", "Tarapur", "A. B. Rao", "MPCB", "High Risk", "022", "Scheduled")
    r = got[1, 3]
    assert (r["inspection_dept"], r["inspection_type"], r["region"], r["officer_name"]) == ("MPCB", "Standard", None, "No office")
    r = got[2, 0]
    assert (r["midc"], r["region"], r["inspection_dept"], r["inspection_type"], r["officer_name"]) == ("Mahad", "Thane", "HQ", "Routine", "x")


def test_inner_text(spark):
    t = html.inner_text(F.lit(" a\n\t b<br/> <br>c &lt;d&gt; &amp;lt; <i>e</i>&nbsp;f</p> "))
    assert spark.range(1).select(t.alias("t")).first()["t"] == "a b\nc <d> &lt; e f"


# -- tables of documents -------------------------------------------------------------------------------------------


def test_limits_of_extracted_tables(spark):
    tables = [
        ("a", 1, [["Parameter", "Standard", "Unit"], ["pH", "5.5 to 9.0", None], ["BOD (3 days)", "not to exceed  100", "mg/l"], ["Oil & Grease", "10", ""], ["SO2", "100", "kg/day"], ["Remarks", "5", "x"]]),
        ("a", 2, [["Sr", "Parameters"], ["1", "TSS", "max", "1,000 - 2,000 mg/ Nm3", "30 KLD"], ["2", " total   cod\nmg/l ", "250"], ["COD", "nil"], ["3", "phosphated", "7"]]),
        ("b", 1, [["pH", "7"]]),  # one row is no table
        ("b", 2, [["x", "1"], ["y", "2"]]),  # no parameter
        ("b", 3, [["bod", "cod", "30"], [None, None]]),  # the first naming cell counts, the second holds no digit
        ("b", 4, None),
    ]
    got = limit_tables.limit_rows(spark.createDataFrame(tables, "factory_id string, n int, cells array<array<string>>"), ["factory_id", "n"])
    rows = sorted((r["factory_id"], r["n"], r["row"], r["parameter"], r["minimum_limit"], r["maximum_limit"], r["unit"], r["condition_text"]) for r in got.collect())
    assert rows == [
        ("a", 1, 1, "pH", 5.5, 9.0, "pH", "5.5 to 9.0"), ("a", 1, 2, "BOD (3 days)", None, 100.0, "mg/l", "not to exceed 100"), ("a", 1, 3, "Oil & Grease", None, 10.0, "mg/l", "10"), ("a", 1, 4, "SO2", None, 100.0, "mg/Nm3", "100"),
        ("a", 2, 1, "TSS", 1000.0, 30.0, "KLD", "30 KLD"), ("a", 2, 2, "total cod mg/l", None, 250.0, "mg/l", "250"), ("b", 3, 0, "bod", None, 30.0, "mg/l", "30"),
    ]
    assert {r["extraction_confidence"] for r in got.collect()} == {0.95}


# -- names ---------------------------------------------------------------------------------------------------------


def test_visits_by_name(spark):
    factories = [(1, "M/s Acme Chemicals Pvt Ltd Unit-2"), (2, "ACME (old) Limited"), (3, "Ltd Co"), (4, None), (5, "Acme Dyes"), (6, "acmex"), (7, "Beta-Gamma unit – III"), (8, "Unit 5")]
    visits = ["M/s. ACME CHEMICALS UNIT 2", "Acme, unit 3", "acme_dyes", "Acme dyes & acme", "beta gamma iii", "Gamma-Beta Unit-III", "Gamma-Beta Unit-III", None, "unit 5", "acme2 dyes"]
    got = names.visits_by_name(spark.createDataFrame(factories, "id int, name string"), spark.createDataFrame([(v,) for v in visits], "n string"), "id", "name", "n")
    assert {r["id"]: r["visits"] for r in got.collect()} == {1: 1, 2: 3, 3: 0, 4: 0, 5: 1, 6: 0, 7: 3, 8: 0}


def test_visits_by_name_equal_a_nested_loop(spark):
    rng = random.Random(8)
    words = [a + b for a in ("al", "be", "ga", "de") for b in ("pha", "ta", "mma", "lta", "x")]
    f = [(k, " ".join(rng.choices(words, k=rng.randint(1, 3)))) for k in range(60)]
    v = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(400)]
    got = names.visits_by_name(spark.createDataFrame(f, "id int, name string"), spark.createDataFrame([(x,) for x in v], "n string"), "id", "name", "n")
    want = {k: sum(set(w for w in n.split() if len(w) > 2) <= set(x.split()) for x in v) for k, n in f}
    assert {r["id"]: r["visits"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# -- constraints, keys ----------------------------------------------------------------------------------------------


def test_checked_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    parent = spark.createDataFrame([("f1",), ("f2",)], "site string")
    rules = constraints.Constraints(primary=["id"], unique=[["number"]], not_null=["factory"], references=[constraints.Reference(["factory"], parent, ["site"])], defaults={"tables": 0})
    kind = "id int, number string, factory string"
    constraints.write_checked(spark.createDataFrame([(1, "a", "f1"), (2, None, "f2"), (3, None, "f2")], kind), path, rules)  # nulls are not equal
    assert spark.read.parquet(path).agg(F.sum("tables"), F.count("*")).first()[:] == (0, 3)
    bad = spark.createDataFrame([(3, "b", "f1"), (4, "a", "f1"), (5, "c", None), (6, "d", "f9"), (None, "e", "f1")], kind)
    with pytest.raises(constraints.ConstraintError) as e:
        constraints.write_checked(bad, path, rules)
    assert e.value.counts == {"primary key (id)": 2, "unique (number)": 2, "not null (id)": 1, "not null (factory)": 1, "foreign key (factory)": 1}
    assert spark.read.parquet(path).count() == 3
    assert constraints.violations(bad.limit(0), rules).count() == constraints.violations(bad, constraints.Constraints()).count() == 0
    told = {(r["constraint"], r["columns"], r["key"], r["rows"]) for r in constraints.violations(bad, rules).collect()}
    assert told == {("not null", "id", "NULL", 1), ("not null", "factory", "NULL", 1), ("foreign key", "factory", "f9", 1)}


def test_upsert_returns_ids_that_do_not_depend_on_partitions(spark):
    old = spark.createDataFrame([(10, "a", 1.0, "x"), (12, "b", 2.0, "y")], "id long, k string, v double, only_old string")
    new = spark.createDataFrame([("b", 5.0, 1), ("b", 6.0, 2), ("c", 7.0, 1)] + [(f"n{i}", float(i), 1) for i in range(500)], "k string, v double, n int")
    seen = []
    for parts in (1, 3, 7):
        written, returned = sinks.upsert_returning(old, new.repartition(parts), ["k"], order=["n"])
        seen.append(sorted((r["k"], r["id"], r["inserted"]) for r in returned.collect()))
        rows = {r["k"]: r for r in written.collect()}
        assert len(rows) == 503 and (rows["a"]["id"], rows["a"]["v"], rows["a"]["only_old"]) == (10, 1.0, "x")
        assert (rows["b"]["id"], rows["b"]["v"], rows["b"]["only_old"]) == (12, 6.0, None)
    assert seen[0] == seen[1] == seen[2]
    assert sorted(i for _, i, fresh in seen[0] if fresh) == list(range(13, 13 + 501))  # no gaps, after the highest
    again, returned = sinks.upsert_returning(written.select("id", "k", "v"), new, ["k"])
    assert {(r["k"], r["id"], r["inserted"]) for r in returned.collect()} == {(k, i, False) for k, i, _ in seen[0]}
    none, returned = sinks.upsert_returning(old.limit(0), new.filter("k = 'c'"), ["k"])
    assert [tuple(r) for r in returned.collect()] == [("c", 1, True)]


def test_insert_ignore_keeps_the_first_and_counts(spark):
    old = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "late"), (2, "early"), (2, "early"), (3, None), (None, "n"), (None, "m")], "k int, v string")
    assert sorted((tuple(r) for r in sinks.insert_ignore(old, new, ["k"], ["v"]).filter("k > 0").collect()), key=str) == [(2, "early"), (3, None)]
    assert tuple(sinks.insert_counts(old, new, ["k"]).first()) == (7, 4, 3)
    assert tuple(sinks.insert_counts(old, new.limit(0), ["k"]).first()) == (0, 0, 0)


# -- collector ---------------------------------------------------------------------------------------------------------


def test_a_run_gives_each_factory_one_state(spark):
    t = lambda *xs: spark.createDataFrame([(x,) for x in xs], "consent_number string")
    factories = spark.createDataFrame([(k,) for k in "abcdefgh"], "factory_id string")
    mapping = spark.createDataFrame([(k, f"n{k}") for k in "abcdefg"] + [("a", "zz"), ("h", None)], "factory_id string, consent_number string")
    states = collector.run(factories, mapping, t("na", "na"), t("na", "nb"), t("nb", "nd", "ne", "nf"), t("nd", "ne"), t("nd", "nd"))
    got = {r["factory_id"]: r["status"] for r in states.collect()}
    assert got == {"a": "SKIPPED_DB_EXISTS", "b": "SUCCESS_CACHED", "c": "FAILED_SEARCH", "d": "SUCCESS_LIVE", "e": "FAILED_DOWNLOAD", "f": "FAILED_RESOLVING", "g": "FAILED_SEARCH", "h": "FAILED_MAPPING"}
    limits = spark.createDataFrame([("nb", 1, 1), ("nb", 1, 1), ("nb", 1, 2), ("na", 1, 1)], "consent_number string, page_number int, table_number int")
    log = {r["factory_id"]: r for r in collector.log(states, limits).collect()}
    assert len(log) == 8 and (log["b"]["tables_detected"], log["b"]["limits_extracted"], log["b"]["pdf_downloaded"]) == (2, 3, True)
    assert (log["a"]["limits_extracted"], log["a"]["error_message"], log["h"]["error_message"]) == (0, None, "Failed to resolve consent number via CMS live search")
    assert {r["factory_id"] for r in collector.new_rows(states).collect()} == {"b", "d"}
    only_cache = collector.run(factories, mapping, t(), t("nc"), t(), t(), t()).groupBy("status").count()
    assert {r["status"]: r["count"] for r in only_cache.collect()} == {"SUCCESS_CACHED": 1, "FAILED_SEARCH": 6, "FAILED_MAPPING": 1}
