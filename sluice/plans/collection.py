"""Registered queries of the collecting side: coverage of the grid, HTML and document tables, names, keys, runs.  Beside each the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import coverage, names
from ..sources import constraints, html, limit_tables, sinks
from . import collector
from .catalogue import clean, query, rounded, table

_SLOTS = "SELECT factory_id, parameter_id, epoch_us(timestamp) // 900000000 AS slot, count(*) AS n, count(*) FILTER (epoch_us(timestamp) % 900000000 = 0) AS grid FROM clean GROUP BY ALL"
_STEPS = f"SELECT *, slot - lag(slot) OVER (PARTITION BY factory_id, parameter_id ORDER BY slot) AS step FROM ({_SLOTS})"


# -- coverage ----------------------------------------------------------------------------------------------------


@query(
    f"""SELECT factory_id, parameter_id, expected_records, missing_records, round(100 * missing_records / expected_records, 2) AS missing_percentage, round(missing_records / 96, 2) AS missing_days, missing_records AS missing_intervals,
    longest AS longest_missing_duration, round(avg_gap, 4) AS avg_gap_duration, online AS largest_continuous_online, longest AS largest_continuous_offline,
    round(expected_records / 4 * (1 - round(100 * missing_records / expected_records, 2) / 100), 4) AS online_hours, outage_count, c1, c2, c3, c4, c5
    FROM (SELECT factory_id, parameter_id, (max(slot // 96) - min(slot // 96) + 1) * 96 AS expected_records, (max(slot // 96) - min(slot // 96) + 1) * 96 - count(*) AS missing_records, max(step) FILTER (step > 1) / 4 AS longest,
    avg(step * 15) FILTER (step > 1) AS avg_gap, max(run_length) / 4 AS online, count(*) FILTER (step * 15 > 120) AS outage_count, count(*) FILTER (step = 1) AS c1, count(*) FILTER (step > 1 AND step <= 4) AS c2,
    count(*) FILTER (step > 4 AND step <= 24) AS c3, count(*) FILTER (step > 24 AND step <= 96) AS c4, count(*) FILTER (step > 96) AS c5
    FROM (SELECT *, count(*) OVER (PARTITION BY factory_id, parameter_id, slot - place) AS run_length FROM (SELECT *, row_number() OVER (PARTITION BY factory_id, parameter_id ORDER BY slot) AS place FROM ({_STEPS}))) GROUP BY 1, 2)""", "clean")  # fmt: skip
def gap_sessions(spark, d):
    out = coverage.gap_summary(clean(spark, d))
    classes = [F.element_at("gap_distribution", name).alias(f"c{k}") for k, (name, _) in enumerate(coverage.GAP_CLASSES, 1)]
    return out.select(*out.columns, *classes).drop("gap_distribution").withColumns({c: F.round(c, 4) for c in ("avg_gap_duration", "online_hours")})


_CAL = f"""SELECT *, (slot // 96 + 3) % 7 >= 5 AS free, slot % 96 // 4 AS hour, month(DATE '1970-01-01' + CAST(slot // 96 AS INTEGER)) AS month FROM ({_STEPS})"""
_PART = lambda c, part: f"round(100 * count(*) FILTER ({c}) / ((max(slot // 96) - min(slot // 96) + 1) * 96 * {part} / {24 if part not in (2, 5) else 7}), 4)"


@query(
    f"""SELECT *, round(date_diff('microsecond', earliest_reading, latest_reading) // 1000000 / 86400, 2) AS monitoring_duration FROM (SELECT factory_id, parameter_id, quantile_cont(step, 0.5) * 15 AS avg_interval, 15 AS expected_interval, max(step) * 15 AS max_interval,
    min(step) * 15 AS min_interval, round(100 * sum(grid) / sum(n), 4) AS timestamp_consistency, {_PART('free', 2)} AS weekend_coverage, {_PART('NOT free', 5)} AS weekday_coverage,
    {_PART('hour >= 22 OR hour < 6', 8)} AS night_coverage, {_PART('hour BETWEEN 9 AND 17', 9)} AS business_hours_coverage FROM ({_CAL}) GROUP BY 1, 2)
    JOIN (SELECT factory_id, parameter_id, min(timestamp) AS earliest_reading, max(timestamp) AS latest_reading FROM clean GROUP BY 1, 2) USING (factory_id, parameter_id)""", "clean")  # fmt: skip
def calendar_coverage(spark, d):
    out = coverage.calendar_summary(clean(spark, d)).drop("monthly_coverage", "hourly_coverage")
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.endswith("_coverage") or c == "timestamp_consistency"})


@query(
    f"""SELECT * FROM (WITH c AS ({_CAL}) SELECT factory_id, parameter_id, kind, CAST(part AS INTEGER) AS part, round(100 * (SELECT count(*) FROM c WHERE c.factory_id = f.factory_id AND c.parameter_id = f.parameter_id AND CASE kind WHEN 'month' THEN c.month ELSE c.hour END = part) / total, 2) AS share
    FROM (SELECT factory_id, parameter_id, count(*) AS total FROM c GROUP BY 1, 2) f, (SELECT 'month' AS kind, unnest(range(1, 13)) AS part UNION ALL SELECT 'hour', unnest(range(24))))""", "clean")  # fmt: skip
def calendar_shares(spark, d):
    out = coverage.calendar_summary(clean(spark, d))
    kinds = [out.select("factory_id", "parameter_id", F.lit(kind).alias("kind"), F.explode(column).alias("part", "share")) for kind, column in (("month", "monthly_coverage"), ("hour", "hourly_coverage"))]
    return kinds[0].unionByName(kinds[1])


# -- pages and documents ------------------------------------------------------------------------------------------


@query(
    r"""SELECT page_id, CAST(row AS INTEGER) AS row, len(cells) AS cells, array_to_string(cells, '|') AS texts FROM (SELECT page_id, unnest(range(len(u))) AS row, unnest(list_transform(u, lambda x: list_transform(regexp_extract_all(x, '(?s)<li[^>]*>(.*?)</li>', 1),
    lambda y: trim(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(y, '\s+', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))))) AS cells
    FROM (SELECT page_id, regexp_extract_all(html, '(?s)<ul[^>]*>(.*?)</ul>', 1) AS u FROM pages)) WHERE len(cells) > 0""")  # fmt: skip
def page_lists(spark, d):
    rows = html.table_rows(table(spark, d, "pages"), ["page_id"], row="ul", cell="li")
    return rows.select("page_id", "row", F.size("cells").cast("long").alias("cells"), F.array_join("cells", "|").alias("texts"))


_OFFICES = ["(SRO-Tarapur I)", "(FO - Thane II)", "(RO Pune)", "", "(Mahad)"]


def schedule_pages(spark, d):
    """A page for each customer whose table lists the orders by month; only the first row of a month has a cell for it."""
    o = table(spark, d, "orders").withColumn("day", F.trunc("o_orderdate", "month"))
    w = W.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    opens = F.coalesce(F.lag("day").over(w) != F.col("day"), F.lit(True))
    k, td = F.col("o_orderkey"), lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    date = F.when(k % 3 == 0, F.date_format("day", "MMM d, yyyy")).when(k % 3 == 1, F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "MMMM d, yyyy"))
    dept = F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("HQ")).otherwise(F.concat(F.lit("HQ <br/>\n "), F.col("o_orderpriority")))
    cells = [
        F.when(opens, td(F.lit("\n "), date)).otherwise(""), td(F.lit("M/s A &amp; "), F.col("o_orderstatus")), td(F.lit("Plot "), k.cast("string"), F.lit(", <b>MIDC</b> Area"), (k % 7).cast("string"), F.lit(", Dist: Thane")), td(dept),
        td(F.lit(" Officer "), (k % 9).cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, _OFFICES)), (k % 5 + 1).cast("int"))), td(F.lit("tel&nbsp;"), k.cast("string")),
    ]
    rows = o.select("o_custkey", F.struct("day", "o_orderkey", F.concat(F.lit('<TR class="x">'), td(k.cast("string")), *cells, F.lit("</TR>")).alias("h")).alias("r"))
    page = F.concat(F.lit("<html><!-- <tr><td>no</td></tr> --><table><thead><tr><th>No</th></tr></thead><tbody>"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"]), "\n"), F.lit("</tbody></table></html>"))
    return rows.groupBy("o_custkey").agg(page.alias("html"))


@query(
    """SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY date_trunc('month', o_orderdate), o_orderkey) AS INTEGER) AS row, 'M/s A & ' || o_orderstatus AS factory_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS inspection_date,
    CASE WHEN o_orderkey % 4 < 2 THEN 'Standard' ELSE o_orderpriority END AS inspection_type, CASE o_orderkey % 5 WHEN 0 THEN 'Tarapur I' WHEN 1 THEN 'Thane II' WHEN 2 THEN 'Pune' WHEN 4 THEN 'Mahad' END AS region, 'Thane' AS district,
    'Area' || (o_orderkey % 7) AS midc, 'Officer ' || (o_orderkey % 9) AS officer_name, 'Scheduled' AS status, 'Plot ' || o_orderkey || ', MIDC Area' || (o_orderkey % 7) || ', Dist: Thane' AS address,
    CASE WHEN o_orderkey % 4 = 0 THEN 'MPCB' ELSE 'HQ' END AS inspection_dept, 'tel ' || o_orderkey AS contact_details FROM orders""")  # fmt: skip
def schedule_rows(spark, d):
    rows = html.table_rows(schedule_pages(spark, d), ["o_custkey"])
    return html.inspection_rows(rows, ["o_custkey"])


_PARAMS = ["pH", "BOD (3 days)", "Total COD mg/l", "SO2", "flow", "Remarks"]


def extracted_tables(spark, d):
    """A table of three or four cells a row for each order, as if taken from a document."""
    n, q, p = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_partkey")
    name = F.element_at(F.array(*map(F.lit, _PARAMS)), (p % 6 + 1).cast("int"))
    text = F.when(p % 5 == 0, F.concat(q, F.lit(" to "), q + 2)).when(p % 5 == 1, F.concat(F.lit("not to exceed  "), q)).when(p % 5 == 2, F.concat(F.lit("1,"), F.lpad(q.cast("int").cast("string"), 3, "0"))).when(p % 5 == 3, F.lit("Nil"))
    cells = F.array(F.concat(F.lit("row "), F.lit(" \n")), name, text, F.when(p % 4 == 0, F.lit("KLD")).when(p % 4 == 1, F.lit("mg/ l")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), p.alias("p"), q.alias("q"), cells.alias("c")))).alias("r"))
    return rows.select("l_orderkey", F.transform("r", lambda x: x["c"]).alias("cells"))


@query(
    """SELECT l_orderkey, CAST(row AS INTEGER) AS row, parameter, minimum_limit, maximum_limit, CASE WHEN parameter = 'SO2' THEN 'mg/Nm3' WHEN p % 4 = 0 THEN 'KLD' WHEN p % 4 = 1 THEN 'mg/l' WHEN parameter = 'pH' THEN 'pH' ELSE 'mg/l' END AS unit, condition_text, CAST(0.95 AS DOUBLE) AS extraction_confidence
    FROM (SELECT l_orderkey, l_partkey AS p, row_number() OVER w - 1 AS row, CASE l_partkey % 6 WHEN 0 THEN 'pH' WHEN 1 THEN 'BOD (3 days)' WHEN 2 THEN 'Total COD mg/l' WHEN 3 THEN 'SO2' WHEN 4 THEN 'flow' END AS parameter,
    CASE l_partkey % 5 WHEN 0 THEN l_quantity END AS minimum_limit, CASE l_partkey % 5 WHEN 0 THEN l_quantity + 2 WHEN 1 THEN l_quantity WHEN 2 THEN 1000 + l_quantity END AS maximum_limit,
    CASE l_partkey % 5 WHEN 0 THEN l_quantity || ' to ' || (l_quantity + 2) WHEN 1 THEN 'not to exceed ' || l_quantity WHEN 2 THEN '1,' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 3, '0') END AS condition_text,
    count(*) OVER (PARTITION BY l_orderkey) AS rows FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)) WHERE rows >= 2 AND parameter IS NOT NULL AND maximum_limit IS NOT NULL""")  # fmt: skip
def document_limits(spark, d):
    return limit_tables.limit_rows(extracted_tables(spark, d), ["l_orderkey"])


# -- names, keys, runs ----------------------------------------------------------------------------------------------


def _visits(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    return l.select(F.concat(F.lit("M/s. "), F.initcap("p_name"), F.lit(" "), "p_type", F.lit(" Pvt.Ltd Unit-"), (F.col("l_linenumber") % 3).cast("string"), F.lit("x")).alias("visited"))


@query(
    r"""WITH v AS (SELECT list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' unit ' || (l_linenumber % 3) || 'x'), '[^\w]+'), lambda x: x <> '') AS words, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT p_partkey, CAST(coalesce((SELECT sum(n) FROM v WHERE list_has_all(words, list_filter(regexp_split_to_array(lower(p_name), '\s+'), lambda x: length(x) > 2)) AND (p_partkey % 3 > 0 OR list_contains(words, (p_partkey % 4) || 'x'))), 0) AS BIGINT) AS visits FROM part""")  # fmt: skip
def visits_by_name(spark, d):
    unit = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" unit - "), (F.col("p_partkey") % 4).cast("string"), F.lit("X"))).otherwise("")
    factories = table(spark, d, "part").withColumn("name", F.concat(F.lit("M/s "), "p_name", F.lit(" (old name) Private Limited"), unit))
    return names.visits_by_name(factories, _visits(spark, d), "p_partkey", "name", "visited")


@query(
    """SELECT 'primary key' AS "constraint", 'l_orderkey, l_partkey' AS "columns", l_orderkey || '|' || l_partkey AS key, count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1
    UNION ALL SELECT 'unique', 'l_orderkey, l_shipdate', l_orderkey || '|' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), count(*) FROM lineitem GROUP BY l_orderkey, l_shipdate HAVING count(*) > 1
    UNION ALL SELECT 'not null', 'late', 'NULL', count(*) FROM lineitem WHERE l_quantity <= 10 HAVING count(*) > 0
    UNION ALL SELECT 'foreign key', 'l_partkey', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY l_partkey
    UNION ALL SELECT 'foreign key', 'l_orderkey', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY l_orderkey""")  # fmt: skip
def constraint_violations(spark, d):
    rows = table(spark, d, "lineitem").withColumn("late", F.when(F.col("l_quantity") > 10, F.col("l_quantity")))
    parents = [constraints.Reference(["l_partkey"], table(spark, d, "part").filter("p_size > 5"), ["p_partkey"]), constraints.Reference(["l_orderkey"], table(spark, d, "orders").filter("o_orderstatus <> 'F'"), ["o_orderkey"])]
    return constraints.violations(rows, constraints.Constraints(primary=["l_orderkey", "l_partkey"], unique=[["l_orderkey", "l_shipdate"]], not_null=["late"], references=parents))


@query(
    """SELECT k, v, CASE WHEN old IS NOT NULL THEN old ELSE 1000 + (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (PARTITION BY old IS NULL ORDER BY k % 64, k) END AS id, old IS NULL AS inserted FROM (
    SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v, any_value(s_suppkey) + 1000 AS old FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey GROUP BY 1)""")  # fmt: skip
def upsert_ids(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") + 1000).alias("id"), F.col("s_acctbal").alias("v"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey")
    written, returned = sinks.upsert_returning(old, new, ["k"], order=["o_orderkey"], bucket=F.col("k") % 64)
    return returned.join(written.select("k", "v"), "k").select("k", "v", "id", "inserted")


@query(
    """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)) WHERE n = 1""")  # fmt: skip
def insert_first(spark, d):
    return sinks.insert_ignore(table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), table(spark, d, "lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query(
    """SELECT count(*) AS received, count(DISTINCT l_partkey) FILTER (p_partkey IS NULL) AS inserted, count(*) - count(DISTINCT l_partkey) FILTER (p_partkey IS NULL) AS skipped FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON p_partkey = l_partkey""")  # fmt: skip
def insert_report(spark, d):
    return sinks.insert_counts(table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), table(spark, d, "lineitem"), ["l_partkey"])


def collector_states(spark, d):
    """Customers as factories; their first order as the consent, orders and lines as what the store, the cache and the portal hold."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    number = lambda df, c: df.select(F.concat(F.lit("C-"), F.lpad(F.col(c).cast("string"), 8, "0")).alias(collector.KEY))
    mapping = o.filter("o_orderstatus <> 'P' or o_orderkey % 3 = 0").select(F.col("o_custkey").alias("factory_id"), F.concat(F.lit("C-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias(collector.KEY))
    states = collector.run(
        table(spark, d, "customer").select(F.col("c_custkey").alias("factory_id")), mapping, number(o.filter("o_orderpriority = '5-LOW'"), "o_orderkey"), number(l.filter("l_discount = 0.05"), "l_orderkey"),
        number(o.filter("o_orderpriority <> '1-URGENT'"), "o_orderkey"), number(l.filter("l_returnflag = 'R'"), "l_orderkey"), number(l.filter("l_tax > 0.03"), "l_orderkey"),
    )
    limits = l.select(F.concat(F.lit("C-"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")).alias(collector.KEY), (F.col("l_linenumber") % 2).alias("page_number"), (F.col("l_partkey") % 2).alias("table_number"))
    return states, limits


_RUN = """SELECT c_custkey AS factory_id, CASE WHEN k IS NOT NULL THEN 'C-' || lpad(CAST(k AS VARCHAR), 8, '0') END AS consent_number, CASE WHEN k IS NULL THEN 'FAILED_MAPPING' WHEN o_orderpriority = '5-LOW' THEN 'SKIPPED_DB_EXISTS' WHEN coalesce(cached, false) THEN 'SUCCESS_CACHED'
    WHEN o_orderpriority = '1-URGENT' THEN 'FAILED_SEARCH' WHEN NOT coalesce(resolved, false) THEN 'FAILED_RESOLVING' WHEN coalesce(fetched, false) THEN 'SUCCESS_LIVE' ELSE 'FAILED_DOWNLOAD' END AS status, coalesce(tables, 0) AS tables, coalesce(n, 0) AS n
    FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 3 = 0 GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN orders o ON o.o_orderkey = k
    LEFT JOIN (SELECT l_orderkey, bool_or(l_discount = 0.05) AS cached, bool_or(l_returnflag = 'R') AS resolved, bool_or(l_tax > 0.03) AS fetched, count(DISTINCT (l_linenumber % 2) * 2 + l_partkey % 2) AS tables, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = k"""
_FACTS = f"""SELECT factory_id, consent_number, status, status LIKE 'SUCCESS%' AS pdf_downloaded, CASE WHEN status LIKE 'SUCCESS%' THEN tables ELSE 0 END AS tables_detected, CASE WHEN status LIKE 'SUCCESS%' THEN n ELSE 0 END AS limits_extracted FROM ({_RUN})"""


@query(
    f"""SELECT *, CASE status WHEN 'FAILED_MAPPING' THEN 'Failed to resolve consent number via CMS live search' WHEN 'FAILED_SEARCH' THEN 'Failed to locate consent row in live MPCB CMS search' WHEN 'FAILED_RESOLVING' THEN 'Failed to resolve direct PDF URL from blockchain document page'
    WHEN 'FAILED_DOWNLOAD' THEN 'Failed to download PDF binary from resolved blockchain link' END AS error_message FROM ({_FACTS})""")  # fmt: skip
def collector_log(spark, d):
    return collector.log(*collector_states(spark, d))


@query(f"SELECT status, count(*) AS factories, CAST(sum(limits_extracted) AS BIGINT) AS limits FROM ({_FACTS}) GROUP BY 1")
def collector_summary(spark, d):
    return collector.log(*collector_states(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("factories"), F.sum("limits_extracted").alias("limits"))
