"""Registered queries: each applies operators of this library to whole tables, beside the same result in DuckDB's SQL.

The tables know no telemetry, so base views make some of ``events``: four sites, five parameters, quality codes,
nulls, one constant stretch.  `CTE` says the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..functions import numeric, scalars
from ..operators import aggregates, fingerprints, inject, joins, models, profile, risk, windows
from ..sources import sinks, telemetry
from . import feature_matrix, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BODY: dict[str, str] = {}
PARAMETERS = ("click", "error", "purchase", "signup", "view")
CFG = FeatureConfig(correlation_rows=12, lag_rows=24, rate_rows=192, parameters=PARAMETERS, ratio=("click", "view"))
KEY = ["factory_id", "parameter_id", "event_id"]

CTE = {
    "tel": """SELECT 'site_' || (user_id % 4) AS factory_id, event_type AS parameter_id, ts AS timestamp, event_id, k,
        CASE WHEN k % 33 = 5 THEN 'Error' WHEN k % 20 = 0 THEN 'L' ELSE 'Raw' END AS quality_code,
        CASE WHEN k = 7 THEN NULL WHEN event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' THEN 42.0 ELSE value END AS value
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "clean": "SELECT * FROM tel WHERE quality_code IN ('Raw', 'L')",
    "telb": """SELECT factory_id, parameter_id, time_bucket(INTERVAL 6 HOURS, timestamp, TIMESTAMP '2024-01-01') AS timestamp, round(avg(value), 6) AS value
        FROM clean GROUP BY ALL""",
    "lim": """SELECT factory_id, parameter_id, CASE WHEN parameter_id = 'error' THEN NULL ELSE round(quantile_cont(value, 0.9), 2) END AS upper_limit,
        CASE WHEN parameter_id = 'view' THEN NULL ELSE round(quantile_cont(value, 0.05), 2) END AS lower_limit FROM clean GROUP BY factory_id, parameter_id""",
    "insp": """SELECT DISTINCT factory_id, CAST(timestamp AS DATE) AS inspection_date, CASE WHEN k % 30 = 0 THEN 'Scheduled' ELSE 'Completed' END AS status
        FROM tel WHERE parameter_id = 'signup' AND k % 10 = 0""",
    "lab": """SELECT * FROM (VALUES ('site_0', 'click', 'bdl', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-05', 'low', 1),
        ('site_0', NULL, 'gap', TIMESTAMP '2024-01-04', TIMESTAMP '2024-01-06 12:00:00', 'high', 2), ('site_1', 'view', 'dup', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-10', 'low', 3),
        ('site_2', 'view', 'neg', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20', 'medium', 4)) t(factory_id, parameter_id, tamper_type, start_timestamp, end_timestamp, severity, label_order)""",
    "mag": """SELECT 'f' || lpad(CAST(user_id % 33 AS VARCHAR), 2, '0') AS factory_id, round(100.0 * avg(CASE WHEN value > 250 THEN 1.0 ELSE 0.0 END), 6) AS impossible_ph_range,
        CASE WHEN min(user_id) % 5 = 0 THEN NULL ELSE round(avg(CASE WHEN k % 2 = 0 THEN value ELSE -value END), 6) END AS inspection_dip,
        round(100.0 * avg(CASE WHEN value < 3 THEN 1.0 ELSE 0.0 END), 6) AS flatline, round(100.0 * avg(CASE WHEN k % 19 = 0 THEN 1.0 ELSE 0.0 END), 6) AS limit_hugging,
        CASE WHEN min(user_id) % 3 = 0 THEN NULL ELSE round(avg(CASE WHEN k % 3 = 0 THEN value ELSE -value END) / 100, 6) END AS correlation_break,
        round(100.0 * avg(CASE WHEN k % 97 = 0 THEN 1.0 ELSE 0.0 END), 6) AS copy_paste, round(100.0 * avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing,
        round(100.0 * avg(CASE WHEN quality_code = 'Error' THEN 1.0 ELSE 0.0 END), 6) AS errors, round(avg(k) / 100, 6) AS probability, round(-0.3 - avg(value) / 300, 6) AS anomaly_score
        FROM (SELECT tel.*, e.user_id FROM tel JOIN events e USING (event_id)) GROUP BY 1, user_id % 33""",
}
_NEEDS = {"clean": ["tel"], "telb": ["tel", "clean"], "lim": ["tel", "clean"], "insp": ["tel"], "mag": ["tel"]}


def sql(query: str, *ctes: str) -> str:
    names = list(dict.fromkeys(n for c in ctes for n in [*_NEEDS.get(c, []), c]))
    return ("WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names) + " " if names else "") + query


def query(text: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            BODY[f.__name__] = text
            SQL[f.__name__] = sql(text, *ctes)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    code = F.when(F.col("k") % 33 == 5, "Error").when(F.col("k") % 20 == 0, "L").otherwise("Raw")
    still = (F.col("event_type") == "click") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-13").cast("timestamp_ntz"))
    value = F.when(F.col("k") == 7, None).when(still, 42.0).otherwise(F.col("value"))
    site = F.concat(F.lit("site_"), (F.col("user_id") % 4).cast("string"))
    return e.select(site.alias("factory_id"), F.col("event_type").alias("parameter_id"), F.col("ts").alias("timestamp"), "event_id", "k", code.alias("quality_code"), value.alias("value"), "user_id")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.quality_filter(tel(spark, sf_dir))


def telb(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.expr("date_trunc('DAY', timestamp) + make_dt_interval(0, cast(floor(hour(timestamp) / 6) * 6 as int))")
    return clean(spark, sf_dir).groupBy("factory_id", "parameter_id", bucket.alias("timestamp")).agg(F.round(F.avg("value"), 6).alias("value"))


def lim(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda x: F.round(F.percentile("value", F.lit(x)), 2)
    return clean(spark, sf_dir).groupBy("factory_id", "parameter_id").agg(F.when(F.col("parameter_id") != "error", q(0.9)).alias("upper_limit"), F.when(F.col("parameter_id") != "view", q(0.05)).alias("lower_limit"))


def insp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tel(spark, sf_dir).filter((F.col("parameter_id") == "signup") & (F.col("k") % 10 == 0))
    return rows.select("factory_id", F.to_date("timestamp").alias("inspection_date"), F.when(F.col("k") % 30 == 0, "Scheduled").otherwise("Completed").alias("status")).distinct()


def lab(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """SELECT * FROM VALUES ('site_0', 'click', 'bdl', timestamp_ntz'2024-01-03 00:00:00', timestamp_ntz'2024-01-05 00:00:00', 'low', 1),
        ('site_0', NULL, 'gap', timestamp_ntz'2024-01-04 00:00:00', timestamp_ntz'2024-01-06 12:00:00', 'high', 2), ('site_1', 'view', 'dup', timestamp_ntz'2024-01-10 00:00:00', timestamp_ntz'2024-01-10 00:00:00', 'low', 3),
        ('site_2', 'view', 'neg', timestamp_ntz'2024-01-10 00:00:00', timestamp_ntz'2024-01-20 00:00:00', 'medium', 4) AS t(factory_id, parameter_id, tamper_type, start_timestamp, end_timestamp, severity, label_order)"""
    )


def mag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight magnitudes and two model outputs for each of 33 factories."""
    r, v, k = lambda c: F.round(c, 6), F.col("value"), F.col("k")
    pct = lambda c: r(F.lit(100.0) * F.avg(F.when(c, 1.0).otherwise(0.0)))
    first = F.min("user_id")
    name = F.concat(F.lit("f"), F.lpad((F.col("user_id") % 33).cast("string"), 2, "0"))
    return tel(spark, sf_dir).groupBy(name.alias("factory_id")).agg(
        pct(v > 250).alias("impossible_ph_range"), F.when(first % 5 != 0, r(F.avg(F.when(k % 2 == 0, v).otherwise(-v)))).alias("inspection_dip"), pct(v < 3).alias("flatline"), pct(k % 19 == 0).alias("limit_hugging"),
        F.when(first % 3 != 0, r(F.avg(F.when(k % 3 == 0, v).otherwise(-v)) / 100)).alias("correlation_break"), pct(k % 97 == 0).alias("copy_paste"), pct(v.isNull()).alias("missing"), pct(F.col("quality_code") == "Error").alias("errors"),
        r(F.avg("k") / 100).alias("probability"), r(-0.3 - F.avg(v) / 300).alias("anomaly_score"),
    )


def triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = aggregates.from_median(aggregates.from_median(mag(spark, sf_dir), "missing", "coordinated_missing_data"), "errors", "data_integrity")
    return fingerprints.triggers(aggregates.below_typical(m, "correlation_break"))


def ordered():
    return windows.series(["event_id"])


def rounded(df: DataFrame, keys: list[str], *columns: str, digits: int = 4) -> DataFrame:
    return df.select(*keys, *(F.round(F.col(f"`{c}`"), digits).alias(c) for c in columns))


W8 = "(PARTITION BY factory_id, parameter_id ORDER BY timestamp, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
SER = "(PARTITION BY factory_id, parameter_id ORDER BY timestamp, event_id)"

# -- scans, filters, aggregates ------------------------------------------------------------------


@query(
    """SELECT factory_id, count(*) AS total_rows, count(*) FILTER (quality_code IN ('Raw', 'L')) AS kept_rows, count(*) FILTER (quality_code NOT IN ('Raw', 'L')) AS dropped_rows,
    round(count(*) FILTER (quality_code NOT IN ('Raw', 'L')) / count(*), 4) AS error_rate FROM tel GROUP BY 1""", "tel")  # fmt: skip
def quality_report(spark, d):
    return telemetry.quality_report(tel(spark, d))


@query("SELECT factory_id, parameter_id, event_id, quality_code, value FROM clean", "clean")
def quality_filter(spark, d):
    return clean(spark, d).select(*KEY, "quality_code", "value")


@query("SELECT quality_code, count(*) AS n FROM tel GROUP BY 1", "tel")
def value_counts(spark, d):
    return aggregates.value_counts(tel(spark, d), "quality_code")


@query("SELECT round(100 * avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 2) AS value, round(100 * avg(CASE WHEN k IS NULL THEN 1.0 ELSE 0.0 END), 2) AS k FROM tel", "tel")
def null_rates(spark, d):
    return aggregates.null_rates(tel(spark, d), ["value", "k"])


@query("SELECT count(*) FILTER (isinf(o_totalprice)) AS o_totalprice FROM orders")
def infinite_counts(spark, d):
    return aggregates.infinite_counts(table(spark, d, "orders"))


@query(
    """SELECT factory_id, parameter_id, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS p25,
    round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(max(value), 4) AS max FROM clean GROUP BY 1, 2""", "clean")  # fmt: skip
def describe_value(spark, d):
    return rounded(aggregates.describe(clean(spark, d), "value", ["factory_id", "parameter_id"]), ["factory_id", "parameter_id", "n"], "mean", "std", "min", "p25", "p50", "p75", "max")


@query("SELECT factory_id, count(DISTINCT parameter_id) AS parameters, count(DISTINCT k) AS keys FROM tel GROUP BY 1", "tel")
def count_distinct(spark, d):
    return tel(spark, d).groupBy("factory_id").agg(F.count_distinct("parameter_id").alias("parameters"), F.count_distinct("k").alias("keys"))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)")
def dup_count(spark, d):
    return aggregates.surplus_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    """SELECT l_returnflag, round(avg(l_quantity) FILTER (quarter(l_shipdate) = 1), 4) AS q1, round(avg(l_quantity) FILTER (quarter(l_shipdate) = 2), 4) AS q2,
    round(avg(l_quantity) FILTER (quarter(l_shipdate) = 3), 4) AS q3, round(avg(l_quantity) FILTER (quarter(l_shipdate) = 4), 4) AS q4 FROM lineitem GROUP BY 1""")  # fmt: skip
def quarter_pivot(spark, d):
    rows = table(spark, d, "lineitem").withColumn("q", F.concat(F.lit("q"), F.quarter("l_shipdate")))
    return rounded(rows.groupBy("l_returnflag").pivot("q", ["q1", "q2", "q3", "q4"]).avg("l_quantity"), ["l_returnflag"], "q1", "q2", "q3", "q4")


@query("SELECT o_orderpriority, count(*) FILTER (month(o_orderdate) <= 6) AS H1, count(*) FILTER (month(o_orderdate) > 6) AS H2 FROM orders GROUP BY 1")
def half_year_pivot(spark, d):
    rows = table(spark, d, "orders").withColumn("half", F.when(F.month("o_orderdate") <= 6, "H1").otherwise("H2"))
    return rows.groupBy("o_orderpriority").pivot("half", ["H1", "H2"]).count().fillna(0, ["H1", "H2"])


@query("SELECT factory_id, round(avg(value), 4) AS value_mean, round(stddev_samp(value), 4) AS value_std, round(avg(k), 4) AS k_mean, round(stddev_samp(k), 4) AS k_std FROM clean GROUP BY 1", "clean")
def mean_std_wide(spark, d):
    return rounded(aggregates.mean_std_wide(clean(spark, d), ["value", "k"], "factory_id"), ["factory_id"], "value_mean", "value_std", "k_mean", "k_std")


@query(
    """SELECT factory_id, parameter_id, round(coalesce(100.0 * count(*) FILTER (value > 100) / nullif(count(value), 0), 0), 4) AS high_share FROM clean GROUP BY 1, 2""", "clean")  # fmt: skip
def pct_flags(spark, d):
    v = F.col("value")
    return clean(spark, d).groupBy("factory_id", "parameter_id").agg(F.round(numeric.percent_of(v > 100, v), 4).alias("high_share"))


@query("SELECT factory_id, round(coalesce((missing - (SELECT quantile_cont(missing, 0.5) FROM mag)) / nullif((SELECT stddev_pop(missing) FROM mag), 0), 0), 4) AS z FROM mag", "mag")
def zscore_median(spark, d):
    return rounded(aggregates.from_median(mag(spark, d), "missing", "z"), ["factory_id"], "z")


@query("SELECT factory_id, round(correlation_break, 4) AS correlation_break, round((SELECT avg(correlation_break) - stddev_pop(correlation_break) FROM mag), 4) AS threshold FROM mag", "mag")
def corr_threshold(spark, d):
    return rounded(aggregates.below_typical(mag(spark, d), "correlation_break"), ["factory_id"], "correlation_break", "threshold")


@query("SELECT factory_id FROM mag GROUP BY 1 HAVING count(inspection_dip) = 0", "mag")
def never_filled(spark, d):
    return aggregates.never_filled(mag(spark, d), "inspection_dip", "factory_id")


@query("SELECT factory_id, round(coalesce(inspection_dip, (SELECT quantile_cont(inspection_dip, 0.5) FROM mag)), 4) AS inspection_dip FROM mag", "mag")
def impute_median(spark, d):
    return rounded(aggregates.impute_median(mag(spark, d), ["inspection_dip"]), ["factory_id"], "inspection_dip")


@query(
    """SELECT g.o_orderpriority, g.place, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')), 1) AS share
    FROM (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('5-LOW', 2), ('none', 3)) g(o_orderpriority, place) LEFT JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) c USING (o_orderpriority)""")  # fmt: skip
def grade_histogram(spark, d):
    return aggregates.histogram(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW", "none"])


# -- rolling features -----------------------------------------------------------------------------


@query(
    f"""SELECT factory_id, parameter_id, event_id, round(m, 6) AS rolling_mean, round(s, 6) AS rolling_std, round(CASE WHEN abs(m) >= 1e-6 AND s / abs(m) <= 10 THEN s / abs(m) END, 6) AS rolling_cov
    FROM (SELECT *, CASE WHEN count(value) OVER {W8} = 8 THEN avg(value) OVER {W8} END AS m, CASE WHEN count(value) OVER {W8} = 8 THEN stddev_samp(value) OVER {W8} END AS s FROM clean)""", "clean")  # fmt: skip
def rolling_stats(spark, d):
    return rounded(windows.rolling_stats(clean(spark, d), CFG, ordered()), KEY, "rolling_mean", "rolling_std", "rolling_cov", digits=6)


_FLAT = f"""SELECT *, CASE WHEN row_number() OVER {SER} >= 8 AND count(*) FILTER (quality_code = 'Raw') OVER {W8} >= 2 AND count(*) FILTER (quality_code = 'Raw' AND value IS NULL) OVER {W8} = 0
    THEN stddev_samp(value) FILTER (quality_code = 'Raw') OVER {W8} END AS sd FROM clean"""


@query(
    f"""SELECT factory_id, parameter_id, event_id, round(sd, 4) AS frame_std, CASE WHEN sd IS NULL THEN NULL WHEN CASE WHEN med = 0 THEN sd <= 0 ELSE sd < 0.1 * med END THEN 1.0 ELSE 0.0 END AS flatline_flag
    FROM (SELECT *, quantile_cont(sd, 0.5) OVER (PARTITION BY factory_id, parameter_id) AS med FROM ({_FLAT}))""", "clean")  # fmt: skip
def flatline_measured(spark, d):
    return windows.flatline_measured(clean(spark, d), CFG, ordered()).select(*KEY, F.round("frame_std", 4).alias("frame_std"), "flatline_flag")


@query(
    f"""SELECT factory_id, parameter_id, event_id, CASE WHEN n < 8 OR raws < 2 THEN NULL WHEN sd < 0.01 THEN 1.0 ELSE 0.0 END AS flatline_flag
    FROM (SELECT *, row_number() OVER {SER} AS n, count(*) FILTER (quality_code = 'Raw') OVER {W8} AS raws FROM ({_FLAT}))""", "clean")  # fmt: skip
def flatline_fixed(spark, d):
    return windows.flatline_fixed(clean(spark, d), CFG, ordered()).select(*KEY, "flatline_flag")


def _pairs(a: str, b: str, w: str, n: int) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN covar_pop({x}, {y}) OVER {w} / nullif(sqrt(var_pop({x}) OVER {w}) * sqrt(var_pop({y}) OVER {w}), 0) END"


_W12 = "(PARTITION BY factory_id ORDER BY timestamp ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
_WIDE = "SELECT factory_id, timestamp, " + ", ".join(f'max(value) FILTER (parameter_id = \'{p}\') AS "{p}"' for p in PARAMETERS) + " FROM telb GROUP BY 1, 2"


@query(
    "SELECT factory_id, timestamp, " + ", ".join(f'round({_pairs(chr(34) + a + chr(34), chr(34) + b + chr(34), _W12, 12)}, 4) + 0.0 AS "{n}"' for a, b, n in windows.correlation_names(PARAMETERS)) + f" FROM ({_WIDE})", "telb")
def rolling_corr(spark, d):
    return rounded(windows.correlations(windows.wide(telb(spark, d), PARAMETERS), CFG), ["factory_id", "timestamp"], *(n for *_, n in windows.correlation_names(PARAMETERS)))


_W24 = "(PARTITION BY factory_id, parameter_id ORDER BY timestamp, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


_AUTO = f"SELECT factory_id, parameter_id, event_id, {_pairs('value', 'before', _W24, 24)} AS autocorrelation FROM (SELECT *, lag(value, 24) OVER {SER} AS before FROM clean)"


@query(f"SELECT * REPLACE (round(autocorrelation, 4) AS autocorrelation) FROM ({_AUTO})", "clean")
def autocorrelation(spark, d):
    return rounded(windows.autocorrelation(clean(spark, d), CFG, ordered()), KEY, "autocorrelation")


@query(
    f"""SELECT factory_id, parameter_id, event_id, CASE WHEN row_number() OVER {SER} >= 192 THEN round(100.0 * count(*) FILTER (value IS NULL) OVER w / 192, 4) END AS missing_rate,
    CASE WHEN row_number() OVER {SER} >= 192 THEN round(100.0 * count(*) FILTER (quality_code = 'L') OVER w / 192, 4) END AS bdl_rate
    FROM clean WINDOW w AS (PARTITION BY factory_id, parameter_id ORDER BY timestamp, event_id ROWS BETWEEN 191 PRECEDING AND CURRENT ROW)""", "clean")  # fmt: skip
def missing_bdl_rates(spark, d):
    return rounded(windows.rates(clean(spark, d), CFG, ordered()), KEY, "missing_rate", "bdl_rate")


@query(
    f"""SELECT factory_id, parameter_id, event_id, CAST(row_number() OVER (PARTITION BY factory_id, parameter_id, run ORDER BY timestamp, event_id) AS DOUBLE) AS duplicate_run_length
    FROM (SELECT *, sum(brk) OVER {SER} AS run FROM (SELECT *, CASE WHEN coalesce(value = lag(value) OVER {SER}, false) THEN 0 ELSE 1 END AS brk FROM clean))""", "clean")  # fmt: skip
def dup_run_length(spark, d):
    return windows.run_length(clean(spark, d), ordered()).select(*KEY, "duplicate_run_length")


@query(
    f"""SELECT factory_id, parameter_id, event_id, CASE WHEN sd < 0.1 * med THEN 'high' WHEN r IS NULL THEN NULL WHEN r <= 0.1 OR r >= 6 THEN 'high' WHEN r <= 0.25 OR r >= 3 THEN 'medium'
    WHEN r <= 0.5 OR r >= 1.5 THEN 'low' ELSE 'none' END AS cov_severity
    FROM (SELECT *, c / CASE WHEN coalesce(quantile_cont(c, 0.5) OVER p, 0) <= 0 THEN 1e-6 ELSE quantile_cont(c, 0.5) OVER p END AS r, quantile_cont(sd, 0.5) OVER p AS med
    FROM (SELECT *, CASE WHEN abs(m) >= 1e-6 AND s / abs(m) <= 10 THEN s / abs(m) END AS c FROM (SELECT *, CASE WHEN count(value) OVER {W8} = 8 THEN avg(value) OVER {W8} END AS m,
    CASE WHEN count(value) OVER {W8} = 8 THEN stddev_samp(value) OVER {W8} END AS s FROM ({_FLAT}))) WINDOW p AS (PARTITION BY factory_id, parameter_id))""", "clean")  # fmt: skip
def cov_severity(spark, d):
    rows = windows.flatline_measured(windows.rolling_stats(clean(spark, d), CFG, ordered()), CFG, ordered())
    return windows.severity(rows).select(*KEY, "cov_severity")


@query(
    f"""SELECT factory_id, timestamp, round(r, 4) AS bod_cod_ratio, round(CASE WHEN count(r) OVER w = 12 THEN stddev_samp(r) OVER w END, 4) AS bod_cod_ratio_volatility
    FROM (SELECT *, CASE WHEN click IS NOT NULL AND "view" > 1e-6 THEN click / "view" END AS r FROM ({_WIDE}) WHERE click IS NOT NULL OR "view" IS NOT NULL)
    WINDOW w AS (PARTITION BY factory_id ORDER BY timestamp ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", "telb")  # fmt: skip
def ratio_volatility(spark, d):
    cfg = FeatureConfig(rate_rows=12, ratio=("click", "view"))
    return rounded(windows.ratio_features(windows.wide(telb(spark, d), PARAMETERS), cfg), ["factory_id", "timestamp"], "bod_cod_ratio", "bod_cod_ratio_volatility")


@query(
    """SELECT factory_id, parameter_id, event_id, CASE WHEN upper_limit IS NULL THEN NULL WHEN coalesce(value BETWEEN 0.95 * upper_limit AND upper_limit, false)
    OR coalesce(value BETWEEN lower_limit AND lower_limit + (upper_limit - lower_limit) * 0.05, false) THEN 1.0 ELSE 0.0 END AS limit_hugging FROM clean LEFT JOIN lim USING (factory_id, parameter_id)""", "lim")  # fmt: skip
def limit_hugging(spark, d):
    return windows.limit_hugging(clean(spark, d), lim(spark, d), CFG).select(*KEY, "limit_hugging")


def features(spark: SparkSession, d: str) -> DataFrame:
    readings = clean(spark, d).select("factory_id", "parameter_id", "timestamp", "value", "quality_code", "event_id")
    return feature_matrix.build(readings, telemetry.quality_report(tel(spark, d)), lim(spark, d), CFG, ["event_id"], largest=True)


def body(name: str) -> str:
    """The SQL of a query without its base views."""
    return BODY[name]


_CORR = [n for *_, n in windows.correlation_names(PARAMETERS)]
_CELLS = _WIDE.replace("FROM telb", "FROM clean")
_CORRS = "SELECT factory_id, timestamp, " + ", ".join(f'{_pairs(chr(34) + a + chr(34), chr(34) + b + chr(34), _W12, 12)} AS "{n}"' for a, b, n in windows.correlation_names(PARAMETERS)) + f" FROM ({_CELLS})"
_RATIO = f"""SELECT factory_id, timestamp, r AS bod_cod_ratio, CASE WHEN count(r) OVER w = 192 THEN stddev_samp(r) OVER w END AS bod_cod_ratio_volatility
    FROM (SELECT *, CASE WHEN click IS NOT NULL AND "view" > 1e-6 THEN click / "view" END AS r FROM ({_CELLS}) WHERE click IS NOT NULL OR "view" IS NOT NULL)
    WINDOW w AS (PARTITION BY factory_id ORDER BY timestamp ROWS BETWEEN 191 PRECEDING AND CURRENT ROW)"""
_FEATURES = f"""SELECT c.factory_id, c.parameter_id, c.timestamp, c.value, c.quality_code, c.event_id, rs.rolling_mean, rs.rolling_std, rs.rolling_cov, fl.flatline_flag, au.autocorrelation, mi.missing_rate, mi.bdl_rate,
    ru.duplicate_run_length, se.cov_severity, {", ".join(f'co."{n}"' for n in _CORR)}, CASE WHEN c.parameter_id IN ('click', 'view') THEN ra.bod_cod_ratio END AS bod_cod_ratio,
    CASE WHEN c.parameter_id IN ('click', 'view') THEN ra.bod_cod_ratio_volatility END AS bod_cod_ratio_volatility, hu.limit_hugging, er.error_rate AS quality_error_rate
    FROM clean c JOIN ({body("rolling_stats")}) rs ON rs.event_id = c.event_id JOIN ({body("flatline_measured")}) fl ON fl.event_id = c.event_id JOIN ({_AUTO}) au ON au.event_id = c.event_id
    JOIN ({body("missing_bdl_rates")}) mi ON mi.event_id = c.event_id JOIN ({body("dup_run_length")}) ru ON ru.event_id = c.event_id JOIN ({body("cov_severity")}) se ON se.event_id = c.event_id
    JOIN ({body("limit_hugging")}) hu ON hu.event_id = c.event_id LEFT JOIN ({_CORRS}) co ON co.factory_id = c.factory_id AND co.timestamp = c.timestamp
    LEFT JOIN ({_RATIO}) ra ON ra.factory_id = c.factory_id AND ra.timestamp = c.timestamp LEFT JOIN ({body("quality_report")}) er ON er.factory_id = c.factory_id"""
_DIGITS = dict.fromkeys(["value", "rolling_mean", "rolling_std", "rolling_cov"], 6) | dict.fromkeys(["autocorrelation", "missing_rate", "bdl_rate", *_CORR, "bod_cod_ratio", "bod_cod_ratio_volatility"], 4)


@query("SELECT * REPLACE (" + ", ".join(f'round("{c}", {n}) AS "{c}"' for c, n in _DIGITS.items()) + f", CAST(flatline_flag AS DOUBLE) AS flatline_flag, CAST(limit_hugging AS DOUBLE) AS limit_hugging) FROM ({_FEATURES})", "tel", "clean", "lim")
def feature_matrix_rows(spark, d):
    return features(spark, d).withColumns({c: F.round(F.col(f"`{c}`"), n) for c, n in _DIGITS.items()})


@query(
    f"""SELECT factory_id, CAST(coalesce(max(date_diff('second', before, timestamp) // 60), 0) AS BIGINT) AS longest_gap_minutes
    FROM (SELECT *, lag(timestamp) OVER {SER} AS before FROM (SELECT *  REPLACE (date_trunc('second', timestamp) AS timestamp) FROM clean)) GROUP BY 1""", "clean")  # fmt: skip
def gap_max(spark, d):
    return windows.largest_gap(clean(spark, d).withColumn("timestamp", F.date_trunc("second", "timestamp").cast("timestamp_ntz")), ["event_id"])


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS position FROM part")
def rank_positions(spark, d):
    return windows.ranks(table(spark, d, "part"), "p_retailprice", "p_partkey").select("p_partkey", "position")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def keep_first(spark, d):
    return windows.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc()]).select("o_custkey", "o_orderkey")


@query(f"SELECT factory_id, parameter_id, event_id, round(last_value(value IGNORE NULLS) OVER (PARTITION BY factory_id, parameter_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING), 4) AS value FROM tel", "tel")
def carry_forward(spark, d):
    return rounded(windows.carry_forward(tel(spark, d), "value", ["factory_id", "parameter_id"], ["timestamp", "event_id"]), KEY, "value")


@query("SELECT n_nationkey, round(sum(n_nationkey) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) - n_nationkey, 4) AS \"offset\" FROM nation")
def running_offset(spark, d):
    rows = table(spark, d, "nation").withColumn("w", F.col("n_nationkey").cast("double"))
    return windows.running_offset(rows, "w", "n_nationkey", []).select("n_nationkey", F.round("offset", 4).alias("offset"))


@query("SELECT factory_id, parameter_id, event_id FROM (SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS n FROM tel WHERE factory_id IN ('site_0', 'site_1')) WHERE (n - 1) % 20 = 0", "tel")
def systematic_sample(spark, d):
    return windows.every_kth(tel(spark, d).filter(F.col("factory_id").isin("site_0", "site_1")), 20, "timestamp", ["event_id"]).select(*KEY)


# -- joins ------------------------------------------------------------------------------------------


@query("SELECT factory_id, parameter_id, event_id, upper_limit, lower_limit FROM clean LEFT JOIN lim USING (factory_id, parameter_id)", "lim")
def left_join_limits(spark, d):
    return clean(spark, d).join(lim(spark, d), ["factory_id", "parameter_id"], "left").select(*KEY, "upper_limit", "lower_limit")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey > 3 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 20 GROUP BY 1) b ON a.k = b.k")
def full_join_summaries(spark, d):
    a = table(spark, d, "customer").filter("c_nationkey > 3").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, d, "supplier").filter("s_nationkey < 20").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return profile.availability(a.withColumnRenamed("k", "factory_id"), b.withColumnRenamed("k", "factory_id")).withColumnRenamed("factory_id", "k")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def insert_missing(spark, d):
    old, new = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("p")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("p"))
    return sinks.insert_ignore(old, new, ["p"])


@query("SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def upsert_evolve(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return sinks.upsert(old, new, ["id"])


@query("SELECT o_custkey AS k, o_totalprice AS v FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '5-LOW' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def fallback_union(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderpriority")
    return joins.with_fallback(o.filter("o_orderpriority = '1-URGENT'").drop("o_orderpriority"), o.filter("o_orderpriority = '5-LOW'").drop("o_orderpriority"), ["k"])


@query("SELECT o.o_custkey, o.o_orderkey, (SELECT count(DISTINCT l_partkey) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey) AS n FROM orders) o WHERE n = 1")
def latest_row_subquery(spark, d):
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("parts"))
    last = joins.latest_of(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return last.join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", "o_orderkey", F.coalesce("parts", F.lit(0)).alias("parts"))


@query(
    """SELECT t.factory_id, t.parameter_id, t.event_id, arg_max(l.tamper_type, l.label_order) AS tamper_type, arg_max(l.severity, l.label_order) AS severity, count(DISTINCT l.label_order) AS n_labels,
    count(l.label_order) > 0 AS is_tampered FROM tel t LEFT JOIN lab l ON t.factory_id = l.factory_id AND t.timestamp BETWEEN l.start_timestamp AND l.end_timestamp AND (l.parameter_id IS NULL OR l.parameter_id = t.parameter_id)
    GROUP BY 1, 2, 3""", "tel", "lab")  # fmt: skip
def interval_labels(spark, d):
    return joins.label_intervals(tel(spark, d), lab(spark), ["event_id"]).select(*KEY, "tamper_type", "severity", "n_labels", "is_tampered")


@query("SELECT i.factory_id, i.inspection_date, i.status, (SELECT max(timestamp) FROM clean c WHERE c.factory_id = i.factory_id AND c.timestamp < i.inspection_date) AS latest FROM insp i", "clean", "insp")
def asof_latest(spark, d):
    return joins.as_of_before(insp(spark, d), clean(spark, d), "factory_id", "inspection_date", "timestamp", "latest").select("factory_id", "inspection_date", "status", "latest")


@query(
    """SELECT i.factory_id, i.inspection_date, c.parameter_id, count(c.value) AS n, round(avg(c.value), 8) AS mean FROM (SELECT DISTINCT factory_id, inspection_date FROM insp) i
    JOIN clean c ON c.factory_id = i.factory_id AND c.timestamp >= i.inspection_date - INTERVAL 3 DAYS AND c.timestamp < i.inspection_date GROUP BY 1, 2, 3""", "clean", "insp")  # fmt: skip
def window_range_join(spark, d):
    at = F.col("inspection_date").cast("timestamp_ntz")
    anchors = insp(spark, d).select("factory_id", "inspection_date").distinct().withColumns({"s": at - F.expr("interval 3 days"), "e": at})
    return joins.in_windows(anchors, clean(spark, d), ["factory_id", "inspection_date"], "s", "e", [F.count("value").alias("n"), F.round(F.avg("value"), 8).alias("mean")])


_TERMS = "SELECT o_orderkey, o_custkey % 50 AS client, o_orderdate AS s, o_orderdate + to_days(CAST(o_orderkey % 9 - 1 AS INTEGER)) AS e FROM orders"


@query(f"WITH t AS ({_TERMS}) SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM t a JOIN t b ON a.client = b.client AND a.o_orderkey < b.o_orderkey WHERE greatest(a.s, b.s) <= least(a.e, b.e)")
def interval_overlap(spark, d):
    o = table(spark, d, "orders")
    terms = o.select("o_orderkey", (F.col("o_custkey") % 50).alias("client"), F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 9 - 1).cast("int"))).alias("e"))
    return joins.overlapping(terms, "o_orderkey", "client", "s", "e")


#: The same words in SQL: of keyword searches, and of comparing two names.
_TOKENS = (
    "list_filter(list_distinct(string_split(trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({0}, '^[mM]/[sS]\\.?\\s*', ''), '\\(.*?\\)', '', 'g'), '[^a-zA-Z0-9\\s]', ' ', 'g')), '\\s+', ' ', 'g')), ' ')), "
    "lambda x: length(x) > 2 AND x NOT IN ('pvt','ltd','private','limited','industries','chemical','chemicals','india','co','company','corp','corporation','unit','and','sons','export'))"
)
_PLAIN = "trim(replace(replace(replace(replace(lower({0}), 'm/s', ''), '.', ''), ',', ''), '-', ' '))"
_WORDS = (
    "list_filter(regexp_split_to_array(" + _PLAIN + ", '\\s+'), lambda x: length(x) > 2 AND x NOT IN ('limited','private','ltd','pvt','corp','co','india','pharmaceuticals','pharmaceutical','chemicals','chemical','industries','industry',"
    "'company','sciences','science','labs','laboratories','laboratory','m/s','unit','formerly','known','know','as','formarly','formaly'))"
)


@query(
    f"""WITH n AS (SELECT p_partkey, p_brand || p_type AS block, {_PLAIN.format('p_name')} AS x, {_WORDS.format('p_name')} AS w FROM part)
    SELECT key, other, inside, shared FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE -shared END, other) AS n FROM (
    SELECT a.p_partkey AS key, b.p_partkey AS other, contains(a.x, b.x) OR contains(b.x, a.x) AS inside, CAST(len(list_distinct(list_intersect(a.w, b.w))) AS INTEGER) AS shared, len(a.w) AS own
    FROM n a JOIN n b ON a.block = b.block AND a.p_partkey <> b.p_partkey) WHERE inside OR shared >= CASE WHEN own = 0 THEN 1 ELSE least(2, own) END) WHERE n = 1""")  # fmt: skip
def name_match(spark, d):
    p = table(spark, d, "part").withColumn("block", F.concat("p_brand", "p_type"))
    return joins.match_names(p, p, "block", "p_name", "p_partkey", apart=True)


@query("SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND regexp_matches(c_mktsegment, '(?i)\\bbuilding\\b') GROUP BY 1")
def regex_match(spark, d):
    c = table(spark, d, "customer").filter(scalars.has_all_words(F.col("c_mktsegment"), ["building"]))
    return table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"))


# -- sorts, top-k, search ------------------------------------------------------------------------------


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def topk_per_group(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("o_orderpriority", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def topk_global(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("SELECT p_name, p_partkey FROM part WHERE contains(lower(p_name), 'a') OR contains(CAST(p_partkey AS VARCHAR), 'a') ORDER BY p_partkey LIMIT 8")
def search_contains(spark, d):
    return views.search(table(spark, d, "part"), ["p_partkey", "p_name"], "A").select("p_name", "p_partkey")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_with_bypass(spark, d):
    return table(spark, d, "customer").filter(views.same_text("c_mktsegment", "BUILDING") & views.same_text("c_name", "All names")).select("c_custkey")


@query("SELECT n_name FROM nation UNION SELECT r_name FROM region")
def union_keys(spark, d):
    return table(spark, d, "nation").select("n_name").union(table(spark, d, "region").select(F.col("r_name").alias("n_name"))).distinct()


# -- scalar functions, sources and exports ---------------------------------------------------------------

#: By the remainder of the key: what is read from texts that are made of the columns of ``orders``.
_CASE = lambda m, *xs: f"CASE o_orderkey % {m} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"


@query(
    f"""SELECT o_orderkey, {_CASE(7, "'ETP-pH'", "'ETP-BOD'", "'ETP-Flow'", "'ETP-COD'", "'ETP-TSS'", "'ETP-pH'", "NULL")} AS parameter_id, CAST({_CASE(6, 'o_custkey', 'NULL', 'o_custkey + 0.5', 'NULL', 'NULL', 'NULL')} AS DOUBLE) AS low,
    CAST({_CASE(6, 'o_custkey + 7', 'o_custkey', 'o_custkey + 2.25', 'NULL', 'o_custkey + 1000000', 'o_custkey + 0.5')} AS DOUBLE) AS high, CASE WHEN o_orderkey % 5 = 4 THEN DATE '1970-01-01' ELSE CAST(o_orderdate AS DATE) END AS day,
    {_CASE(8, "'mg/l'", "'pH'", "'KLD'", "NULL", "'mg/Nm3'", "'kg/day'", "'ppm'", "NULL")} AS unit, CAST({_CASE(4, 'o_custkey + 0.5', 'NULL', "CAST('-1' || o_custkey AS DOUBLE)", 'NULL')} AS DOUBLE) AS value, {_CASE(4, "'U'", "NULL", "'Raw'", "NULL")} AS code,
    {_CASE(4, "'Thane ' || o_custkey", "'Pune'", "NULL", "NULL")} AS region, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey || 'b' END AS labelled FROM orders""")  # fmt: skip
def scalar_functions(spark, d):
    k, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    pick = lambda m, *xs: F.element_at(F.array(*(x if not isinstance(x, str) else F.lit(x) for x in xs)), (k % m + 1).cast("int"))
    say, day = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs)), lambda f: F.date_format("o_orderdate", f)
    t = table(spark, d, "orders").select(
        k, pick(7, " pH Value", say("BOD (", n, " days)"), say("Trade effluent ", n), "chemical oxygen demand COD", "Suspended Solids", "pH", "o-priority").alias("p"),
        pick(6, say(n, " - ", (F.col("o_custkey") + 7).cast("string")), say("max ", n), say("from ", n, ".5 to ", (F.col("o_custkey") + 2).cast("string"), ".25"), "none", F.format_number(F.col("o_custkey") + 1000000, 0), say("not to exceed ", n, ".5 mg")).alias("r"),
        pick(5, day("dd/MM/yyyy"), day("yyyy-MM-dd"), say("issued ", day("dd.MM.yyyy"), "."), day("MMMM d, yyyy"), "31/31/2024").alias("d"), pick(8, "in mg/ l", "pH scale", "KLD", "deg C", "MG/ Nm3", "kg/ day", "5 ppm", "").alias("u"),
        pick(4, say("[", n, ".5, 'U']"), "['NA', 'E']", say("[-1", n, ", 'Raw']"), say("[", n, ", 2, 3]")).alias("c"), pick(4, say("Office (FO - Thane ", n, ")"), "Region: Pune, X", "none", F.lit(None).cast("string")).alias("g"),
        F.when(k % 3 == 0, say("Works, UNIT - ", n, "b")).otherwise("Works").alias("l"),
    )
    limits, cell = scalars.limit_range(F.col("r")), scalars.cell(F.col("c"))
    return t.select("o_orderkey", scalars.standard_parameter(F.col("p")).alias("parameter_id"), limits["low"].alias("low"), limits["high"].alias("high"), scalars.any_date(F.col("d"), F.lit("1970-01-01").cast("date")).alias("day"), scalars.unit(F.col("u")).alias("unit"), cell["value"].alias("value"), cell["code"].alias("code"), scalars.region(F.col("g")).alias("region"), scalars.labelled_unit(F.col("l")).alias("labelled"))


@query(
    "SELECT c_custkey, list_sort(" + _TOKENS.format("c_mktsegment || ' Pvt Ltd ' || c_name") + ")[1] AS first_token, CASE WHEN contains(' ' || lower(c_mktsegment) || ' ', ' building ') THEN true ELSE false END AS building FROM customer")
def name_tokens(spark, d):
    tokens = scalars.name_tokens(F.concat_ws(" Pvt Ltd ", "c_mktsegment", "c_name"))
    return table(spark, d, "customer").select("c_custkey", F.get(F.array_sort(tokens), F.lit(0)).alias("first_token"), scalars.has_word(F.col("c_mktsegment"), "Building").alias("building"))


_CODES = ["U", "V", "E", "O", "N", "I", "M", "C", "Z", "X", "Y", "input", "L"]


@query(
    """SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'Raw' WHEN 1 THEN 'Validated' WHEN 2 THEN 'Error' WHEN 3 THEN 'Out of Range' WHEN 4 THEN 'Negative' WHEN 5 THEN 'Invalid' WHEN 6 THEN 'Maintenance' WHEN 7 THEN 'Span Calibration'
    WHEN 8 THEN 'Zero Calibration' WHEN 9 THEN 'Expected Calibration' WHEN 10 THEN 'Dynamic Limit' WHEN 11 THEN 'Manual Input' ELSE 'L' END AS quality,
    time_bucket(INTERVAL 15 MINUTES, timestamp, TIMESTAMP '2024-01-01') AS slot, strftime(timestamp, '%Y-%m-%d %H:%M') AS minute FROM tel""", "tel")  # fmt: skip
def quality_names(spark, d):
    code = F.get(F.array(*map(F.lit, _CODES)), (F.col("event_id") % 13).cast("int"))
    return tel(spark, d).select("event_id", scalars.quality_name(code).alias("quality"), scalars.quarter_hour(F.col("timestamp")).cast("timestamp_ntz").alias("slot"), F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("minute"))


@query("SELECT DISTINCT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events")
def json_map_explode(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,double>")).alias("key", "v"))


@query(
    """SELECT event_id, p AS parameter_id, v AS value, c AS code FROM (SELECT event_id, 'ETP-pH' AS p, round(value, 2) AS v, 'Raw' AS c FROM events WHERE event_id % 7 <> 0 AND value IS NOT NULL
    UNION ALL SELECT event_id, 'ETP-COD', round(value * 2, 2), 'L' FROM events WHERE event_id % 5 <> 0 AND value IS NOT NULL)""")  # fmt: skip
def unpivot_cells(spark, d):
    e = table(spark, d, "events")
    cell = lambda v, c: F.concat(F.lit("["), F.coalesce(F.round(v, 2).cast("string"), F.lit("'NA'")), F.lit(f", '{c}']"))
    wide = e.select("event_id", F.monotonically_increasing_id().alias("row"), cell(F.when(F.col("event_id") % 7 != 0, F.col("value")), "U").alias("ETP-pH_1"), F.when(F.col("event_id") % 5 != 0, cell(F.col("value") * 2, "L")).alias("ETP-COD_2"))
    return telemetry.unpivot_cells(wide, ["event_id"], "row")


@query("SELECT factory_id, strftime(timestamp, '%Y-%m-%d %H:%M') AS time, " + ", ".join(f'"{p}"' for p in PARAMETERS) + f" FROM ({_WIDE})", "telb")
def pivot_export(spark, d):
    return sinks.pivot_export(telb(spark, d), list(PARAMETERS))


_SPANS = "SELECT event_type, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY 1"


def spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))


@query(f"SELECT event_type, CAST(s AS DATE) AS start, least(CAST(s + INTERVAL 6 DAYS AS DATE), b) AS \"end\" FROM (SELECT *, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAYS)) AS s FROM ({_SPANS}))")
def date_chunks(spark, d):
    return telemetry.chunks(spans(spark, d), "a", "b").select("event_type", "start", "end")


@query(f"SELECT event_type, CAST(s AS DATE) AS start, least(last_day(CAST(s AS DATE)), b) AS \"end\" FROM (SELECT *, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS s FROM ({_SPANS}))")
def month_chunks(spark, d):
    return telemetry.chunks(spans(spark, d), "a", "b", None).select("event_type", "start", "end")


# -- fingerprints and risk ---------------------------------------------------------------------------------

_TRIG = """SELECT m.*, coalesce((missing - quantile_cont(missing, 0.5) OVER ()) / nullif(stddev_pop(missing) OVER (), 0), 0) AS coordinated_missing_data,
    coalesce((errors - quantile_cont(errors, 0.5) OVER ()) / nullif(stddev_pop(errors) OVER (), 0), 0) AS data_integrity, avg(correlation_break) OVER () - stddev_pop(correlation_break) OVER () AS threshold FROM mag m"""
_RULES = {"impossible_ph_range": "> 0", "inspection_dip": "< -20", "flatline": "> 5", "limit_hugging": "> 5", "correlation_break": "< threshold", "copy_paste": "> 1", "coordinated_missing_data": "> 1.5", "data_integrity": "> 1.5"}
_FLAGS = ", ".join(f"CASE WHEN {k} {v} THEN 1 ELSE 0 END AS trig_{k}" for k, v in _RULES.items())
_ALL = f"SELECT *, {' + '.join('trig_' + k for k in _RULES)} AS total FROM (SELECT *, {_FLAGS} FROM ({_TRIG}))"
_RISK = f"""SELECT *, CASE WHEN risk_score >= 75 OR total >= 4 THEN 'CRITICAL' WHEN risk_score >= 50 OR total >= 2 THEN 'HIGH' WHEN risk_score >= 25 OR total >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_category FROM (
    SELECT *, round_even(100 * (0.1 * probability + 0.225 * norm + 0.675 * total / 8), 1) AS risk_score FROM (SELECT *, least(greatest((-0.3208 - anomaly_score) / 0.3062, 0.0), 1.0) AS norm FROM ({_ALL})))"""


def risks(spark: SparkSession, d: str) -> DataFrame:
    return risk.composite(triggered(spark, d))


@query(
    f"SELECT factory_id, {', '.join(f'round({k}, 4) AS {k}, trig_{k}' for k in _RULES)}, total AS total_fingerprints_triggered FROM ({_ALL})", "mag")
def fingerprint_triggers(spark, d):
    return triggered(spark, d).select("factory_id", *(c for k in fingerprints.ORDER for c in (F.round(k, 4).alias(k), F.col(f"trig_{k}"))), "total_fingerprints_triggered")


@query(
    """SELECT factory_id, round(100.0 * count(*) FILTER (bad) / count(*), 4) AS impossible_ph_range, count(*) FILTER (bad) AS impossible_ph_count FROM (
    SELECT c.factory_id, value < 0 OR value > 14 OR coalesce(value < lower_limit, false) OR coalesce(value > upper_limit, false) AS bad
    FROM clean c LEFT JOIN lim l ON l.factory_id = c.factory_id AND l.parameter_id = 'signup' WHERE c.parameter_id = 'signup' AND value IS NOT NULL) GROUP BY 1""", "lim")  # fmt: skip
def ph_range(spark, d):
    out = fingerprints.impossible_ph(clean(spark, d), lim(spark, d).filter("parameter_id = 'signup'"), "signup")
    return out.withColumn("impossible_ph_range", F.round("impossible_ph_range", 4))


@query(
    """SELECT f.factory_id, round(x.dip, 4) AS inspection_dip FROM (SELECT DISTINCT factory_id FROM clean) f LEFT JOIN (SELECT factory_id, avg(CASE WHEN m > 0 THEN 100.0 * (pre - m) / m WHEN m = 0 THEN CASE WHEN pre = 0 THEN 0.0 ELSE 100.0 END END) AS dip FROM (
    SELECT w.factory_id, w.inspection_date, c.parameter_id, avg(value) FILTER (timestamp >= s) AS pre, CASE WHEN count(*) FILTER (timestamp < s) < 5 THEN any_value(a.m_all) ELSE avg(value) FILTER (timestamp < s) END AS m
    FROM (SELECT *, e - INTERVAL 72 HOURS AS s FROM (SELECT factory_id, inspection_date, CASE WHEN latest >= inspection_date - INTERVAL 72 HOURS THEN CAST(inspection_date AS TIMESTAMP) ELSE latest + INTERVAL 1 SECOND END AS e FROM (
    SELECT DISTINCT i.factory_id, i.inspection_date, (SELECT max(timestamp) FROM clean c WHERE c.factory_id = i.factory_id AND c.timestamp < i.inspection_date) AS latest FROM insp i WHERE status = 'Completed') WHERE latest IS NOT NULL)) w
    JOIN clean c ON c.factory_id = w.factory_id AND c.value IS NOT NULL AND c.timestamp >= greatest(TIMESTAMP '2024-01-01', s - INTERVAL 30 DAYS) AND c.timestamp < e
    JOIN (SELECT factory_id, parameter_id, avg(value) AS m_all FROM clean GROUP BY 1, 2) a ON a.factory_id = c.factory_id AND a.parameter_id = c.parameter_id GROUP BY 1, 2, 3) WHERE pre IS NOT NULL GROUP BY 1) x USING (factory_id)""", "clean", "insp")  # fmt: skip
def inspection_dip(spark, d):
    return rounded(fingerprints.inspection_dip(clean(spark, d), insp(spark, d)), ["factory_id"], "inspection_dip")


_SUMMARY = """SELECT *, CASE WHEN readiness_score >= 80 AND parameter_count >= 4 THEN ['Multivariate Correlation', 'Diurnal Profiling', 'Limit Violation Detector', 'Compliance Audit']
    WHEN readiness_score >= 50 THEN ['Single Parameter Trend', 'Basic Limit Compliance', 'Diurnal Profiling'] ELSE ['Data Gap Recovery', 'Sensor Calibration Audit'] END AS recommended_fingerprints
    FROM (SELECT *, round(total_records / monitoring_days, 2) AS average_records_per_day, CASE WHEN coverage_percentage >= 90 THEN 'A' WHEN coverage_percentage >= 75 THEN 'B' WHEN coverage_percentage >= 50 THEN 'C' WHEN coverage_percentage >= 25 THEN 'D' ELSE 'F' END AS quality_grade,
    round(coverage_percentage * 0.4 + least(parameter_count, 4) / 4.0 * 20 + has_limits * 15 + CASE WHEN inspections > 0 THEN 15 ELSE 0 END + least(monitoring_days, 180) / 180.0 * 10, 1) AS readiness_score
    FROM (SELECT * EXCLUDE (seconds), coalesce(has_limits, 0) = 1 AS cto_available, coalesce(inspections, 0) > 0 AS inspection_schedule_available, greatest(parameter_count * (seconds // 900 + 1) - total_records, 0) AS missing_intervals, round(greatest(0.1, seconds / 86400.0), 2) AS monitoring_days, parameter_count * (seconds // 900 + 1) AS expected_records,
    least(100.0, round(total_records / (parameter_count * (seconds // 900 + 1)) * 100, 2)) AS coverage_percentage
    FROM (SELECT factory_id, min(timestamp) AS monitoring_start, max(timestamp) AS monitoring_end, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 1000000 AS seconds, count(*) AS total_records,
    list_sort(list(DISTINCT parameter_id)) AS parameters, CAST(count(DISTINCT parameter_id) AS INTEGER) AS parameter_count, count(*) FILTER (value IS NULL) AS null_values, count(*) FILTER (value = 0) AS zero_values, count(*) FILTER (value < 0) AS negative_values,
    CAST(coalesce(max(gap) // 60000000, 0) AS BIGINT) AS longest_gap_minutes, count(*) - count(DISTINCT parameter_id || '|' || CAST(timestamp AS VARCHAR)) AS duplicate_values
    FROM (SELECT *, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY factory_id, parameter_id ORDER BY timestamp, event_id)) AS gap FROM clean) GROUP BY 1)
    LEFT JOIN (SELECT DISTINCT factory_id, 1 AS has_limits, (SELECT count(DISTINCT parameter_id) FROM lim x WHERE x.factory_id = lim.factory_id) AS limited_parameters FROM lim) USING (factory_id)
    LEFT JOIN (SELECT factory_id, count(*) AS inspections FROM insp GROUP BY 1) USING (factory_id)))"""


@query(_SUMMARY, "clean", "lim", "insp")
def quality_summary(spark, d):
    return profile.quality_summary(clean(spark, d), lim(spark, d), insp(spark, d), ["event_id"])


_SHARE = lambda flag, of: f"coalesce(100.0 * count(*) FILTER ({flag}) / nullif(count({of}), 0), 0)"
_SCORES = f"""SELECT f.*, p.impossible_ph_range, p.impossible_ph_count, x.inspection_dip, 100 - q.coverage_percentage AS missing_percentage FROM (
    SELECT factory_id, {_SHARE('flatline_flag = 1', 'flatline_flag')} AS flatline, {_SHARE('limit_hugging = 1', 'limit_hugging')} AS limit_hugging, {_SHARE('autocorrelation > 0.95', 'autocorrelation')} AS copy_paste,
    avg(list_avg([{", ".join(f'"{n}"' for n in _CORR)}])) AS correlation_break, avg(missing_rate) AS missing, 100 * max(quality_error_rate) AS errors FROM ({_FEATURES}) GROUP BY 1) f
    JOIN ({body("inspection_dip")}) x USING (factory_id) JOIN ({body("ph_range")}) p USING (factory_id) LEFT JOIN ({_SUMMARY}) q USING (factory_id)"""
_SCORED = f"SELECT *, {' + '.join('trig_' + k for k in _RULES)} AS total_fingerprints_triggered FROM (SELECT *, {_FLAGS} FROM ({_TRIG.replace('(missing - quantile_cont(missing, 0.5) OVER ()) / nullif(stddev_pop(missing) OVER (), 0)', '(missing_percentage - quantile_cont(missing_percentage, 0.5) OVER ()) / nullif(stddev_pop(missing_percentage) OVER (), 0)').replace('FROM mag m', f'FROM ({_SCORES}) m')}))"
_MEASURES = ["flatline", "limit_hugging", "copy_paste", "correlation_break", "missing", "errors", "inspection_dip", "impossible_ph_range", "missing_percentage", "coordinated_missing_data", "data_integrity", "threshold"]


@query("SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in _MEASURES) + f") FROM ({_SCORED})", "tel", "clean", "lim", "insp")
def fingerprint_scores(spark, d):
    out = fingerprints.summarise(features(spark, d), _CORR)
    out = out.join(fingerprints.inspection_dip(clean(spark, d), insp(spark, d)), "factory_id").join(fingerprints.impossible_ph(clean(spark, d), lim(spark, d).filter("parameter_id = 'signup'"), "signup"), "factory_id")
    missing = profile.quality_summary(clean(spark, d), lim(spark, d), insp(spark, d), ["event_id"]).select("factory_id", (100 - F.col("coverage_percentage")).alias("missing_percentage"))
    out = out.join(missing, "factory_id", "left")
    out = aggregates.from_median(aggregates.from_median(out, "missing_percentage", "coordinated_missing_data"), "errors", "data_integrity")
    out = fingerprints.triggers(aggregates.below_typical(out, "correlation_break"))
    return out.withColumns({c: F.round(c, 4) for c in _MEASURES})


_NAMES = {"impossible_ph_range": "Impossible Ph Range", "inspection_dip": "Inspection Dip", "flatline": "Flatline", "limit_hugging": "Limit Hugging", "correlation_break": "Correlation Break", "copy_paste": "Copy Paste", "coordinated_missing_data": "Coordinated Missing Data", "data_integrity": "Data Integrity"}


@query(
    f"""SELECT factory_id, risk_score, risk_category, round(norm, 4) AS anomaly_norm, concat_ws('|', {', '.join(f"CASE WHEN trig_{k} = 1 THEN '{v}' END" for k, v in _NAMES.items())}) AS names,
    CASE risk_category WHEN 'CRITICAL' THEN 'Immediate unannounced physical site inspection & automated regulator dispatch.' WHEN 'HIGH' THEN 'Issue formal notice of telemetry anomaly & schedule audit within 48 hours.'
    WHEN 'MEDIUM' THEN 'Flag site for heightened monitoring & mandate sensor calibration report.' ELSE 'Normal routine surveillance.' END AS recommended_action FROM ({_RISK})""", "mag")  # fmt: skip
def composite_risk(spark, d):
    return risks(spark, d).select("factory_id", "risk_score", "risk_category", F.round("anomaly_norm", 4).alias("anomaly_norm"), F.array_join("triggered_fingerprints", "|").alias("names"), "recommended_action")


@query(
    f"""SELECT factory_id, 'Tamper Fingerprint Triggered' AS alert_type, risk_category AS severity, coalesce(n_name, factory_id) || ' triggered ' || total || ' tampering fingerprints. ' || CASE risk_category WHEN 'CRITICAL' THEN 'Immediate unannounced physical site inspection & automated regulator dispatch.'
    ELSE 'Issue formal notice of telemetry anomaly & schedule audit within 48 hours.' END AS message, '2024-12-30 14:00:00' AS timestamp, 'OPEN' AS status FROM ({_RISK}) LEFT JOIN nation ON factory_id = 'f' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') WHERE risk_category IN ('HIGH', 'CRITICAL')""", "mag")  # fmt: skip
def alerts(spark, d):
    return risk.alerts(risks(spark, d), factory_names(spark, d))


def factory_names(spark: SparkSession, d: str) -> DataFrame:
    """(factory_id, name, region, industry) of the first 25 factories, made of nations and regions."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.concat(F.lit("f"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("factory_id"), F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.concat(F.lit("Industry "), (F.col("n_nationkey") % 3).cast("string")).alias("industry"))


@query(
    f"""SELECT *, round_even(from_tamper_model + from_anomaly + from_fingerprints, 1) AS total FROM (SELECT factory_id, round_even(10.0 * probability, 1) AS from_tamper_model,
    round_even(22.5 * norm, 1) AS from_anomaly, round_even(67.5 * total / 8, 1) AS from_fingerprints FROM ({_RISK}))""", "mag")  # fmt: skip
def score_breakdown(spark, d):
    return risk.breakdown(risks(spark, d))


_TOLD = {
    "impossible_ph_range": ("Impossible pH Range", "%", "'> 0.0% of readings'"), "inspection_dip": ("Pre-Inspection Dip", "%", "'average pre-inspection change < -20.0%'"), "flatline": ("Flatline", "%", "'> 5.0% of readings'"),
    "limit_hugging": ("Limit Hugging", "%", "'> 5.0% of readings'"), "correlation_break": ("Correlation Break", "", "'< ' || printf('%.4f', threshold) || ' (dataset mean - 1 std dev)'"),
    "copy_paste": ("Copy-Paste", "%", "'> 1.0% of readings (autocorrelation > 0.95)'"), "coordinated_missing_data": ("Coordinated Missing Data", "\u03c3", "'> 1.5 std dev above dataset median missing rate'"),
    "data_integrity": ("Data Integrity (Error Rate)", "\u03c3", "'> 1.5 std dev above dataset median error rate'"),
}


@query(" UNION ALL ".join(f"SELECT factory_id, {i} AS place, '{k}' AS key, '{_TOLD[k][0]}' AS label, round({k}, 4) AS raw_value, '{_TOLD[k][1]}' AS unit, {_TOLD[k][2]} AS threshold_desc, trig_{k} = 1 AS triggered FROM ({_ALL})" for i, k in enumerate(_RULES)), "mag")
def check_list(spark, d):
    return risk.checks(triggered(spark, d)).withColumn("raw_value", F.round("raw_value", 4))


@query(
    f"""SELECT factory_id, CASE WHEN risk_category IN ('HIGH', 'CRITICAL') THEN 'Risk score is being driven by fingerprint checks: ' || coalesce(nullif(concat_ws(', ', CASE WHEN flatline / 100 > 0.05 THEN 'flatline' END,
    CASE WHEN limit_hugging / 100 > 0.05 THEN 'limit hugging' END, CASE WHEN trig_coordinated_missing_data = 1 THEN 'coordinated missing data' END, CASE WHEN impossible_ph_range <> 0 THEN 'impossible values' END), ''),
    'see raw_fingerprint_signals for detail') || '.' END AS note FROM ({_RISK})""", "mag")  # fmt: skip
def risk_drivers(spark, d):
    return risk.drivers(risks(spark, d))


@query(f"SELECT left(factory_id, 2) AS region, count(*) AS n, count(*) FILTER (risk_category IN ('HIGH', 'CRITICAL')) AS high, round(avg(risk_score), 2) AS mean_score FROM ({_RISK}) GROUP BY 1", "mag")
def region_breakdown(spark, d):
    return views.regions(risks(spark, d).withColumn("region", F.substring("factory_id", 1, 2)))


@query(f"SELECT factory_id, risk_score, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC, factory_id) AS position FROM ({_RISK})) WHERE lower(risk_category) = 'high'", "mag")
def factory_list(spark, d):
    return views.factories(risks(spark, d), tier="High").select("factory_id", "risk_score", "position")


@query(f"SELECT factory_id, risk_score FROM ({_RISK}) WHERE risk_category IN ('HIGH', 'CRITICAL') ORDER BY risk_score DESC, factory_id LIMIT 5", "mag")
def dispatch_queue(spark, d):
    return views.dispatch(risks(spark, d)).select("factory_id", "risk_score")


# -- profiles -----------------------------------------------------------------------------------------------


@query("SELECT factory_id, " + ", ".join(f'round(max({m}) FILTER (parameter_id = \'{p}\'), 4) AS "{p}_{m}"' for p in PARAMETERS for m in ("mean", "std", "min", "max", "cv")) + " FROM (SELECT factory_id, parameter_id, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, stddev_samp(value) / avg(value) AS cv FROM clean GROUP BY 1, 2) GROUP BY 1", "clean")
def param_distributions(spark, d):
    stats = aggregates.describe(clean(spark, d), "value", ["factory_id", "parameter_id"]).withColumn("cv", F.try_divide("std", "mean"))
    out = profile.distributions(stats, list(PARAMETERS), ["mean", "std", "min", "max", "cv"])
    return rounded(out, ["factory_id"], *(c for c in out.columns if c != "factory_id"))


@query(
    """SELECT factory_id, parameter_id, round(greatest(0.0, least(1.0, 1.0 - (0.40 * miss + 0.20 * dup + 0.20 * bdl + 0.20 * least(outages / 100.0, 1.0)))), 4) AS sensor_health_score FROM (
    SELECT factory_id, parameter_id, count(*) FILTER (value IS NULL) / count(*) AS miss, (count(*) - count(DISTINCT k)) / count(*) AS dup, count(*) FILTER (quality_code = 'L') / count(*) AS bdl, count(*) FILTER (value > 400) AS outages FROM clean GROUP BY 1, 2)""", "clean")  # fmt: skip
def sensor_health(spark, d):
    n, pct = F.count(F.lit(1)), lambda c: F.lit(100.0) * c / F.count(F.lit(1))
    rows = clean(spark, d).groupBy("factory_id", "parameter_id").agg(pct(F.count_if(F.col("value").isNull())).alias("missing_percentage"), pct(n - F.count_distinct("k")).alias("duplicate_percentage"), pct(F.count_if(F.col("quality_code") == "L")).alias("bdl_percentage"), F.count_if(F.col("value") > 400).alias("number_of_outages"))
    return rounded(profile.sensor_health(rows), ["factory_id", "parameter_id"], "sensor_health_score")


@query(
    """SELECT a.factory_id AS a, CAST(place AS INTEGER) AS place, b, similarity FROM (SELECT a.factory_id, b.factory_id AS b, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 4) AS similarity,
    row_number() OVER (PARTITION BY a.factory_id ORDER BY list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) DESC, b.factory_id) AS place FROM v a JOIN v b ON a.factory_id <> b.factory_id) a WHERE place <= 3""", "mag")  # fmt: skip
def similar_top3(spark, d):
    return profile.most_similar(profile.standardised(mag(spark, d), ["flatline", "limit_hugging", "missing"], "factory_id"), "factory_id")


SQL["similar_top3"] = SQL["similar_top3"].replace(
    " SELECT a.factory_id AS a,", ", v AS (SELECT factory_id, [" + ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END" for c in ("flatline", "limit_hugging", "missing")) + "] AS v FROM mag) SELECT a.factory_id AS a,", 1
)


@query(
    """SELECT factory_id, coalesce(bool_or(n >= 2 AND (hi - lo) / (abs(mean) + 1e-6) > 0.25), false) AS temporal_shift_detected,
    coalesce(string_agg(CASE WHEN n >= 2 THEN format('{}: Q_min={:.2f}, Q_max={:.2f} (shift={:.2f})', parameter_id, lo, hi, hi - lo) END, '; ' ORDER BY parameter_id), 'No monitored parameters with quarterly data') AS temporal_shift_summary FROM (
    SELECT factory_id, parameter_id, count(m) AS n, min(m) AS lo, max(m) AS hi, avg(m) AS mean FROM (
    SELECT 'n' || (l_suppkey % 25) AS factory_id, l_returnflag || l_linestatus AS parameter_id, quarter(l_shipdate) AS q, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
def temporal_stability(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("n"), F.col("l_suppkey") % 25).alias("factory_id"), F.concat("l_returnflag", "l_linestatus").alias("parameter_id"), F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("value"))
    return profile.temporal_shift(rows)


@query(
    """SELECT s.factory_id, s.parameter_id, s.n, round(s.iqr, 4) AS iqr, count(*) FILTER (c.value < p25 - 1.5 * iqr OR c.value > p75 + 1.5 * iqr) AS outlier_count FROM (
    SELECT factory_id, parameter_id, count(value) AS n, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM clean GROUP BY 1, 2) s
    JOIN clean c ON c.factory_id = s.factory_id AND c.parameter_id = s.parameter_id GROUP BY 1, 2, 3, s.iqr""", "clean")  # fmt: skip
def series_statistics(spark, d):
    return profile.series_statistics(clean(spark, d)).select("factory_id", "parameter_id", "n", F.round("iqr", 4).alias("iqr"), "outlier_count")


@query("SELECT factory_id, round(coalesce(inspection_dip, (SELECT avg(inspection_dip) FROM mag)), 4) AS inspection_dip FROM mag", "mag")
def impute_mean(spark, d):
    return rounded(aggregates.impute_mean(mag(spark, d), ["inspection_dip"]), ["factory_id"], "inspection_dip")


@query(
    """SELECT factory_id, parameter_id, round(avg(value) * 10) / 10 AS mean FROM (SELECT * FROM clean WHERE factory_id <> 'site_3' AND quality_code = 'Raw' UNION ALL SELECT * FROM clean WHERE factory_id = 'site_3') GROUP BY 1, 2""", "clean")  # fmt: skip
def parameter_means(spark, d):
    c = clean(spark, d)
    return views.parameter_means(c.filter("factory_id <> 'site_3' and quality_code = 'Raw'"), c)


@query("SELECT n_name FROM nation WHERE contains(lower(n_name), 'n_1') OR contains(lower(n_name), '2')")
def city_filter(spark, d):
    return views.in_cities(table(spark, d, "nation"), "n_name", {"x": ["N_1", "2"]}, "unknown").select("n_name")


_VIEW = f"""SELECT CAST(row_number() OVER (ORDER BY risk_score DESC, factory_id) AS INTEGER) AS rank, factory_id, coalesce(n_name, 'Industrial Site ' || factory_id) AS name, coalesce(r_name, 'Taloja') AS region, coalesce('Industry ' || (n_nationkey % 3), 'Chemical Manufacturing') AS industry,
    risk_score AS tsi_score, CASE risk_category WHEN 'CRITICAL' THEN 'High' WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' ELSE 'Low' END AS risk_tier, risk_category AS true_risk_category, norm AS anomaly_score, flatline / 100 AS flatline_rate, copy_paste / 100 AS autocorr_high_rate,
    limit_hugging / 100 AS limit_hugging_mean, impossible_ph_range / 100 AS impossible_val_rate, coalesce(inspection_dip, 0) AS pre_dip_mean, trig_coordinated_missing_data AS coordinated_missing_flag, CAST(0 AS DOUBLE) AS dup_run_rate, CAST(0 AS DOUBLE) AS bdl_rate_mean, CAST(0 AS DOUBLE) AS cov_high_rate,
    CAST(NULL AS DOUBLE) AS bod_cod_vol_mean FROM ({_RISK}) LEFT JOIN nation ON factory_id = 'f' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') LEFT JOIN region ON n_regionkey = r_regionkey"""
_VIEWED = ["anomaly_score", "flatline_rate", "autocorr_high_rate", "limit_hugging_mean", "impossible_val_rate", "pre_dip_mean"]


def view(spark: SparkSession, d: str) -> DataFrame:
    r = risks(spark, d)
    return views.score_view(r.select("factory_id", "risk_score", "risk_category", "anomaly_norm"), r.drop("anomaly_norm"), factory_names(spark, d))


@query("SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _VIEWED) + f") FROM ({_VIEW})", "mag")
def score_view(spark, d):
    return view(spark, d).withColumns({c: F.round(c, 6) for c in _VIEWED})


@query(f"SELECT count(*) AS total_factories, " + ", ".join(f"count(*) FILTER (risk_tier = '{t}') AS {t.lower()}_risk_count" for t in ("High", "Medium", "Low")) + f" FROM ({_VIEW})", "mag")
def dashboard_summary(spark, d):
    return views.summary(view(spark, d))


@query(f"SELECT rank, factory_id, name, region, risk_tier FROM ({_VIEW}) WHERE lower(risk_tier) = 'high' AND lower(region) <> 'none'", "mag")
def view_listing(spark, d):
    return views.listing(view(spark, d), None, "HIGH", "name").select("rank", "factory_id", "name", "region", "risk_tier")


@query(f"SELECT rank, factory_id, name, region AS district, industry, risk_tier, tsi_score FROM ({_VIEW}) WHERE industry = 'Industry 1'", "mag")
def admin_listing(spark, d):
    return views.admin_listing(view(spark, d), "All Districts", " industry 1 ")


@query(f"SELECT factory_id, 'Critical' AS tag FROM ({_VIEW}) WHERE risk_tier = 'High'", "mag")
def tagged_listing(spark, d):
    return views.tagged(view(spark, d), "critical").select("factory_id", "tag")


_QUALITY = "SELECT 'f' || lpad(CAST(user_id % 30 AS VARCHAR), 2, '0') AS factory_id, round(100 * avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 2) AS coverage_percentage, round(avg(value), 2) AS readiness_score, CAST(count(DISTINCT event_type) AS INTEGER) AS parameter_count, count(*) AS total_records FROM events GROUP BY 1"
_MEANT = "SELECT factory_id, " + ", ".join(f"max(mean) FILTER (parameter_id = '{p}') AS avg_{p}" for p in ("click", "view")) + " FROM (SELECT 'f' || lpad(CAST(user_id % 33 AS VARCHAR), 2, '0') AS factory_id, event_type AS parameter_id, round(avg(value) * 10) / 10 AS mean FROM events GROUP BY 1, 2) GROUP BY 1"


def quality_of_users(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.concat(F.lit("f"), F.lpad((F.col("user_id") % 30).cast("string"), 2, "0")).alias("factory_id")).agg(
        F.round(100 * F.avg(F.when(v > 50, 1.0).otherwise(0.0)), 2).alias("coverage_percentage"), F.round(F.avg(v), 2).alias("readiness_score"), F.count_distinct("event_type").cast("int").alias("parameter_count"), F.count(F.lit(1)).alias("total_records")
    )


@query(
    f"""SELECT v.factory_id, v.name, v.rank, NOT (v.rank % 4 = 0) AS has_cto_context, CASE WHEN v.rank % 4 = 0 THEN '⚠️ Limited Regulatory Context (Missing CTO limits / Inspection baseline)' END AS context_warning, coalesce(q.coverage_percentage, 92.5) AS coverage_percentage,
    round(100 - coalesce(q.coverage_percentage, 92.5), 2) AS missing_percentage, coalesce(q.readiness_score, 84.5) AS readiness_score, coalesce(q.parameter_count, 4) AS parameter_count, avg_click, avg_view,
    CASE WHEN true_risk_category IN ('HIGH', 'CRITICAL') THEN 'Risk score is being driven by fingerprint checks: ' || coalesce(nullif(concat_ws(', ', CASE WHEN flatline_rate > 0.05 THEN 'flatline' END, CASE WHEN limit_hugging_mean > 0.05 THEN 'limit hugging' END,
    CASE WHEN coordinated_missing_flag = 1 THEN 'coordinated missing data' END, CASE WHEN impossible_val_rate <> 0 THEN 'impossible values' END), ''), 'see raw_fingerprint_signals for detail') || '.' END AS note
    FROM ({_VIEW}) v LEFT JOIN ({_QUALITY}) q USING (factory_id) LEFT JOIN ({_MEANT}) m USING (factory_id)""", "mag")  # fmt: skip
def factory_details(spark, d):
    shown = view(spark, d)
    rows = table(spark, d, "events").select(F.concat(F.lit("f"), F.lpad((F.col("user_id") % 33).cast("string"), 2, "0")).alias("factory_id"), F.col("event_type").alias("parameter_id"), "value")
    out = views.details(shown, quality_of_users(spark, d), views.parameter_means(rows, rows), shown.filter("rank % 4 = 0"), {"avg_click": "click", "avg_view": "view"})
    return out.select("factory_id", "name", "rank", "has_cto_context", "context_warning", "coverage_percentage", F.round("missing_percentage", 2).alias("missing_percentage"), "readiness_score", "parameter_count", "avg_click", "avg_view", "note")


@query(f"SELECT factory_id, tsi_score, round(anomaly_score, 4) AS anomaly_score, coalesce(CASE WHEN rank % 2 = 0 THEN rank / 100.0 END, 0.942) AS seed_stability_index FROM ({_VIEW})", "mag")
def factory_predictions(spark, d):
    shown = view(spark, d)
    return views.predictions(shown, shown.filter("rank % 2 = 0").select("factory_id", (F.col("rank") / 100.0).alias("stability")))


@query("SELECT factory_id, inspection_date, status FROM insp WHERE factory_id = 'site_1'", "insp")
def inspection_history(spark, d):
    return views.inspection_history(insp(spark, d), "site_1").select("factory_id", "inspection_date", "status")


@query(f"SELECT factory_id, coverage_percentage, round(100 - coverage_percentage, 2) AS missing_percentage, CASE WHEN coverage_percentage >= 90 THEN 'A' WHEN coverage_percentage >= 75 THEN 'B' WHEN coverage_percentage >= 50 THEN 'C' WHEN coverage_percentage >= 25 THEN 'D' ELSE 'F' END AS quality_grade, readiness_score, total_records, CAST(sum(total_records) OVER () AS BIGINT) AS total_records_processed FROM ({_QUALITY})")
def data_quality_view(spark, d):
    rows = quality_of_users(spark, d)
    return views.data_quality(rows.withColumn("quality_grade", profile.grade(F.col("coverage_percentage")))).withColumn("missing_percentage", F.round("missing_percentage", 2))


@query(f"SELECT region, count(*) AS total_sites, count(*) FILTER (risk_tier = 'High') AS high_risk_count, round_even(avg(tsi_score), 2) AS avg_tsi_score FROM ({_VIEW}) GROUP BY 1", "mag")
def oversight_regions(spark, d):
    return views.oversight(view(spark, d))


@query(f"SELECT factory_id, name, rank, tsi_score, risk_tier, CASE risk_tier WHEN 'High' THEN 'CRITICAL - IMMEDIATE UNANNOUNCED AUDIT' WHEN 'Medium' THEN 'HIGH - MANDATE SENSOR CALIBRATION' ELSE 'ROUTINE MONITORED' END AS priority FROM ({_VIEW}) WHERE rank <= 5", "mag")
def oversight_dispatch(spark, d):
    return views.dispatch_queue(view(spark, d))


@query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 > 0 AND n_nationkey % 5 > 0 THEN 'live ' || n_name END, n_name) AS name, n_regionkey AS region FROM nation UNION ALL SELECT s_suppkey, 'live', NULL FROM supplier WHERE s_suppkey BETWEEN 30 AND 40")
def live_with_fallback(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    live = n.filter("n_nationkey % 3 > 0").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.when(F.col("n_nationkey") % 5 > 0, F.concat(F.lit("live "), F.col("name"))).alias("name"))
    return views.with_fallback(n, live.union(table(spark, d, "supplier").filter("s_suppkey between 30 and 40").select("s_suppkey", F.lit("live"))), "n_nationkey")


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS rows_with_infinity, count(*) FILTER (value < 0) AS negative_values, CAST(0 AS BIGINT) AS tamper_kinds, CAST(['corr_x'] AS VARCHAR[]) AS missing_columns FROM clean", "clean")
def verify_features(spark, d):
    return aggregates.verify_features(clean(spark, d), ["value", "corr_x"])


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Consent To Operate' WHEN 1 THEN 'Consent to Operate' WHEN 2 THEN 'Cte' ELSE 'Renewal Of Consent' END AS consent_type, CASE WHEN o_orderkey % 4 IN (0, 3) THEN day END AS issue_date,
    CASE o_orderkey % 4 WHEN 0 THEN day + 2 WHEN 2 THEN day WHEN 3 THEN day END AS valid_from, CASE WHEN o_orderkey % 4 <> 1 THEN day + CAST(o_custkey AS INTEGER) END AS valid_until FROM (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders)""")  # fmt: skip
def consent_metadata(spark, d):
    k, on = F.col("o_orderkey"), lambda c, f: F.date_format(F.date_add(F.to_date("o_orderdate"), c), f)
    until, say = F.col("o_custkey").cast("int"), lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    text = (
        F.when(k % 4 == 0, say("CONSENT TO OPERATE dated ", on(0, "dd/MM/yyyy"), ", valid   from ", on(2, "dd.MM.yyyy"), " valid\nup to ", on(until, "dd-MM-yyyy")))
        .when(k % 4 == 1, say("Renewal, see ", on(0, "dd.MM.yyyy"))).when(k % 4 == 2, say("CTE, after a consent to operate: ", on(0, "dd/MM/yyyy"), " and ", on(until, "dd/MM/yyyy")))
        .otherwise(say("Renewal of consent, date: ", on(0, "dd-MM-yyyy"), " valid till ", on(until, "dd.MM.yyyy")))
    )
    return table(spark, d, "orders").select("o_orderkey", scalars.consent_metadata(text).alias("m")).select("o_orderkey", "m.*")


# -- models and injection (no SQL form) -----------------------------------------------------------------------

_MODEL = ["flatline", "limit_hugging", "copy_paste", "missing"]


_RAW = ["value", "rolling_mean", "rolling_std", "rolling_cov", "flatline_flag", *_CORR, "autocorrelation", "missing_rate", "limit_hugging"]


def model_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(features of the readings of 33 factories, their aggregates and labels, the aggregates that every factory has)."""
    name = F.concat(F.lit("f"), F.lpad((F.col("user_id") % 33).cast("string"), 2, "0"))
    rows = tel(spark, d).withColumn("factory_id", name)
    readings = telemetry.quality_filter(rows).select("factory_id", "parameter_id", "timestamp", "value", "quality_code", "event_id")
    q = lambda x: F.percentile("value", F.lit(x))
    limits = readings.groupBy("factory_id", "parameter_id").agg(q(0.9).alias("upper_limit"), q(0.05).alias("lower_limit"))
    matrix = feature_matrix.build(readings, telemetry.quality_report(rows), limits, CFG, ["event_id"], largest=True)
    labels = triggered(spark, d).select("factory_id", "total_fingerprints_triggered", (F.col("total_fingerprints_triggered") >= 3).cast("int").alias("label"))
    matrix = sinks.written(matrix.select("factory_id", *_RAW))
    table_ = sinks.written(models.factory_aggregates(matrix, _RAW).join(labels, "factory_id"))
    return matrix, table_, models.complete_columns(table_, [f"{c}_{k}" for c in _RAW for k in ("mean", "std")])


@query()
def tamper_model_loo(spark, d):
    _, rows, columns = model_rows(spark, d)
    out = models.leave_one_out(rows, "factory_id", columns, "label")
    return out.join(rows.select("factory_id", "total_fingerprints_triggered"), "factory_id")


@query()
def tamper_model_gates(spark, d):
    return models.gates(tamper_model_loo(spark, d), count="total_fingerprints_triggered")


@query(
    f"""SELECT *, coalesce(auc >= 0.75 AND abs(flag_rate - rate) <= 0.15 AND spearman >= 0.6, false) AS passes FROM (SELECT round((SELECT avg(CASE WHEN a.probability > b.probability THEN 1.0 WHEN a.probability = b.probability THEN 0.5 ELSE 0.0 END)
    FROM s a, s b WHERE a.label = 1 AND b.label = 0), 6) AS auc, round(avg(CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS flag_rate, round(corr(rp, rc), 6) AS spearman, avg(label) AS rate
    FROM (SELECT *, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS rp, rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0 AS rc FROM s))""", "mag")  # fmt: skip
def gate_measures(spark, d):
    rows = triggered(spark, d).withColumn("label", (F.col("total_fingerprints_triggered") >= 2).cast("int"))
    return models.gates(rows, count="total_fingerprints_triggered").withColumns({c: F.round(c, 6) for c in ("auc", "flag_rate", "spearman")})


SQL["gate_measures"] = SQL["gate_measures"].replace(" SELECT *, coalesce(auc", f", s AS (SELECT factory_id, probability, total, CASE WHEN total >= 2 THEN 1 ELSE 0 END AS label FROM ({_ALL})) SELECT * EXCLUDE (rate), coalesce(auc", 1)


@query()
def tamper_probability(spark, d):
    matrix, rows, columns = model_rows(spark, d)
    return models.factory_probability(matrix, models.fit_tamper_model(rows, columns, "label"), _RAW)


def scored_rows(spark: SparkSession, d: str) -> DataFrame:
    """What forests are fitted on and score; written, since fitting reads it several times."""
    return sinks.written(features(spark, d).select("factory_id", "event_id", *_RAW))


@query()
def iso_scores(spark, d):
    rows, columns = scored_rows(spark, d), _RAW
    model = models.fit_isolation_forest(rows, columns, ["event_id"])
    return models.score_isolation_forest(rows, model, columns).groupBy("factory_id").agg(F.avg("anomaly_score").alias("anomaly_score"))


_COEFFICIENTS = [0.5, -0.25, 0.1, 1.0]


@query(
    "SELECT factory_id, CAST(row_number() OVER (PARTITION BY factory_id ORDER BY abs(shap) DESC, i) - 1 AS INTEGER) AS place, feature, raw_value, shap FROM ("
    + " UNION ALL ".join(f"SELECT factory_id, {i} AS i, '{c}' AS feature, {c} AS raw_value, round({b} * ({c} - avg({c}) OVER ()), 4) AS shap FROM mag" for i, (c, b) in enumerate(zip(_MODEL, _COEFFICIENTS))) + ")", "mag")
def linear_shap(spark, d):
    return models.linear_attribution(mag(spark, d), "factory_id", _MODEL, _COEFFICIENTS)


@query()
def kernel_shap(spark, d):
    rows, columns = scored_rows(spark, d), _RAW
    return models.kernel_attribution(rows, models.fit_isolation_forest(rows, columns, ["event_id"]), "factory_id", columns, ["event_id"])


@query()
def inject_tampers(spark, d):
    return inject.inject(clean(spark, d).select("factory_id", "parameter_id", "timestamp", "event_id", "value", "quality_code"), "event_id")


@query()
def injected_events(spark, d):
    """Events of one month instead of two half-years, since that is what ``events`` spans."""
    rows = clean(spark, d).select("factory_id", "parameter_id", "timestamp", "event_id", "value", "quality_code")
    month = {kind: (times, least, most, 20, ((1, 3),), False) for kind, (times, least, most, *_) in inject.EVENTS.items()}
    given = spark.createDataFrame([], inject.LABELS)
    return inject.inject_events(rows, given, inject.draw_labels(rows, given, events=month), "event_id")[0]


@query()
def seed_stability(spark, d):
    rows = scored_rows(spark, d)
    return models.seed_stability(rows, models.fit_seeds(rows, _RAW, ["event_id"], [42, 43, 44, 45, 46]), "factory_id", _RAW, ["event_id"])
