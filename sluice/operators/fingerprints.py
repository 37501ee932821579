"""Eight tamper fingerprints of each factory, and the rules that trigger them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from . import aggregates, joins

#: Fingerprint -> the magnitude beyond which it triggers (correlation_break has a measured one).
TRIGGERS = {"impossible_ph_range": 0.0, "flatline": 5.0, "limit_hugging": 5.0, "copy_paste": 1.0, "coordinated_missing_data": 1.5, "data_integrity": 1.5}
DIP_BELOW = -20.0
ORDER = ["impossible_ph_range", "inspection_dip", "flatline", "limit_hugging", "correlation_break", "copy_paste", "coordinated_missing_data", "data_integrity"]


def impossible_ph(readings: DataFrame, limits: DataFrame, ph: str = "ETP-pH") -> DataFrame:
    """(factory_id, impossible_ph_range, impossible_ph_count): share of pH values outside 0..14 or the factory's limits.

    ``limits``: at most one row per factory with lower_limit and upper_limit.
    """
    v = F.col("value")
    rows = readings.filter((F.col("parameter_id") == ph) & v.isNotNull()).join(limits.select("factory_id", "lower_limit", "upper_limit"), "factory_id", "left")
    bad = (v < 0) | (v > 14) | F.coalesce(v < F.col("lower_limit"), F.lit(False)) | F.coalesce(v > F.col("upper_limit"), F.lit(False))
    found = rows.groupBy("factory_id").agg(numeric.percent_of(bad, v).alias("impossible_ph_range"), F.count_if(bad).alias("impossible_ph_count"))
    every = readings.select("factory_id").distinct()
    return every.join(found, "factory_id", "left").fillna({"impossible_ph_range": 0.0, "impossible_ph_count": 0})


def inspection_dip(readings: DataFrame, inspections: DataFrame, first_day: str = "2024-01-01") -> DataFrame:
    """(factory_id, inspection_dip): the mean change of readings in the 72 hours before completed inspections, in percent.

    The window ends at the inspection, or just after the last reading if that is more than 72 hours earlier.
    The baseline is the 30 days before the window (not before ``first_day``), or with fewer than five readings
    the whole series.
    """
    done = inspections.filter(F.col("status") == "Completed").select("factory_id", "inspection_date").distinct()
    done = joins.as_of_before(done, readings, "factory_id", "inspection_date", "timestamp", "latest").filter("latest is not null")
    at = F.col("inspection_date").cast("timestamp_ntz")
    done = done.withColumn("pre_end", F.when(F.col("latest") >= at - F.expr("interval 72 hours"), at).otherwise(F.col("latest") + F.expr("interval 1 second")))
    done = done.withColumn("pre_start", F.col("pre_end") - F.expr("interval 72 hours"))
    done = done.withColumn("base_start", F.greatest(F.lit(first_day).cast("timestamp_ntz"), F.col("pre_start") - F.expr("interval 30 days")))
    known = readings.filter("value is not null")
    pre, base = F.col("rt") >= F.col("pre_start"), F.col("rt") < F.col("pre_start")
    key = ["factory_id", "inspection_date", "pre_start"]
    seen = joins.in_windows(done, known, key, "base_start", "pre_end", [F.avg(F.when(pre, F.col("value"))).alias("m_pre"), F.avg(F.when(base, F.col("value"))).alias("m_base"), F.count_if(base).alias("n_base")])
    whole = known.groupBy("factory_id", "parameter_id").agg(F.avg("value").alias("m_all"))
    both = seen.filter("m_pre is not null").join(whole, ["factory_id", "parameter_id"])
    m = F.when(F.col("n_base") < 5, F.col("m_all")).otherwise(F.col("m_base"))
    change = F.when(m > 0, F.lit(100.0) * F.try_divide(F.col("m_pre") - m, m)).when(m == 0, F.when(F.col("m_pre") == 0, 0.0).otherwise(100.0))
    dips = both.withColumn("change", change).groupBy("factory_id").agg(F.avg("change").alias("inspection_dip"))
    return readings.select("factory_id").distinct().join(dips, "factory_id", "left")


def summarise(features: DataFrame, correlation_columns: list[str]) -> DataFrame:
    """Per factory, in one pass over the feature matrix: flatline, limit_hugging, copy_paste, correlation_break, missing, errors.

    The first three are percentages of the readings that have the feature, correlation_break the mean of the
    rows' mean correlations, missing the mean missing rate and errors the quality error rate in percent.
    """
    of = numeric.percent_of
    present = F.filter(F.array(*(F.col(f"`{c}`") for c in correlation_columns)), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present))
    return features.groupBy("factory_id").agg(
        of(F.col("flatline_flag") == 1, F.col("flatline_flag")).alias("flatline"),
        of(F.col("limit_hugging") == 1, F.col("limit_hugging")).alias("limit_hugging"),
        of(F.col("autocorrelation") > 0.95, F.col("autocorrelation")).alias("copy_paste"),
        F.avg(mean).alias("correlation_break"), F.avg("missing_rate").alias("missing"), (100 * F.max("quality_error_rate")).alias("errors"),
    )


def triggers(scores: DataFrame) -> DataFrame:
    """trig_<fingerprint> (0 or 1) for each, and total_fingerprints_triggered; unknown magnitudes do not trigger.

    ``scores`` holds the eight magnitudes and ``threshold`` for correlation_break.
    """
    rules = {k: F.col(k) > v for k, v in TRIGGERS.items()} | {"inspection_dip": F.col("inspection_dip") < DIP_BELOW, "correlation_break": F.col("correlation_break") < F.col("threshold")}
    out = scores.withColumns({f"trig_{k}": F.coalesce(rules[k], F.lit(False)).cast("int") for k in ORDER})
    return out.withColumn("total_fingerprints_triggered", sum((F.col(f"trig_{k}") for k in ORDER), F.lit(0)))
