"""Factory profiles: availability, distributions, sensor health, similarity, temporal stability, quality summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric
from . import names, windows

#: The ladder of coverage grades, the weights of sensor health, the shifts that count.
GRADES = [("A", 90.0), ("B", 75.0), ("C", 50.0), ("D", 25.0)]
HEALTH = {"missing_percentage": 0.4, "duplicate_percentage": 0.2, "bdl_percentage": 0.2, "number_of_outages": 0.2}
ADVICE = {
    "full": ["Multivariate Correlation", "Diurnal Profiling", "Limit Violation Detector", "Compliance Audit"],
    "basic": ["Single Parameter Trend", "Basic Limit Compliance", "Diurnal Profiling"],
    "repair": ["Data Gap Recovery", "Sensor Calibration Audit"],
}
NO_QUARTERS = "No monitored parameters with quarterly data"
PH_SHIFT, RELATIVE_SHIFT = 0.5, 0.25


def grade(coverage: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, least in GRADES:
        out = out.when(coverage >= least, name)
    return out.otherwise("F")


def availability(coverage: DataFrame, quality: DataFrame) -> DataFrame:
    """Coverage and quality of all factories that either table knows."""
    return coverage.join(quality, "factory_id", "full")


def distributions(stats: DataFrame, parameters: list[str], measures: list[str]) -> DataFrame:
    """A column <parameter>_<measure> for each factory."""
    wide = stats.groupBy("factory_id").pivot("parameter_id", parameters).agg(*(F.first(m).alias(m) for m in measures))
    return wide.select("factory_id", *(F.col(f"`{p}_{m}`") for p in parameters for m in measures))


def sensor_health(df: DataFrame) -> DataFrame:
    """sensor_health_score in [0, 1] from missing_percentage, duplicate_percentage, bdl_percentage (or zero_percentage) and number_of_outages.

    A hundred outages weigh as much as can be.  Nulls give a null score; a missing column raises.
    """
    bdl = "bdl_percentage" if "bdl_percentage" in df.columns else "zero_percentage"
    if lacking := [c for c in ("missing_percentage", "duplicate_percentage", bdl, "number_of_outages") if c not in df.columns]:
        raise KeyError(f"quality summary lacks {lacking}")
    outages = F.when(F.col("number_of_outages").isNotNull(), F.least(F.col("number_of_outages") / 100.0, F.lit(1.0)))
    loss = HEALTH["missing_percentage"] * F.col("missing_percentage") / 100 + HEALTH["duplicate_percentage"] * F.col("duplicate_percentage") / 100
    loss = loss + HEALTH["bdl_percentage"] * F.col(bdl) / 100 + HEALTH["number_of_outages"] * outages
    return df.withColumn("sensor_health_score", F.when(loss.isNotNull(), numeric.clip(1 - loss, 0.0, 1.0)))


def standardised(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, v): mean-imputed columns in population deviations from their mean; a column that does not vary is not scaled."""
    means = df.crossJoin(F.broadcast(df.agg(*(F.avg(c).alias(f"_i_{c}") for c in columns))))
    filled = means.select(key, *(F.coalesce(F.col(c), F.col(f"_i_{c}")).alias(c) for c in columns))
    of = filled.agg(*(a for c in columns for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    scaled = filled.crossJoin(F.broadcast(of))
    v = F.array(*((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in columns))
    return scaled.select(key, v.alias("v"))


def most_similar(vectors: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(a, place, b, similarity): the ``k`` nearest others of each vector by cosine; equals in the order of their keys.

    For tables of factories, which are few: every row meets the broadcast table, whose size is checked.
    """
    if vectors.count() > 100_000:
        raise ValueError("more vectors than one broadcast holds; use an index")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    v = vectors.select(F.col(key).alias("k"), F.col("v"), F.sqrt(dot(F.col("v"), F.col("v"))).alias("n"))
    a, b = v.select(F.col("k").alias("a"), F.col("v").alias("x"), F.col("n").alias("na")), v.select(F.col("k").alias("b"), F.col("v").alias("y"), F.col("n").alias("nb"))
    met = a.join(F.broadcast(b), F.col("a") != F.col("b")).select("a", "b", F.coalesce(F.try_divide(dot(F.col("x"), F.col("y")), F.col("na") * F.col("nb")), F.lit(0.0)).alias("s"))
    best = met.withColumn("place", F.row_number().over(W.partitionBy("a").orderBy(F.col("s").desc(), "b"))).filter(F.col("place") <= k)
    return best.select("a", "place", "b", F.round("s", 4).alias("similarity"))


def temporal_shift(readings: DataFrame) -> DataFrame:
    """(factory_id, temporal_shift_detected, temporal_shift_summary) from the quarterly means of each parameter.

    The summary names every parameter with two quarters or more, in the order of the parameters; a fixed text stands for none.
    """
    quarters = readings.groupBy("factory_id", "parameter_id", F.quarter("timestamp").alias("quarter")).agg(F.avg("value").alias("m"))
    spread = quarters.groupBy("factory_id", "parameter_id").agg(F.count("m").alias("n"), F.min("m").alias("low"), F.max("m").alias("high"), F.avg("m").alias("mean"))
    name, shift = F.replace("parameter_id", F.lit("ETP-"), F.lit("")), F.col("high") - F.col("low")
    moved = F.when(name == "pH", shift > PH_SHIFT).otherwise(shift / (F.abs("mean") + 1e-6) > RELATIVE_SHIFT)
    measured = F.col("n") >= 2
    note = F.when(measured, F.struct("parameter_id", F.format_string("%s: Q_min=%.2f, Q_max=%.2f (shift=%.2f)", name, *(numeric.half_even(c, 2) for c in (F.col("low"), F.col("high"), shift))).alias("text")))
    out = spread.groupBy("factory_id").agg(F.coalesce(F.max(measured & moved), F.lit(False)).alias("temporal_shift_detected"), F.array_sort(F.collect_list(note)).alias("notes"))
    text = F.when(F.size("notes") > 0, F.array_join(F.transform("notes", lambda x: x["text"]), "; ")).otherwise(NO_QUARTERS)
    return out.select("factory_id", "temporal_shift_detected", text.alias("temporal_shift_summary"))


def quality_summary(readings: DataFrame, limits: DataFrame, inspections: DataFrame, tie: list[str] | None = None, factories: DataFrame | None = None) -> DataFrame:
    """One row per factory: span, counts, coverage, duplicates, gaps, grade, readiness and the fingerprints to use.

    One pass over the readings, and one for repeats.  ``limits`` holds those of each factory's latest consent.  With ``factories`` (factory_id,
    name, category) each of these has a row, also without readings, with its name and category, and inspections are counted by
    name (the column factory_name); without it, by factory_id.
    """
    v = F.col("value")
    base = readings.groupBy("factory_id").agg(
        F.min("timestamp").alias("monitoring_start"), F.max("timestamp").alias("monitoring_end"), F.count(F.lit(1)).alias("total_records"),
        F.sort_array(F.collect_set("parameter_id")).alias("parameters"), F.count_if(v.isNull()).alias("null_values"), F.count_if(v == 0).alias("zero_values"), F.count_if(v < 0).alias("negative_values"),
    )
    repeats = readings.groupBy("factory_id", "parameter_id", "timestamp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("factory_id").agg(F.sum(F.col("n") - 1).alias("duplicate_values"))
    gaps = windows.largest_gap(readings, tie)
    cto = limits.groupBy("factory_id").agg(F.lit(1).alias("has_limits"), F.count_distinct("parameter_id").alias("limited_parameters"))
    visits = inspections.groupBy("factory_id").agg(F.count(F.lit(1)).alias("inspections")) if factories is None else names.visits_by_name(factories, inspections, "factory_id", "name", "factory_name").withColumnRenamed("visits", "inspections")
    if factories is not None:
        known = factories.select("factory_id", F.col("name").alias("factory_name"), F.col("category").alias("industry_category"))
        counts = ["total_records", "null_values", "zero_values", "negative_values"]
        base = known.join(base, "factory_id", "left").fillna(0, counts).withColumn("parameters", F.coalesce("parameters", F.array().cast("array<string>")))
    rows = base.join(repeats, "factory_id", "left").join(gaps, "factory_id", "left").join(cto, "factory_id", "left").join(visits, "factory_id", "left")
    rows = rows.fillna(0, ["duplicate_values", "longest_gap_minutes", "has_limits", "limited_parameters", "inspections"])
    seconds = F.expr("timestampdiff(SECOND, monitoring_start, monitoring_end)")
    rows = rows.withColumns({"parameter_count": F.size("parameters"), "monitoring_days": F.coalesce(F.round(F.greatest(F.lit(0.1), seconds / 86400.0), 2), F.lit(0.0))})
    rows = rows.withColumns({"cto_available": F.col("has_limits") == 1, "inspection_schedule_available": F.col("inspections") > 0})
    rows = rows.withColumn("expected_records", F.coalesce(F.col("parameter_count") * (F.floor(seconds / 900) + 1), F.lit(0)))
    # a store that keeps no record of single intervals: those that lack a record in all
    rows = rows.withColumn("missing_intervals", F.greatest(F.col("expected_records") - F.col("total_records"), F.lit(0)))
    rows = rows.withColumn("coverage_percentage", F.when(F.col("expected_records") > 0, F.least(F.lit(100.0), F.round(F.try_divide(F.lit(100.0) * F.col("total_records"), "expected_records"), 2))).otherwise(0.0))
    rows = rows.withColumn("quality_grade", grade(F.col("coverage_percentage")))
    score = 0.4 * F.col("coverage_percentage") + 20 * F.least("parameter_count", F.lit(4)) / 4.0 + 15 * F.col("has_limits") + 15 * (F.col("inspections") > 0).cast("int") + 10 * F.least("monitoring_days", F.lit(180.0)) / 180.0
    rows = rows.withColumns({"readiness_score": F.round(score, 1), "average_records_per_day": F.coalesce(F.round(F.try_divide("total_records", "monitoring_days"), 2), F.lit(0.0))})
    advice = {k: F.array(*map(F.lit, v)) for k, v in ADVICE.items()}
    ready = F.col("readiness_score")
    use = F.when((ready >= 80) & (F.col("parameter_count") >= 4), advice["full"]).when(ready >= 50, advice["basic"]).otherwise(advice["repair"])
    return rows.withColumn("recommended_fingerprints", use)


def series_statistics(readings: DataFrame) -> DataFrame:
    """Per series: quartiles, spread, skewness and outliers beyond 1.5 interquartile ranges (a documented assumption)."""
    v = F.col("value")
    p = lambda x: F.percentile(v, F.lit(x))
    stats = readings.groupBy("factory_id", "parameter_id").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), p(0.05).alias("p5"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.95).alias("p95")
    )
    stats = stats.withColumns({"iqr": F.col("p75") - F.col("p25"), "cv": F.try_divide("std", "mean")})
    met = readings.join(stats.select("factory_id", "parameter_id", "p25", "p75", "iqr"), ["factory_id", "parameter_id"])
    out = (v < F.col("p25") - 1.5 * F.col("iqr")) | (v > F.col("p75") + 1.5 * F.col("iqr"))
    outliers = met.groupBy("factory_id", "parameter_id").agg(F.count_if(out).alias("outlier_count"))
    return stats.join(outliers, ["factory_id", "parameter_id"]).withColumn("outlier_percentage", F.try_divide(F.lit(100.0) * F.col("outlier_count"), "n"))
