"""Coverage of a regular grid: sessions of readings and gaps, and what parts of the calendar hold readings.

Readings are first reduced to the slots of the grid that they hit, so a series costs what its span costs and not what its
rows do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SERIES = ["factory_id", "parameter_id"]
#: Classes of steps between neighbouring readings by their upper bounds in minutes, the last without one.
GAP_CLASSES = [("0-15m", 15), ("15m-1h", 60), ("1h-6h", 360), ("6h-24h", 1440), (">24h", None)]
#: The hours of night and business, in whole hours of the day.
NIGHT_HOURS, BUSINESS_HOURS = (22, 23, 0, 1, 2, 3, 4, 5), tuple(range(9, 18))


def slots(readings: DataFrame, keys: list[str] = SERIES, minutes: int = 15) -> DataFrame:
    """(keys, slot, readings, on_grid): the slots of ``minutes`` since 1970 that hold readings, how many, and how many right on the grid."""
    second = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', timestamp)")
    width = minutes * 60_000_000
    rows = readings.filter("timestamp is not null").select(*keys, F.floor(second / width).alias("slot"), F.pmod(second, F.lit(width)).alias("off"))
    return rows.groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("readings"), F.count_if(F.col("off") == 0).alias("on_grid"))


def _steps(readings: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("slot")
    return slots(readings, keys, minutes).withColumn("step", F.col("slot") - F.lag("slot").over(w))


def _expected(day: Column, minutes: int) -> Column:
    """Slots of all days from the first to the last one with readings."""
    return (F.max(day) - F.min(day) + 1) * (1440 // minutes)


def gap_summary(readings: DataFrame, keys: list[str] = SERIES, minutes: int = 15, outage_minutes: int = 120) -> DataFrame:
    """Per series: records that the grid lacks, sessions of readings and gaps, and the classes of steps between neighbours.

    keys, expected_records (slots of all days from the first to the last), missing_records, missing_percentage, missing_days,
    missing_intervals, longest_missing_duration (hours), avg_gap_duration (minutes, of steps above the grid's), largest_continuous_online
    and largest_continuous_offline (hours: the longest run of slots without a gap, the longest step above the grid's), online_hours
    (what of the expected time is covered), outage_count (steps above ``outage_minutes``, a documented assumption), and
    gap_distribution, a map from class to count.

    Readings of one slot count once; values play no part, so a null reading is a reading.  Rows without a time are left out.  A
    series with one slot has no gaps: null durations, zero counts.  An empty table gives no rows.
    """
    if 1440 % minutes:
        raise ValueError("a day must hold whole slots")
    day, gap = F.floor(F.col("slot") * minutes / 1440), F.col("step") * minutes
    rows = _steps(readings, keys, minutes)
    # a session is a run of slots that follow each other; it begins with the step of the gap before it
    rows = rows.withColumn("session", F.count_if(F.coalesce(F.col("step") > 1, F.lit(True))).over(W.partitionBy(*keys).orderBy("slot").rowsBetween(W.unboundedPreceding, 0)))
    sessions = rows.groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("step") > 1, gap)).alias("gap"), F.min(day).alias("first"), F.max(day).alias("last"))
    g = F.col("gap")
    low, counts = minutes, [F.sum("n") - F.count(F.lit(1)) + F.count_if(g <= GAP_CLASSES[0][1])]
    for _, high in GAP_CLASSES[1:]:
        counts.append(F.count_if((g > low) & (g <= high)) if high else F.count_if(g > low))
        low = high
    expected = (F.max("last") - F.min("first") + 1) * (1440 // minutes)
    out = sessions.groupBy(*keys).agg(
        expected.alias("expected_records"), (expected - F.sum("n")).alias("missing_records"), F.max(g / 60).alias("longest_missing_duration"), F.avg(g).alias("avg_gap_duration"),
        (F.max("n") * minutes / 60).alias("largest_continuous_online"), F.count_if(g > outage_minutes).alias("outage_count"),
        F.create_map(*(x for (name, _), n in zip(GAP_CLASSES, counts) for x in (F.lit(name), n))).alias("gap_distribution"),
    )
    lost = F.col("missing_records") / F.col("expected_records")
    hours = F.col("expected_records") * minutes / 60
    return out.select(
        *keys, "expected_records", "missing_records", F.round(100 * lost, 2).alias("missing_percentage"), F.round(F.col("missing_records") * minutes / 1440, 2).alias("missing_days"), F.col("missing_records").alias("missing_intervals"),
        "longest_missing_duration", "avg_gap_duration", "largest_continuous_online", F.col("longest_missing_duration").alias("largest_continuous_offline"), (hours * (1 - F.round(100 * lost, 2) / 100)).alias("online_hours"), "outage_count", "gap_distribution",
    )


def calendar_summary(readings: DataFrame, keys: list[str] = SERIES, minutes: int = 15) -> DataFrame:
    """Per series: span and steps of the readings, and the coverage of weekdays, weekends, nights, business hours, months and hours.

    keys, earliest_reading, latest_reading, monitoring_duration (days), avg_interval (the median), expected_interval, max_interval, min_interval
    (minutes between slots), timestamp_consistency (readings right on the grid, %), weekend_coverage, weekday_coverage, night_coverage,
    business_hours_coverage (slots with readings against the share of 2/7, 5/7, 8/24 and 9/24 of all expected ones, %), monthly_coverage
    and hourly_coverage: maps from month and hour to the share of covered slots, which sum to 100 but for rounding.

    The cases are those of `gap_summary`.
    """
    rows = _steps(readings, keys, minutes)
    day, minute = F.floor(F.col("slot") * minutes / 1440), F.pmod(F.col("slot") * minutes, F.lit(1440))
    rows = rows.withColumns({"day": day, "hour": F.floor(minute / 60).cast("int"), "month": F.month(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")))})
    # the first of January 1970 was a Thursday
    rows = rows.withColumn("free", F.pmod(F.col("day") + 3, F.lit(7)) >= 5)
    n, expected = F.count(F.lit(1)), _expected(F.col("day"), minutes)
    share = lambda c: F.round(100 * F.count_if(c) / n, 2)
    covered = lambda c, part: 100 * F.count_if(c) / (expected * part)
    table = lambda column, values: F.create_map(*(x for v in values for x in (F.lit(v), share(F.col(column) == v))))
    ends = readings.groupBy(*keys).agg(F.min("timestamp").alias("earliest_reading"), F.max("timestamp").alias("latest_reading"))
    out = rows.groupBy(*keys).agg(
        (F.percentile("step", F.lit(0.5)) * minutes).alias("avg_interval"), F.lit(minutes).alias("expected_interval"), (F.max("step") * minutes).alias("max_interval"), (F.min("step") * minutes).alias("min_interval"),
        (100 * F.sum("on_grid") / F.sum("readings")).alias("timestamp_consistency"), covered(F.col("free"), F.lit(2) / 7).alias("weekend_coverage"), covered(~F.col("free"), F.lit(5) / 7).alias("weekday_coverage"),
        table("month", range(1, 13)).alias("monthly_coverage"), table("hour", range(24)).alias("hourly_coverage"),
        covered(F.col("hour").isin(*NIGHT_HOURS), F.lit(len(NIGHT_HOURS)) / 24).alias("night_coverage"), covered(F.col("hour").isin(*BUSINESS_HOURS), F.lit(len(BUSINESS_HOURS)) / 24).alias("business_hours_coverage"),
    )
    seconds = F.expr("timestampdiff(SECOND, earliest_reading, latest_reading)")
    return ends.join(out, keys).withColumn("monitoring_duration", F.round(seconds / 86400, 2))
