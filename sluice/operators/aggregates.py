"""Grouped summaries, conditional percentages, thresholds over the data set, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n), the null group included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    c = F.col(column)
    p = lambda x: F.percentile(c, F.lit(x))
    return df.groupBy(*by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"), F.max(c).alias("max")
    )


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the percentage of nulls in each column, rounded to two digits."""
    return df.agg(*(F.round(100 * F.avg(F.col(f"`{c}`").isNull().cast("double")), 2).alias(c) for c in columns))


def infinite_counts(df: DataFrame) -> DataFrame:
    """One row: how many infinite values each floating-point column holds."""
    return df.agg(*(F.count_if(F.abs(f"`{f.name}`") == float("inf")).alias(f.name) for f in df.schema if f.dataType.typeName() in ("double", "float")))


def mean_std_wide(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """column_mean and column_std (sample) of each group."""
    return df.groupBy(by).agg(*(a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))))


def complete_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns without any null; one pass, one row to the driver."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    return [c for c in columns if not counts[c]]


def below_typical(df: DataFrame, column: str) -> DataFrame:
    """Each group's value beside ``threshold``: mean - population deviation over all groups that have one.

    For tables of one row per group, as is `from_median`: a window over all rows reads what lies below it once,
    where a joined-back aggregate would compute it again.
    """
    every = W.partitionBy()
    return df.withColumn("threshold", F.avg(column).over(every) - F.stddev_pop(column).over(every))


def from_median(df: DataFrame, column: str, name: str) -> DataFrame:
    """(value - median) / population deviation over all rows; missing values count as 0, and so does the result without spread."""
    every, v = W.partitionBy(), F.coalesce(F.col(column), F.lit(0.0))
    return df.withColumn(name, F.coalesce(F.try_divide(v - numeric.median(v).over(every), F.stddev_pop(v).over(every)), F.lit(0.0)))


def exact_medians(df: DataFrame, columns: list[str], near: float = 0.0005) -> dict[str, float | None]:
    """The exact, linearly interpolated median of each column on the driver; null without values.  ``df`` is read three times.

    Approximate quantiles cut out a range of ``near`` of the values on each side of the middle, all are counted against it, and only what
    lies inside is ranked, so that no task holds all distinct values of a column.  A range that turns out not to hold the middle is dropped
    for the whole column.
    """
    v = [F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    if not columns:
        return {}
    rows, names = df.select(*v), [f"v{i}" for i in range(len(columns))]
    seen = rows.agg(*(a for c in names for a in (F.count(c).alias(f"n_{c}"), F.percentile_approx(c, [0.5 - near, 0.5 + near], 10_000).alias(f"r_{c}"), F.min(c).alias(f"a_{c}"), F.max(c).alias(f"z_{c}")))).first()
    some = [c for c in names if seen[f"n_{c}"]]
    if not some:
        return dict.fromkeys(columns)
    count = lambda cut: rows.agg(*(a for c, (lo, hi) in cut.items() for a in (F.count_if(F.col(c) < lo).alias(f"b_{c}"), F.count_if(F.col(c) <= hi).alias(f"u_{c}")))).first()
    cut = {c: tuple(seen[f"r_{c}"]) for c in some}
    middle = {c: ((seen[f"n_{c}"] - 1) // 2, seen[f"n_{c}"] // 2) for c in some}
    at = count(cut).asDict()
    if missed := {c: (seen[f"a_{c}"], seen[f"z_{c}"]) for c in some if not at[f"b_{c}"] <= middle[c][0] <= middle[c][1] < at[f"u_{c}"]}:
        cut, at = cut | missed, at | count(missed).asDict()
    inside = rows.select(*(F.when(F.col(c).between(*cut[c]), F.col(c)).alias(c) for c in some))
    # the k-th of m values: the first whose share of values up to it reaches (k + 1/2) / m
    kth = lambda c, k: F.expr(f"percentile_disc({(k - at[f'b_{c}'] + 0.5) / (at[f'u_{c}'] - at[f'b_{c}'])!r}D) within group (order by {c})")
    found = inside.agg(*(kth(c, k).alias(f"{side}_{c}") for c in some for side, k in zip("lh", middle[c]))).first()
    return {c: (found[f"l_{n}"] + found[f"h_{n}"]) / 2 if n in cut else None for c, n in zip(columns, names)}


def surplus_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat a key."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def never_filled(df: DataFrame, column: str, by: str) -> DataFrame:
    """The groups that have no value at all."""
    return df.groupBy(by).agg(F.count(column).alias("n")).filter("n = 0").select(by)


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    medians = df.agg(*(numeric.median(F.col(c)).alias(f"_{c}") for c in columns))
    return df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))


def histogram(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(column, place, n, share): every grade of ``order`` counted, absent ones with 0."""
    grades = df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(order)], f"{column} string, place int")
    n = grades.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(column, "place", "n", F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("n"), "total"), F.lit(0.0)), 1).alias("share"))


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*(F.avg(c).alias(f"_{c}") for c in columns))
    return df.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))


def verify_features(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether the columns are there, hold no infinity, and whether negative values and every tamper kind survived."""
    missing = [c for c in columns if c not in features.columns]
    floats = [f.name for f in features.schema if f.dataType.typeName() == "double"]
    infinite = F.count_if(sum(((F.abs(f"`{c}`") == float("inf")).cast("int") for c in floats), F.lit(0)) > 0)
    kinds = F.count_distinct("tamper_type") if "tamper_type" in features.columns else F.lit(0)
    return features.agg(F.count(F.lit(1)).alias("rows"), infinite.alias("rows_with_infinity"), F.count_if(F.col("value") < 0).alias("negative_values"), kinds.cast("long").alias("tamper_kinds")).withColumn("missing_columns", F.array(*map(F.lit, missing)).cast("array<string>"))
