"""Rolling features of a series.  A series is the ordered readings of one (factory, parameter); frames count rows, not time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FeatureConfig
from ..functions import numeric

SERIES = ["factory_id", "parameter_id"]


def series(tie: list[str] | None = None, keys: list[str] | None = None) -> WindowSpec:
    return W.partitionBy(*(keys or SERIES)).orderBy("timestamp", *(tie or []))


def last_rows(n: int, w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling_stats(df: DataFrame, cfg: FeatureConfig, w: WindowSpec) -> DataFrame:
    """rolling_mean, rolling_std (sample) over full frames, and rolling_cov = std / |mean| (null near 0, over 10 or infinite)."""
    v, n = F.col("value"), cfg.flatline_rows
    frame = last_rows(n, w)
    out = df.withColumns({"rolling_mean": numeric.full(v, F.avg(v), frame, n), "rolling_std": numeric.full(v, F.stddev_samp(v), frame, n)})
    ratio = F.try_divide("rolling_std", F.abs("rolling_mean"))
    return out.withColumn("rolling_cov", F.when((F.abs("rolling_mean") >= 1e-6) & (ratio <= 10), ratio))


def series_medians(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Beside each row the exact, linearly interpolated median of its series, for each name -> column of ``columns``.

    The middle rows are found by sorting, which spills; an aggregate would hold each distinct value of a series in memory.
    """
    every = W.partitionBy(*SERIES)
    rows = df.withColumns({f"_n_{name}": F.count(c).over(every) for name, c in columns.items()})
    for name, c in columns.items():
        rows = rows.withColumn(f"_at_{name}", F.row_number().over(every.orderBy(F.col(c).asc_nulls_last())))
    two = {name: F.col(f"_at_{name}").isin(F.floor((F.col(f"_n_{name}") + 1) / 2), F.floor(F.col(f"_n_{name}") / 2) + 1) for name in columns}
    rows = rows.withColumns({name: F.avg(F.when(two[name], F.col(c))).over(every) for name, c in columns.items()})
    return rows.drop(*(f"{k}_{name}" for k in ("_n", "_at") for name in columns))


def frame_deviation(df: DataFrame, cfg: FeatureConfig, w: WindowSpec) -> DataFrame:
    """frame_std: the deviation of the Raw values among the last rows, which may have any code.

    Null with fewer than two Raw values, with a null among them, or before the frame is full.
    """
    frame, raw = last_rows(cfg.flatline_rows, w), F.col("quality_code") == "Raw"
    v = F.when(raw, F.col("value"))
    ok = (F.row_number().over(w) >= cfg.flatline_rows) & (F.count_if(raw).over(frame) >= 2) & (F.count_if(raw & F.col("value").isNull()).over(frame) == 0)
    return df.withColumn("frame_std", F.when(ok, F.stddev_samp(v).over(frame)))


def _flatline(df: DataFrame, median: str) -> DataFrame:
    flag = F.when(F.col(median) == 0, F.col("frame_std") <= 0).otherwise(F.col("frame_std") < 0.1 * F.col(median))
    return df.withColumn("flatline_flag", F.when(F.col("frame_std").isNotNull(), flag.cast("double")))


def flatline_measured(df: DataFrame, cfg: FeatureConfig, w: WindowSpec) -> DataFrame:
    """frame_std, and flatline_flag with a threshold from the series itself: 0.1 times the median deviation of its frames."""
    return _flatline(series_medians(frame_deviation(df, cfg, w), {"_median": "frame_std"}), "_median").drop("_median")


def flatline_and_severity(df: DataFrame) -> DataFrame:
    """flatline_flag as `flatline_measured` has it and cov_severity, of rows that have frame_std and rolling_cov: both medians in one go."""
    rows = series_medians(df, {"_median": "frame_std", "_typical": "rolling_cov"})
    return _severity(_flatline(rows, "_median"), F.col("_typical")).drop("_median", "_typical")


def flatline_fixed(df: DataFrame, cfg: FeatureConfig, w: WindowSpec) -> DataFrame:
    """flatline_flag with a fixed threshold; null without two Raw readings in a full frame, 0.0 for an unknown deviation."""
    frame, raw = last_rows(cfg.flatline_rows, w), F.col("quality_code") == "Raw"
    sd = F.when(F.count_if(raw & F.col("value").isNull()).over(frame) == 0, F.stddev_samp(F.when(raw, F.col("value"))).over(frame))
    ok = (F.row_number().over(w) >= cfg.flatline_rows) & (F.count_if(raw).over(frame) >= 2)
    return df.withColumn("flatline_flag", F.when(ok, F.coalesce(((sd < cfg.flatline_std) | (sd == 0)).cast("double"), F.lit(0.0))))


def wide(df: DataFrame, parameters: tuple[str, ...], largest: bool = False) -> DataFrame:
    """A column per parameter for each (factory, timestamp); a second reading of one cell is an error, or with ``largest`` the largest counts."""
    value = F.max("value") if largest else F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate reading")).cast("double")).otherwise(F.first("value"))
    return df.groupBy("factory_id", "timestamp").pivot("parameter_id", list(parameters)).agg(value)


def correlation_names(parameters: tuple[str, ...]) -> list[tuple[str, str, str]]:
    ordered = sorted(parameters)
    return [(a, b, f"corr_{a}_{b}") for i, a in enumerate(ordered) for b in ordered[i + 1 :]]


def correlations(wide_: DataFrame, cfg: FeatureConfig, keep: list[str] | None = None) -> DataFrame:
    """corr_a_b for each pair of parameters over the factory's last rows, complete pairs only; beside them the columns ``keep``."""
    n = cfg.correlation_rows
    frame = last_rows(n, W.partitionBy("factory_id").orderBy("timestamp"))
    # a column that hardly varies over its own full frame has no correlations; found once per column
    still = {p: F.coalesce(numeric.full(F.col(f"`{p}`"), F.stddev_samp(f"`{p}`"), frame, n) < 1e-9, F.lit(False)) for p in cfg.parameters}
    rows = wide_.withColumns({f"_still_{p}": c for p, c in still.items()})
    moves = lambda a, b: ~(F.col(f"`_still_{a}`") | F.col(f"`_still_{b}`"))
    named = {name: F.when(moves(a, b), numeric.pearson(F.col(f"`{a}`"), F.col(f"`{b}`"), frame, n)) for a, b, name in correlation_names(cfg.parameters)}
    return rows.withColumns(named).select("factory_id", "timestamp", *(F.col(f"`{n}`") for n in named), *(keep or []))


def autocorrelation(df: DataFrame, cfg: FeatureConfig, w: WindowSpec) -> DataFrame:
    """Correlation of the last rows with those ``lag_rows`` before them."""
    out = df.withColumn("_lag", F.lag("value", cfg.lag_rows).over(w))
    return out.withColumn("autocorrelation", numeric.pearson(F.col("value"), F.col("_lag"), last_rows(cfg.lag_rows, w), cfg.lag_rows)).drop("_lag")


def rate(indicator: Column, n: int, w: WindowSpec) -> Column:
    """100 * mean of an indicator over the last ``n`` rows, by the difference of two running sums; null before ``n`` rows."""
    run = F.sum(indicator.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))
    before = F.sum(indicator.cast("long")).over(w.rowsBetween(W.unboundedPreceding, -n))
    return F.when(F.row_number().over(w) >= n, F.lit(100.0) * (run - F.coalesce(before, F.lit(0))) / n)


def rates(df: DataFrame, cfg: FeatureConfig, w: WindowSpec) -> DataFrame:
    """missing_rate and bdl_rate (readings below the detection limit, code L)."""
    low = F.coalesce(F.col("quality_code") == "L", F.lit(False))
    return df.withColumns({"missing_rate": rate(F.col("value").isNull(), cfg.rate_rows, w), "bdl_rate": rate(low, cfg.rate_rows, w)})


def run_length(df: DataFrame, w: WindowSpec, keys: list[str] | None = None) -> DataFrame:
    """duplicate_run_length: how many equal non-null values in a row end here; a null counts 1 and ends a run."""
    breaks = ~F.coalesce(F.col("value") == F.lag("value").over(w), F.lit(False))
    out = df.withColumns({"_breaks": breaks, "_at": F.row_number().over(w)})
    start = F.max(F.when(F.col("_breaks"), F.col("_at"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("duplicate_run_length", (F.col("_at") - start + 1).cast("double")).drop("_breaks", "_at")


def severity(df: DataFrame) -> DataFrame:
    """cov_severity of a reading against the median of its series; a flatline is high, an unknown rolling_cov null."""
    return _severity(series_medians(df, {"_typical": "rolling_cov"}), F.col("_typical")).drop("_typical")


def _severity(df: DataFrame, m: Column) -> DataFrame:
    r = F.try_divide("rolling_cov", F.when(F.coalesce(m, F.lit(0.0)) <= 0, F.lit(1e-6)).otherwise(m))
    ladder = F.when(r.isNull(), None).when((r <= 0.1) | (r >= 6), "high").when((r <= 0.25) | (r >= 3), "medium").when((r <= 0.5) | (r >= 1.5), "low").otherwise("none")
    return df.withColumn("cov_severity", F.when(F.col("flatline_flag") == 1, "high").otherwise(ladder))


def ratio_features(wide_: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """(factory_id, timestamp, bod_cod_ratio, bod_cod_ratio_volatility) where either parameter was read."""
    return _with_ratio(wide_, cfg).filter("_either").select("factory_id", "timestamp", "bod_cod_ratio", "bod_cod_ratio_volatility")


def _with_ratio(rows: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """``rows`` with the ratio's features and _either; frames hold only rows where either parameter was read."""
    a, b = (F.col(f"`{p}`") for p in cfg.ratio)
    rows = rows.withColumns({"_either": a.isNotNull() | b.isNotNull(), "bod_cod_ratio": F.when(a.isNotNull() & (b > 1e-6), F.try_divide(a, b))})
    frame = last_rows(cfg.rate_rows, W.partitionBy("factory_id", "_either").orderBy("timestamp"))
    r = F.col("bod_cod_ratio")
    return rows.withColumn("bod_cod_ratio_volatility", F.when(F.col("_either"), numeric.full(r, F.stddev_samp(r), frame, cfg.rate_rows)))


def side_by_side(wide_: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """(factory_id, timestamp, correlations, the ratio's features): all that needs a factory's parameters beside each other, from one exchange."""
    names = [n for *_, n in correlation_names(cfg.parameters)]
    rows = _with_ratio(wide_, cfg)
    return correlations(rows, cfg, ["bod_cod_ratio", "bod_cod_ratio_volatility"]).select("factory_id", "timestamp", *(F.col(f"`{n}`") for n in names), "bod_cod_ratio", "bod_cod_ratio_volatility")


def limit_hugging(df: DataFrame, limits: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """limit_hugging: 1.0 within ``hugging_share`` of a limit, 0.0 elsewhere and for null values, null without an upper limit.

    ``limits``: one row per (factory_id, parameter_id) with lower_limit and upper_limit.
    """
    share, v, u, lo = F.lit(cfg.hugging_share), F.col("value"), F.col("_u"), F.col("_l")
    rows = df.join(limits.select(*SERIES, F.col("upper_limit").alias("_u"), F.col("lower_limit").alias("_l")), SERIES, "left")
    near = v.between((1 - share) * u, u) | (lo.isNotNull() & v.between(lo, lo + (u - lo) * share))
    return rows.withColumn("limit_hugging", F.when(u.isNotNull(), F.coalesce(near, F.lit(False)).cast("double"))).drop("_u", "_l")


def largest_gap(df: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """(factory_id, longest_gap_minutes): whole minutes between neighbours of one parameter; 0 without neighbours."""
    gap = F.expr("timestampdiff(MINUTE, before, timestamp)")
    rows = df.withColumn("before", F.lag("timestamp").over(series(tie)))
    return rows.groupBy("factory_id").agg(F.coalesce(F.max(gap), F.lit(0)).cast("long").alias("longest_gap_minutes"))


def positions(df: DataFrame, score: str, tie: str) -> DataFrame:
    """position 1..n by descending score; equal scores take the places in the order of ``tie``.

    For tables of factories, which are few: one task.  ``ranks`` is for any table.
    """
    return df.withColumn("position", F.row_number().over(W.orderBy(F.col(score).desc_nulls_last(), tie)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def carry_forward(df: DataFrame, column: str, keys: list[str], order: list[str]) -> DataFrame:
    """Nulls take the last value before them."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def running_total(df: DataFrame, value: Column, name: str, order: str, tie: list[str], descending: bool = False, ranges: int = 200) -> DataFrame:
    """``name``: the sum of ``value`` over all rows up to this one in the order of the whole table; nulls are least.

    The values of ``order`` are cut into ``ranges`` by approximate quantiles (one pass).  Each range is a window of its
    own, and gets the sums of the ranges before it, at most ``ranges`` + 1 rows.  Any cuts give the right result; rows
    of one value stay together, and a column that is no number or time is one range.  ``df`` must give the same rows twice.
    """
    kind = df.schema[order].dataType
    cuts = []
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        cuts = sorted(set(df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)])).first()[0] or []))
    marks = F.array(*(F.lit(c).cast(kind) for c in cuts)) if cuts else None
    rows = df.withColumn("_range", F.size(F.filter(marks, lambda c: c < F.col(order))) if cuts else F.lit(0))
    turn = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_first())
    sums = rows.groupBy(F.col("_range").alias("_of")).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy(turn("_of")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = rows.join(F.broadcast(sums.select("_of", before.alias("_before"))), F.col("_range") == F.col("_of"))
    w = W.partitionBy("_range").orderBy(turn(order), *tie).rowsBetween(W.unboundedPreceding, 0)
    return met.withColumn(name, F.sum(value).over(w) + F.col("_before")).drop("_range", "_of", "_before")


def ranks(df: DataFrame, score: str, tie: str) -> DataFrame:
    """position 1..n by descending score, equal scores in the order of ``tie``; of a table of any size."""
    return running_total(df, F.lit(1), "position", score, [tie], descending=True).withColumn("position", F.col("position").cast("int"))


def running_offset(df: DataFrame, column: str, order: str, tie: list[str]) -> DataFrame:
    """offset: the running total before the row."""
    return running_total(df, F.col(column), "offset", order, tie).withColumn("offset", F.col("offset") - F.col(column))


def every_kth(df: DataFrame, k: int, order: str, tie: list[str]) -> DataFrame:
    """Rows 1, k + 1, 2k + 1, ... in order."""
    return running_total(df, F.lit(1), "_n", order, tie).filter((F.col("_n") - 1) % k == 0).drop("_n")
