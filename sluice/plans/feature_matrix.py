"""The feature matrix: every rolling feature of every reading, rows kept as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..functions import scalars
from ..operators import windows as w
from ..sources import telemetry


def own_limits(limits: DataFrame) -> DataFrame:
    """One row per (factory, standard parameter): limits of the factory itself with a positive maximum, of highest confidence."""
    rows = limits.withColumn("parameter_id", scalars.standard_parameter(F.col("parameter_id"))).filter("parameter_id is not null and proxy_source_factory_id is null and upper_limit > 0")
    return w.keep_first(rows, ["factory_id", "parameter_id"], [F.col("extraction_confidence").desc_nulls_last(), F.col("id").asc()])


def build(readings: DataFrame, report: DataFrame, limits: DataFrame, cfg: FeatureConfig, tie: list[str] | None = None, synthetic: bool = False, largest: bool = False) -> DataFrame:
    """All features of (factory_id, parameter_id, timestamp, value, quality_code) readings.

    Windows over one series come first and share one exchange and sort; what needs a factory's parameters side
    by side is computed on the pivoted table, in one pass, and joined back on (factory, timestamp) once.  Two readings of one
    parameter at one time are an error there, or with ``largest`` the largest counts.
    """
    order = w.series(tie)
    rows = w.rolling_stats(readings, cfg, order)
    rows = w.flatline_fixed(rows, cfg, order) if synthetic else w.frame_deviation(rows, cfg, order)
    rows = w.run_length(w.rates(w.autocorrelation(rows, cfg, order), cfg, order), order)
    # medians last: all before them needs the order of time, they need others
    rows = w.severity(rows) if synthetic else w.flatline_and_severity(rows).drop("frame_std")
    rows = rows.join(w.side_by_side(w.wide(readings, cfg.parameters, largest), cfg), ["factory_id", "timestamp"], "left")
    rows = rows.withColumns({c: F.when(F.col("parameter_id").isin(*cfg.ratio), F.col(c)) for c in ("bod_cod_ratio", "bod_cod_ratio_volatility")})
    rows = w.limit_hugging(rows, limits, cfg)
    return rows.join(report.select("factory_id", F.col("error_rate").alias("quality_error_rate")), "factory_id", "left")


def from_files(spark, telemetry_path: str, limits_path: str, cfg: FeatureConfig) -> DataFrame:
    readings, report = telemetry.read_telemetry(spark, telemetry_path)
    return build(readings, report, own_limits(telemetry.read_limits(spark, limits_path)), cfg)
