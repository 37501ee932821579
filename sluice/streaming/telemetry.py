"""Telemetry as a stream: file source, quality filter, late data, windowed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.telemetry import KEPT_CODES


def read(spark: SparkSession, path: str, schema: str | StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_stats(readings: DataFrame, late: str = "1 hour", size: str = "2 hours", slide: str = "15 minutes") -> DataFrame:
    """Per series and sliding event-time window: readings, missing ones, mean and deviation.  ``timestamp`` is a timestamp.

    State is one row per open window and series; windows close when the watermark passes them.
    """
    kept = readings.filter(F.col("quality_code").isin(*KEPT_CODES)).withWatermark("timestamp", late)
    return kept.groupBy("factory_id", "parameter_id", F.window("timestamp", size, slide)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
