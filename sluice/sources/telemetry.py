"""Reading telemetry, limits and labels; quality filter and report; unpivoting of scraped tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import numeric, scalars

#: The quality codes that stay.
KEPT_CODES = ("Raw", "L")


def kept(code="quality_code"):
    """Is the code one of those that stay?  Null codes do not."""
    return F.coalesce(F.col(code).isin(*KEPT_CODES), F.lit(False))


def quality_report(readings: DataFrame) -> DataFrame:
    """(factory_id, total_rows, kept_rows, dropped_rows, error_rate): what the quality filter drops of each factory."""
    counts = readings.groupBy("factory_id").agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(kept()).alias("kept_rows"))
    dropped = F.col("total_rows") - F.col("kept_rows")
    return counts.select("factory_id", "total_rows", "kept_rows", dropped.alias("dropped_rows"), F.round(F.try_divide(dropped, "total_rows"), 4).alias("error_rate"))


def quality_filter(readings: DataFrame) -> DataFrame:
    return readings.filter(F.col("quality_code").isin(*KEPT_CODES))


def read_named(spark: SparkSession, path: str, required: list[str], optional: list[str] = (), kinds: str | None = None) -> DataFrame:
    """CSV columns by the names of the header, whatever their order; a required one that is absent is an error.

    All columns are text, or of the types that ``kinds`` (a schema) names; what does not fit its type is null.  Optional columns
    that are absent are null.  Other columns are left out.
    """
    lines = spark.read.option("header", True).option("inferSchema", False).csv(path)  # only the header is read for this
    if lacking := [c for c in required if c not in lines.columns]:
        raise ValueError(f"columns are lacking: {', '.join(lacking)}")
    types = {} if kinds is None else {f.name: f.dataType for f in StructType.fromDDL(kinds)}
    out = {c: F.col(f"`{c}`") if c in lines.columns else F.lit(None).cast("string") for c in [*required, *optional]}
    return lines.select(*((x.try_cast(types[c]) if c in types else x).alias(c) for c, x in out.items()))


def _time(column: str) -> Column:
    """A time stamp of the text; a text that is none fails the job."""
    ts = F.try_to_timestamp(column, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return F.when(ts.isNull(), F.raise_error(F.concat(F.lit("not a time stamp: "), F.coalesce(column, F.lit("null"))))).otherwise(ts)


def read_telemetry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(readings, quality report) from CSV.  Values that are no numbers become null; a bad time stamp fails."""
    raw = read_named(spark, path, schemas.names(schemas.TELEMETRY_TEXT))
    value = numeric.no_nan(F.col("value").try_cast("double"))
    return quality_filter(raw).select("factory_id", "parameter_id", _time("timestamp").alias("timestamp"), value.alias("value"), "quality_code"), quality_report(raw)


def read_limits(spark: SparkSession, path: str) -> DataFrame:
    """Limits with parameter_id, lower_limit and upper_limit; the four columns that a limit needs must be there."""
    needed = ["factory_id", "parameter", "minimum_limit", "maximum_limit"]
    limits = read_named(spark, path, needed, [c for c in schemas.names(schemas.LIMITS) if c not in needed], schemas.LIMITS)
    return limits.select(*schemas.names(schemas.LIMITS)).withColumnsRenamed({"parameter": "parameter_id", "minimum_limit": "lower_limit", "maximum_limit": "upper_limit"})


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of tampering from CSV, numbered as `joins.label_intervals` takes them: later rows of the file win."""
    text = read_named(spark, path, schemas.names(schemas.LABELS))
    # places in the file: numbers grow along the file's parts, with gaps
    return text.select("factory_id", "parameter_id", "tamper_type", _time("start_timestamp").alias("start_timestamp"), _time("end_timestamp").alias("end_timestamp"), "severity", F.monotonically_increasing_id().alias("label_order"))


def read_synthetic(spark: SparkSession, readings: str, labels: str) -> tuple[DataFrame, DataFrame]:
    """(readings, labels) of a synthetic data set: no quality filter, a missing quality code is Raw, is_valid says that there is a value."""
    raw = read_named(spark, readings, ["factory_id", "parameter_id", "timestamp", "value"], ["quality_code"])
    rows = raw.select("factory_id", "parameter_id", _time("timestamp").alias("timestamp"), numeric.no_nan(F.col("value").try_cast("double")).alias("value"), F.coalesce("quality_code", F.lit("Raw")).alias("quality_code"))
    return with_defaults(rows), read_labels(spark, labels)


def read_reference(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """coverage, quality, statistics, parameter (CSV, the newer version if there is one) and features (Parquet) of a folder of summaries."""
    tables = {k: spark.read.option("header", True).csv(versioned(spark, folder, f"dataset_{k}_summary")) for k in ("coverage", "quality", "statistics", "parameter")}
    return tables | {"features": spark.read.parquet(versioned(spark, folder, "real_features", ".parquet"))}


def with_defaults(readings: DataFrame) -> DataFrame:
    """Synthetic readings: a missing quality code is Raw; is_valid says that there is a value."""
    if "quality_code" not in readings.columns:
        readings = readings.withColumn("quality_code", F.lit("Raw"))
    return readings.withColumn("is_valid", F.col("value").isNotNull())


def versioned(spark: SparkSession, folder: str, name: str, suffix: str = ".csv") -> str:
    """``name_v2`` if it is there, else ``name``; any store that the cluster knows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for candidate in (f"{folder}/{name}_v2{suffix}", f"{folder}/{name}{suffix}"):
        path = hadoop.Path(candidate)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return candidate
    raise FileNotFoundError(f"{folder}/{name}{suffix}")


def unpivot_cells(wide: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, parameter_id, value, code) from columns ``PARAM_suffix`` of cell literals.

    Cells without a number give no row and take no key; of equal keys the first row counts.  Codes get their names.
    """
    columns = [c for c in wide.columns if c not in {*keys, order}]
    long = wide.unpivot([*keys, order], columns, "column", "cell")
    long = long.withColumn("parameter_id", F.regexp_replace("column", "_[^_]*$", "")).withColumn("parsed", scalars.cell(F.col("cell")))
    first = long.filter("parsed is not null").withColumn("place", F.row_number().over(W.partitionBy(*keys, "parameter_id").orderBy(order, "column")))
    return first.filter("place = 1").select(*keys, "parameter_id", "parsed.value", scalars.quality_name(F.col("parsed.code")).alias("code"))


def chunks(spans: DataFrame, first: str, last: str, days: int | None = 7) -> DataFrame:
    """``spans`` with start and end: closed ranges of at most ``days`` days, or of calendar steps of a month, that cover each row's dates.

    ``first`` and ``last`` are columns of dates; a row whose first date is null or after its last has no ranges.
    """
    a, b = F.col(first).cast("date"), F.col(last).cast("date")
    step = F.make_interval(days=F.lit(days)) if days else F.make_interval(months=F.lit(1))
    rows = spans.filter(a <= b).withColumn("start", F.explode(F.sequence(a, b, step)))
    return rows.withColumn("end", F.least(F.date_add("start", days - 1) if days else F.last_day("start"), b))


def _span(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.lit(first).cast("date").alias("first"), F.lit(last).cast("date").alias("last"))


def date_chunks(spark: SparkSession, first: str, last: str, days: int = 7) -> DataFrame:
    """(start, end): closed ranges of at most ``days`` days that cover the two dates and what lies between."""
    return chunks(_span(spark, first, last), "first", "last", days).select("start", "end")


def month_chunks(spark: SparkSession, first: str, last: str) -> DataFrame:
    return chunks(_span(spark, first, last), "first", "last", None).select("start", "end")


def decode_response(body: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of ``parameterDetails.bodyContent`` in base64-coded JSON."""
    parsed = F.from_json(F.unbase64(column).cast("string"), f"parameterDetails struct<bodyContent: array<{schema}>>")
    return body.select(F.explode(parsed["parameterDetails"]["bodyContent"]).alias("row")).select("row.*")
