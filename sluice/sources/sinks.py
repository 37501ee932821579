"""Writing: overwrite, slices, upserts and insert-ignore on plain Parquet tables, CSV exports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, by: str = "factory_id") -> None:
    df.sortWithinPartitions(by, "parameter_id", "timestamp").write.mode("overwrite").partitionBy(by).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a new folder of the session's checkpoint folder (local sessions without one: a temporary folder): computed once, however often it is read.

    Results are read from it later, so nothing here deletes it; whoever owns the checkpoint folder clears it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def replace_slice(df: DataFrame, path: str, by: str) -> None:
    """Only the partitions that ``df`` holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces rows of ``old`` with its keys; columns that one side lacks are null there."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def first_of(df: DataFrame, keys: list[str], order: list[str | Column] | None = None) -> DataFrame:
    """One row of each key: the first in ``order``, or else in the order of all other columns, so that reruns agree."""
    rest = order or [F.col(f"`{c}`").asc_nulls_last() for c in df.columns if c not in keys]
    return latest(df, keys, rest or [F.lit(0)])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str | Column] | None = None) -> DataFrame:
    """The rows that insert-ignore would add: the first by ``order`` of each key that ``old`` does not have."""
    return first_of(new.join(old.select(*keys).distinct(), keys, "left_anti").select(*new.columns), keys, order)


def insert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(received, inserted, skipped): one row.  Rows that repeat a key of ``old``, or an earlier one of ``new``, are skipped; a key with a null meets no other."""
    k = [F.col(f"`{c}`") for c in keys]
    whole = F.lit(True)
    for c in k:
        whole = whole & c.isNotNull()
    per = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = old.select(*keys).distinct().withColumn("_known", F.lit(1))
    met = per.join(known, keys, "left").withColumn("_in", F.when(~whole, F.col("n")).when(F.col("_known").isNull(), 1).otherwise(0))
    total = met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("received"), F.coalesce(F.sum("_in"), F.lit(0)).cast("long").alias("inserted"))
    return total.select("received", "inserted", (F.col("received") - F.col("inserted")).alias("skipped"))


def numbered(df: DataFrame, keys: list[str], id_col: str, start: Column, buckets: int = 256, bucket: Column | None = None) -> DataFrame:
    """``df`` with ``id_col``: start + 1, start + 2, ... without gaps, by bucket and then by ``keys``, which must be unique.

    Rows are numbered inside buckets of their keys' hash (or ``bucket``) and moved by the sums of the buckets before, which is a table of
    ``buckets`` rows: no window over the whole table, and the same numbers on every run.
    """
    b = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if bucket is None else bucket
    placed = df.withColumn("_bucket", b).withColumn("_n", F.row_number().over(W.partitionBy("_bucket").orderBy(*keys)))
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(F.col("_bucket").alias("_of"), (F.sum("_size").over(W.orderBy("_bucket")) - F.col("_size")).alias("_before"))
    out = placed.join(F.broadcast(before), F.col("_bucket").eqNullSafe(F.col("_of")))
    return out.withColumn(id_col, (start + F.col("_before") + F.col("_n")).cast("long")).drop("_bucket", "_of", "_n", "_before")


def upsert_returning(old: DataFrame, new: DataFrame, keys: list[str], id_col: str = "id", order: list[str | Column] | None = None, buckets: int = 256, bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, returned): ``new`` into ``old`` by ``keys``, and what a store would return: keys, ``id_col``, inserted.

    Rows of known keys keep their id and take the new columns; new keys get ids after the highest one (after 0 in an empty table), as
    `numbered` deals them.  Of several new rows of a key the last by ``order`` counts (by all other columns without it).  Keys must
    not be null.  Columns that one side lacks are null there.
    """
    rest = [F.desc(o) if isinstance(o, str) else o for o in order] if order else [F.col(f"`{c}`").desc_nulls_last() for c in new.columns if c not in keys] or [F.lit(0)]
    fresh = latest(new, keys, rest)
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long").alias("_top"))
    known = fresh.join(old.select(*keys, id_col), keys)
    missing = fresh.join(old.select(*keys), keys, "left_anti").crossJoin(F.broadcast(top))  # one row
    added = numbered(missing, keys, id_col, F.col("_top"), buckets, bucket).drop("_top")
    changed = known.withColumn("inserted", F.lit(False)).unionByName(added.withColumn("inserted", F.lit(True)))
    table = old.join(fresh.select(*keys), keys, "left_anti").unionByName(changed.drop("inserted"), allowMissingColumns=True)
    return table, changed.select(*keys, id_col, "inserted")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``new`` are replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def pivot_export(readings: DataFrame, parameters: list[str]) -> DataFrame:
    """(factory_id, time, a column per parameter): minutes as text, empty for missing.

    A second reading of the same factory, time and parameter is an error, as it is in a pivot.
    """
    value = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate reading")).cast("double")).otherwise(F.first("value"))
    wide = readings.groupBy("factory_id", "timestamp").pivot("parameter_id", parameters).agg(value)
    return wide.select("factory_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("time"), *(F.col(f"`{p}`") for p in parameters))


def export_by_factory(readings: DataFrame, parameters: list[str], folder: str) -> None:
    """`pivot_export` as CSV, a folder for each factory, rows by time inside it, blank for missing values."""
    wide = pivot_export(readings, parameters).repartition("factory_id").sortWithinPartitions("factory_id", "time")
    wide.write.mode("overwrite").partitionBy("factory_id").option("nullValue", "").csv(folder, header=True)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What `write_json` has written, with the types of ``schema``; a line that is no JSON fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
