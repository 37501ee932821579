"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most ``rows`` rows and about ``size`` bytes, whatever the session's settings; nothing is copied."""
    for b in batches:
        step = max(1, rows if b.nbytes <= size else min(rows, b.num_rows * size // b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def give_back() -> None:
    """Hand freed memory back to the system: workers live on after a task, and what they keep is missing in the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): whatever else the table holds, and however it is called, stays out of the way."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def map_texts(docs: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[pa.Array], dict[str, list]]]) -> DataFrame:
    """One output row for each input row: `id_col` plus the columns that ``make()(texts)`` returns.

    ``make`` runs once in each task; ``schema`` types its columns.  Texts arrive as an Arrow array that may hold nulls.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in pieces(batches):
            out = of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(c if isinstance(c, pa.Array) else pa.array(c) for c in out.values())], [id_col, *out])

    return two_columns(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {schema}")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir`` (or has set it on the context).  Only a session on one machine may
    do without; there a temporary folder is made.  A cluster without one is refused: its nodes would write to their own disks.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder.

    Unlike ``DataFrame.checkpoint``, whose size estimate is that of the plan it cuts (and grows beyond all bounds in
    loops of joins), a written table has its true size, by which Spark chooses joins, and its columns are read as needed.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder, by URI.

    A query's result is read from it after the query has returned, so nothing here deletes it; whoever owns the shared folder clears it.
    """
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
