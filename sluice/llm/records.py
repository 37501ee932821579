"""Token sequences in files of length-delimited binary records, with a separate offset index.

A record frames one document: an 8-byte length, the masked crc32 of those bytes, the payload, the masked crc32
of the payload, and one end byte (the writer's line end).  The payload holds the document's id, the width of a
token and the tokens.  Records lie in ascending id order, file after file.

Files are written and read by Spark's own writers and readers: any store that the cluster knows will do, and a
lost task's half-written file is never committed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, pieces, shared_dir
from .token_counts import encoder, vocabulary

_HEAD = struct.Struct("<QI")
_PAYLOAD = struct.Struct("<qB")
_NULL_ID = -(2**63)
END = b"\n"


def masked(data: bytes) -> int:
    """The crc32 rotated and offset, so that checksums of data that itself holds checksums stay useful."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, tokens: bytes, width: int) -> bytes:
    payload = _PAYLOAD.pack(_NULL_ID if doc_id is None else doc_id, width) + tokens
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def parse(data: bytes, at: int = 0) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length with frame, id, tokens) of each record; raises ValueError where a checksum fails."""
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise ValueError(f"truncated record at {at}")
        n, check = _HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != check or at + 16 + n + len(END) > len(data):
            raise ValueError(f"damaged length at {at}")
        payload = data[at + 12 : at + 12 + n]
        if masked(payload) != struct.unpack_from("<I", data, at + 12 + n)[0]:
            raise ValueError(f"damaged record at {at}")
        doc_id, width = _PAYLOAD.unpack_from(payload)
        yield at, 16 + n + len(END), None if doc_id == _NULL_ID else doc_id, np.frombuffer(payload, f"<u{width}", offset=_PAYLOAD.size)
        at += 16 + n + len(END)


def write(docs: DataFrame, path: str, vocab_path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Encode each text, append ``end_id`` and write the records in ascending id order below ``path``.

    Null and empty texts hold ``end_id`` alone; null ids come first; repeated rows are written one by one.  Rows of
    one id lie in the order of their texts' first characters (within a file, of their whole texts); rows that agree in
    both are spread over files as need be, so an id that fills a third of the table is no single task.  An empty
    table gives files without records.  ``files`` bounds how many files there are (by default as many as shuffle
    partitions, and so many that no file should exceed what a reader holds in memory).  Only (id, text) is shuffled, once.
    """
    spark = docs.sparkSession
    shared = vocabulary(docs, vocab_path)
    width = 2 if shared.value.size <= 1 << 16 else 4
    end = np.array([] if end_id is None else [end_id], f"<u{width}").tobytes()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    files = files or max(partitions(spark), 2 * rows.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared).encode
        for b in pieces(batches):
            ids, sizes = encode(b.column(1))
            raw, ends = ids.astype(f"<u{width}").tobytes(), np.concatenate([[0], np.cumsum(sizes) * width]).tolist()
            framed = [frame(i, raw[x:y] + end, width) for i, x, y in zip(b.column(0).to_pylist(), ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], ["value"])

    by_id, by_text = F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()
    keyed = rows.withColumns({"head": F.substring("text", 1, 32), "nth": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(files, by_id, F.col("head").asc_nulls_first(), "nth").sortWithinPartitions(by_id, by_text).select("id", "text")
    # the writer takes text; as a string's bytes are kept as they are, records stay binary
    ordered.mapInArrow(run, "value binary").selectExpr("cast(value as string) as value").write.option("lineSep", END.decode()).option("compression", "none").mode("overwrite").text(path)


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """(file_no, file, offset, length, doc_id, before, n_tokens, ids_crc32) of every committed record, as Parquet.

    ``before`` counts the tokens before the record in its own file.  Files without records add nothing.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "length", "doc_id", "before", "n_tokens", "ids_crc32"]
        for b in batches:
            for file, data in zip(b.column(0), b.column(1)):
                rows = [(o, n, i, len(t), zlib.crc32(t.astype("<u4"))) for o, n, i, t in parse(data.as_py())]
                offset, length, ids, n_tokens, crc = list(zip(*rows)) or [()] * 5
                before = np.cumsum((0, *n_tokens))[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in (offset, length, ids, before, n_tokens, crc))], names)

    found = files_of(spark, path).mapInArrow(scan, "file string, offset long, length long, doc_id long, before long, n_tokens long, ids_crc32 long")
    number = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int").alias("file_no")
    found.select(number, "*").write.mode("overwrite").parquet(index_path)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the record files; Spark's Arrow batches are bounded in bytes, so few files are in memory at a time."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def starts(spark: SparkSession, index_path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the tokens before each document.

    The index has the tokens before it in its file; sums per file run over as many rows as there are files.
    """
    index = spark.read.parquet(index_path)
    per_file = index.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    base = per_file.select(F.col("file_no").alias("no"), (F.sum("n").over(W.orderBy("file_no")) - F.col("n")).alias("base"))
    return index.join(base, F.col("file_no") == F.col("no")).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every record, checksums verified; damaged files raise, files without records add nothing."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(1):
                rows = [(i, t.astype(np.int64)) for _, _, i, t in parse(data.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return files_of(spark, path).mapInArrow(scan, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Write the records and their index to the shared folder, then read them: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are records of the end id alone; an empty table gives no rows.  Rows that repeat an id
    are a record each, one after another; rows without an id come first.  Other columns play no part.  The files stay in the shared folder, whose owner clears it.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    write(docs, f"{path}/records", vocab_path)
    write_index(spark, f"{path}/records", f"{path}/index")
    return starts(spark, f"{path}/index")
