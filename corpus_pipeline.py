"""The corpus pipeline: raw documents to encoded, mixed training text.

Each stage gets what its predecessor kept, written as Parquet and read again; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe_codec, minhash, mixing, quality, secrets
from sluice.llm.common import shared_dir
from sluice.llm.queries import vocab_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from every language go.

    Null and empty texts fail the base rules; repeated rows are judged one by one; an empty table stays empty.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, and of rows that repeat an id and text one.

    Rows without an id are one document for each text; null texts count as equal.
    """
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
    # a digest instead of the text as the key; the row with the least other columns stays, so reruns agree
    rest = [c for c in docs.columns if c != "doc_id"]
    least = F.min(F.struct(*sorted(rest, key=lambda c: c == "text"))).alias("_row")
    one = rows.groupBy("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("_text")).agg(least)
    return one.select(*("doc_id" if c == "doc_id" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows.

    Null texts stay null and keep their n_chars; texts without a secret, empty ones too, stay as they are; no row goes or comes.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(clean.schema["n_chars"].dataType)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    Documents without words are not taken; rows without a source are one source, the last; repeated rows are documents each.
    """
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text encoded, decoded again, and both digested; null texts are empty, one row for each that the mixture took."""
    return bpe_codec.round_trip(docs, vocab_path())


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The stages' hashing, Newton steps and merges have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
