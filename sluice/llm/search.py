"""Ranked lexical search of whole texts for a table of items (hybrid term-at-a-time and document-at-a-time).

Pass 1 writes each document as (length, ids and counts of the items' terms); frequencies are sums over that table.  Pass 2 cuts
it into shards, inverts each shard and takes every item's best documents from it; Spark merges the shards' lists.

Inside a shard the short lists of an item are added up term at a time.  Their sums are one sorted iterator with a known largest
value, and take part beside the long lists in a walk over windows of documents in order: a window whose largest possible score
stays below the worst kept one is skipped, and in the others only documents of lists that can still decide are scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import checkpoint, pieces, two_columns

#: A term is a run of ASCII letters, digits and anything beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on bytes of UTF-8, where all else becomes a space.
_BYTES = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))

WINDOW = 2048  # documents of a window
POSTINGS = 2_000_000  # of a shard, about
BLOCK_BYTES = 16 << 20  # of the items' terms that one broadcast holds, about


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term), distinct."""
    text = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    return items.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1))).alias("term")).distinct()


def forward(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms array<int>, counts array<int>) of each row with a term; ``vocabulary``: a broadcast dict from bytes to ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in pieces(batches):
            n, sizes, terms, counts = [], [0], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = text.translate(_BYTES).split(b" ") if text else []
                found = Counter(words)
                n.append(len(words) - found.pop(b"", 0))
                own = sorted((known[w], c) for w, c in found.items() if w in known)
                terms += [x for x, _ in own]
                counts += [x for _, x in own]
                sizes.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "counts"])
            yield out.filter(pc.greater(out.column(1), 0))

    return two_columns(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n long, terms array<int>, counts array<int>")


class Shard:
    """Documents in order of their ids with posting lists of what each term adds to a score."""

    def __init__(self, n, sizes, terms, counts, weights, total: int, length: int, window: int = WINDOW):
        self.size, self.window, self.scored = len(n), window, 0
        m = 50 + (50 * n * total) // length
        docs = np.repeat(np.arange(self.size, dtype=np.int64), sizes)
        order = np.argsort(terms, kind="stable")
        terms, counts, self.docs = terms[order], counts[order].astype(np.int64), docs[order]
        self.adds = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[self.docs]))
        self.ends = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.edges = np.arange(0, self.size + window, window)
        self._long: dict[int, tuple] = {}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        cut = slice(self.ends[term], self.ends[term + 1])
        return self.docs[cut], self.adds[cut]

    def cuts(self, docs: np.ndarray, adds: np.ndarray) -> tuple:
        """(docs, adds, places where windows begin, largest value in each window)."""
        at = np.searchsorted(docs, self.edges)
        largest = np.zeros(len(at) - 1, np.int64)
        full = at[1:] > at[:-1]
        if len(adds):
            largest[full] = np.maximum.reduceat(adds, at[:-1][full])
        return docs, adds, at, largest

    def long(self, term: int) -> tuple:
        if term not in self._long:
            self._long[term] = self.cuts(*self.list_of(term))
        return self._long[term]

    def accumulate(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: the sums of short lists as one list."""
        lists = [self.list_of(t) for t in terms]
        docs, adds = (np.concatenate([x[k] for x in lists] or [np.empty(0, np.int64)]) for k in (0, 1))
        order = np.argsort(docs, kind="stable")
        docs, adds = docs[order], adds[order]
        first = np.flatnonzero(np.diff(docs, prepend=-1))
        return docs[first], np.add.reduceat(adds, first) if len(first) else adds

    def best(self, terms: list[int], k: int, floor: int, short: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the ``k`` best above 0 and not below ``floor``, highest first, equal ones in order."""
        sizes = {t: int(self.ends[t + 1] - self.ends[t]) for t in terms}
        docs, sums = self.accumulate([t for t in terms if 0 < sizes[t] <= short])
        if len(sums) >= k:  # what the sums alone reach is a bound for the whole
            floor = max(floor, int(np.partition(sums, -k)[-k]))
        lists = [self.cuts(docs, sums), *(self.long(t) for t in terms if sizes[t] > short)]
        bounds = np.array([x[3] for x in lists])
        top_docs, top_scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for w in range(len(self.edges) - 1):
            most = bounds[:, w]
            if most.sum() < max(floor, 1):
                continue
            by = np.argsort(most, kind="stable")
            deciding = np.cumsum(most[by]) >= max(floor, 1)  # documents of the others alone stay below
            low = self.edges[w]
            self.scored += 1
            dense = np.zeros(self.window, np.int64)
            for i in by[deciding]:
                d, a, at, _ = lists[i]
                dense[d[at[w] : at[w + 1]] - low] += a[at[w] : at[w + 1]]
            left, rest = np.flatnonzero(dense), int(most[by[~deciding]].sum())
            scores = dense[left]
            for i in by[~deciding][::-1]:
                alive = scores + rest >= floor
                left, scores = left[alive], scores[alive]
                if not len(left):
                    break
                d, a, at, _ = lists[i]
                d, a = d[at[w] : at[w + 1]], a[at[w] : at[w + 1]]
                if len(d):
                    place = np.minimum(np.searchsorted(d, left + low), len(d) - 1)
                    scores = scores + np.where(d[place] == left + low, a[place], 0)
                rest -= int(most[i])
            good = scores >= max(floor, 1)
            if good.any():
                top_docs, top_scores = np.concatenate([top_docs, left[good] + low]), np.concatenate([top_scores, scores[good]])
                keep = np.argsort(-top_scores, kind="stable")[:k]  # stable: of equal scores the smaller document first
                top_docs, top_scores = top_docs[keep], top_scores[keep]
                if len(keep) == k:
                    floor = max(floor, int(top_scores[-1]))
        return top_docs, top_scores


def _candidates(table: DataFrame, asked, k: int, kind: DataType, window: int, postings: int) -> DataFrame:
    """(item_id, doc_id, score): each shard's best documents of each item of ``asked`` (broadcast: ids, their terms, weights, N, L)."""
    id_kind, item_type = table.schema["id"].dataType.simpleString(), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, queries, weights, total, length = asked.value
        floors = [np.empty(0, np.int64)] * len(queries)  # the best scores of this task so far
        held: list[pa.RecordBatch] = []

        def shard() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            t = t.take(pc.sort_indices(t, [("id", "ascending")], null_placement="at_end")).combine_chunks()
            column = lambda c: pa.concat_arrays(t.column(c).chunks)
            flat = lambda c: pc.list_flatten(column(c)).to_numpy(zero_copy_only=False)
            s = Shard(column("n").to_numpy(zero_copy_only=False), pc.list_value_length(column("terms")).to_numpy(zero_copy_only=False), flat("terms"), flat("counts"), weights, total, length, window)
            ids = column("id")
            for i, terms in enumerate(queries):
                floor = int(floors[i][-1]) if len(floors[i]) == k else 0
                docs, scores = s.best(terms, k, floor, max(64, s.size // 16))
                if len(docs):
                    floors[i] = -np.sort(-np.concatenate([floors[i], scores]))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array([item_ids[i]] * len(docs), item_type), ids.take(pa.array(docs)), pa.array(scores)], ["item_id", "doc_id", "score"])

        size = 0
        for b in pieces(batches):
            held.append(b)
            size += len(pc.list_flatten(b.column(b.schema.get_field_index("terms"))))
            if size >= postings:
                yield from shard()
                held, size = [], 0
        if held:
            yield from shard()

    return table.mapInArrow(run, f"item_id {kind.simpleString()}, doc_id {id_kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank int, doc_id, score long): the ``k`` documents of highest score above 0 of each item.

    With N documents that hold a term, L terms in all, n in the document, df documents with the term and tf occurrences: w =
    floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + 50 n N div L, and a document's score sums w (10^9 tf div (1000 tf + 20 m))
    over the item's distinct terms.  Results are exact: a window is skipped only if no document in it can reach the list.

    Cases: null and empty texts, and such without a term, are in no result and not in N.  Equal scores go by document id, null ids
    last.  Repeated rows are documents each.  Items that share an id are one item with the terms of all; items without a term, or
    whose terms no document holds, have no rows.  Empty tables give no rows.  Other columns play no part.

    The items are cut into blocks by a hash of their ids so that a block's terms are about 16 MB (an item alone is never cut);
    blocks go to all tasks one after another, and each is another pass over the texts.  A task holds about ``postings`` of a shard's
    (document, term) pairs; ``window`` is the number of documents that are skipped or scored together.
    """
    spark = docs.sparkSession
    asked = checkpoint(item_terms(items, item_col, item_text_col))
    weight = asked.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = -(-weight // BLOCK_BYTES)
    kind = items.schema[item_col].dataType
    found = spark.createDataFrame([], f"item_id {kind.simpleString()}, doc_id {docs.schema[id_col].dataType.simpleString()}, score long")
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).groupBy("id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
        rows = own.collect()  # bounded by BLOCK_BYTES
        ids: dict[bytes, int] = {}
        queries = [[ids.setdefault(t.encode(), len(ids)) for t in r["terms"]] for r in rows]
        table = checkpoint(forward(docs, spark.sparkContext.broadcast(ids), id_col, text_col))
        total, length = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(ids), np.int64)
        for term, df in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block at most
            weights[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
        found = found.union(_candidates(table, spark.sparkContext.broadcast(([r["id"] for r in rows], queries, weights, total, length)), k, kind, window, postings))
    # in two levels: the shards' lists of one item are many
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("part", F.spark_partition_id() % 32)
    first = W.partitionBy("item_id", "part").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
