"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

A hash function turns a vector by three rounds of (random signs, Hadamard transform) and names the signed axis that
lies nearest.  A table joins ``width`` such functions; a vector enters its own bucket and, by multiprobe, the
buckets of its next-nearest axes.  Vectors of one bucket are candidates, and every link is confirmed with their
cosine in double precision.

Equal vectors are one class with a weight, so a vector that fills a third of the table is a single row.  Buckets are
cut into blocks of at most ``block`` rows, and pairs of blocks are the unit of work: no task ever holds a whole
large bucket.  A pair of blocks yields a row per linked vector (and a spanning forest), not a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpoint, partitions, pieces
from .components import components

#: Axes of the smallest vectors for which buckets are planned; more axes only make buckets smaller.
_FEW_AXES = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    h, n = 1, x.shape[1]
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """``tables`` x ``width`` hash functions for vectors of ``dim`` components, the same on every executor."""

    def __init__(self, dim: int, tables: int, width: int, seed: int = 5):
        self.padded = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, width, 3, self.padded))

    def axes(self, x: np.ndarray, table: int, k: int, probes: int) -> np.ndarray:
        """The ``probes`` nearest signed axes of each row: the axis' number, plus the width where it points down."""
        y = np.zeros((len(x), self.padded))
        y[:, : x.shape[1]] = x
        for signs in self.signs[table, k]:
            y = hadamard(y * signs)
        best = np.argsort(-np.abs(y), 1, kind="stable")[:, :probes]
        return best + self.padded * (np.take_along_axis(y, best, 1) < 0)

    def names(self, x: np.ndarray, dim: int, probes: int) -> np.ndarray:
        """The buckets of each row in all tables, as 64-bit names that differ between tables and dimensions."""
        out = []
        for t in range(len(self.signs)):
            b = self.buckets(x, t, probes).astype(np.uint64)
            with np.errstate(over="ignore"):
                h = (b + np.uint64(dim << 40 | t << 56)) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((h ^ (h >> np.uint64(29))).view(np.int64))
        return np.concatenate(out, 1)

    def buckets(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """(rows, 1 + width * (probes - 1)): the own bucket, and those with one axis replaced by a farther one."""
        axes = [self.axes(x, table, k, probes) for k in range(self.signs.shape[1])]
        name = lambda cols: sum(c * (2 * self.padded) ** k for k, c in enumerate(cols))
        own = [a[:, 0] for a in axes]
        out = [name(own)]
        for k, a in enumerate(axes):
            out += [name([*own[:k], a[:, p], *own[k + 1 :]]) for p in range(1, probes)]
        return np.stack(out, 1)


def near_duplicates(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least_cosine: float = 0.95,
    tables: int = 8,
    width: int | None = None,
    probes: int = 2,
    block: int = 512,
) -> DataFrame:
    """For each row: id, n_links, component_id, kept.

    ``n_links`` counts the other vectors (rows with another id) that are linked directly, ``component_id`` is
    the smallest id reachable by links, ``kept`` says that it is the row's own.  Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing; vectors of different lengths are compared
    only with their like.  A row with a null id links with nothing, has a null component_id and is kept.
    Rows that repeat an id are one node, whose links are those of any of its rows.  An empty table gives an empty result.

    Without ``width`` (axes in a bucket's name) it follows the number of vectors: 1 to 4,096 of them, 2 to 524,288, 3 to 67 million, 4 to
    8.6 billion, so that buckets of vectors without order stay small.  Wider names lose some pairs: of simulated pairs at the limit of 0.95
    (64 components, 8 tables, 2 probes) all share a bucket at widths 1 and 2, 99.98 % at 3, 99.8 % at 4.
    """
    spark = table.sparkSession
    id_type = table.schema[id_col].dataType.simpleString()
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    usable = rows.filter("id is not null").filter(whole).select("id", F.transform("v", lambda c: c + 0.0).alias("v"))

    # classes of equal vectors, by value; their bytes and buckets are made once
    classes = usable.groupBy("v").agg(F.min("id").alias("node"), F.count_distinct("id").alias("weight"))
    n = usable.count()
    width = width or max(1, int(np.ceil(np.log(max(n, 2) / 32) / np.log(2 * _FEW_AXES))))
    exact = np.float32 if table.schema[vector_col].dataType.elementType.typeName() == "float" else np.float64

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, CrossPolytope] = {}
        for b in pieces(batches):
            if not b.num_rows:
                continue
            sizes = np.diff(b.column(0).offsets.to_numpy())
            flat, ends = b.column(0).flatten().to_numpy(), np.cumsum(sizes)
            vectors = [flat[e - k : e].astype(exact).tobytes() for e, k in zip(ends, sizes)]
            names: list = [None] * b.num_rows
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                lsh = known.setdefault(dim, CrossPolytope(dim, tables, width))
                x = np.stack([flat[ends[k] - dim : ends[k]] for k in at])
                for k, row in zip(at, lsh.names(x, dim, probes)):
                    names[k] = row
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(0), pa.array(vectors, pa.binary()), pa.array(names, pa.list_(pa.int64()))], ["node", "weight", "v", "raw", "names"])

    classes = checkpoint(classes.mapInArrow(spread, f"node {id_type}, weight long, v array<double>, raw binary, names array<long>"))
    members = classes.select("node", F.explode(F.array_distinct("names")).alias("bucket"))
    # buckets in blocks: the number of blocks follows from the bucket's exact size
    blocks = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = members.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # each block meets itself and every other block of its bucket once
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    work = placed.select("bucket", "block", "node", F.explode(meets).alias("m")).select("bucket", F.col("m.x").alias("x"), F.col("m.y").alias("y"), "block", "node")
    ready = work.join(classes.select("node", "weight", "raw", "names"), "node")
    units = ready.select("bucket", "x", "y", "block", "node", "weight", "raw", "names").repartition(max(partitions(spark), 8), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    kind = to_arrow_type(table.schema[id_col].dataType)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(t: pa.Table) -> tuple[list, list, list]:
            """Rows (a, b, n): a forest of links with n null, and for each node with b null the links first met here."""
            nodes, dims = t["node"], [len(r) for r in t["raw"].to_pylist()]
            names, side = np.stack([np.asarray(x) for x in t["names"].to_numpy(zero_copy_only=False)]), t["block"].to_numpy()
            crossing, bucket = t["x"][0] != t["y"][0], t["bucket"][0].as_py()
            left, right = [], []
            for dim in set(dims):
                at = np.flatnonzero(np.array(dims) == dim)
                x = np.frombuffer(b"".join(t["raw"].take(at).to_pylist()), exact).reshape(len(at), -1).astype(np.float64)
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                i, j = np.nonzero(np.triu(x @ x.T >= least_cosine, 1))
                left.append(at[i])
                right.append(at[j])
            i, j = np.concatenate(left), np.concatenate(right)
            if crossing:
                apart = side[i] != side[j]
                i, j = i[apart], j[apart]
            if not len(i):
                return [], [], []
            # a pair may meet in several buckets; it counts in the least of those both have
            first = np.empty(len(i), bool)
            for lo in range(0, len(i), 10_000):
                a, b = names[i[lo : lo + 10_000]], names[j[lo : lo + 10_000]]
                common = (a[:, :, None] == b[:, None, :]).any(2)
                first[lo : lo + 10_000] = np.where(common, a, np.iinfo(np.int64).max).min(1) == bucket
            weight = t["weight"].to_numpy()
            n = np.bincount(i[first], weight[j[first]], len(names)) + np.bincount(j[first], weight[i[first]], len(names))
            tree, edges = list(range(len(names))), []

            def root(k: int) -> int:
                while tree[k] != k:
                    tree[k] = tree[tree[k]]
                    k = tree[k]
                return k

            for p, q in zip(i.tolist(), j.tolist()):
                if (u := root(p)) != (w := root(q)):
                    tree[w] = u
                    edges.append((p, q))
            ids, counted = nodes.to_pylist(), np.flatnonzero(n).tolist()
            a = [ids[p] for p, _ in edges] + [ids[k] for k in counted]
            return a, [ids[q] for _, q in edges] + [None] * len(counted), [None] * len(edges) + n[counted].astype(np.int64).tolist()

        def close(parts: list[pa.Table]) -> pa.RecordBatch:
            a, b, n = unit(pa.concat_tables(parts).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(n, pa.int64())], ["a", "b", "n"])

        last, held = None, []
        for b in pieces(batches):
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            keys = np.stack([t[c].to_numpy() for c in ("bucket", "x", "y")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(keys[lo])
                if key != last:
                    if sum(map(len, held)) > 1:
                        yield close(held)
                    last, held = key, []
                held.append(t.slice(lo, hi - lo))
        if sum(map(len, held)) > 1:
            yield close(held)

    found = checkpoint(units.mapInArrow(compare, f"a {id_type}, b {id_type}, n long"))
    links = found.filter("b is not null").select("a", "b")
    labels = components(links)
    # each pair counts once for both of its classes, with the number of ids in the other one
    degree = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("far")).withColumnRenamed("a", "node")
    known = classes.join(degree, "node", "left").join(labels, "node", "left")
    known = known.select(F.col("v").alias("cv"), (F.coalesce("far", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    tagged = rows.withColumn("cv0", F.when(F.col("id").isNotNull() & whole, F.transform("v", lambda c: c + 0.0)))
    out = tagged.join(known, F.col("cv0") == F.col("cv"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
