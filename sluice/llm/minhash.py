"""MinHash near-duplicates by an LSH forest.

Every text becomes the set of its five-word shingles (64-bit hashes) and a signature of minima.  Texts with the
same set form one class, which is a single node from here on.  A tree of the forest sorts all signatures by its
own order of components; texts that agree on the first ``least_depth`` components share a region, and any two
texts that share a region of any tree are compared.  How, depends on the region:

* In a region of up to ``crowd`` nodes all pairs whose signatures agree enough are candidates.
* A larger one is cut by further components until its parts hold ``crowd`` nodes at most; pairs of a part and next
  neighbours in the order (longest common prefix) are candidates.  Most links of the region are among them.
* What then still lies in different components of the links is compared in full, by the shingle sets themselves:
  the region is cut into blocks, a task meets two blocks, and a spanning forest of the links is all that leaves it.

Candidates are verified on the full shingle sets in two rounds: first each node against its likeliest smaller
partner, then whatever candidates still lie in different components.  So a group of thousands of near copies costs
a verification per copy, not per pair, and no step makes a row per pair of a large region.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, give_back, partitions, pieces, shared_dir
from .components import below

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORDS: dict[bytes, int] = {}
_WORDS_KEPT = 500_000
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _word_hash(w: bytes) -> int:
    if len(_WORDS) > _WORDS_KEPT:
        _WORDS.clear()
    _WORDS[w] = h = xxhash.xxh3_64_intdigest(w)
    return h


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word windows; one hash of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    get = _WORDS.get
    h = np.fromiter((x if (x := get(w)) is not None else _word_hash(w) for w in words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(h))):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


class Hasher:
    """Signatures of ``n`` minima; component k is the least of all shingles under the k-th hash function."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.xor = rng.integers(0, 2**64, n, np.uint64)
        self.times = rng.integers(0, 2**64, n, np.uint64) | _U(1)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(self.xor), 2**64 - 1, np.uint64)
        with np.errstate(over="ignore"):
            for lo in range(0, len(s), 2048):
                h = (s[None, lo : lo + 2048] ^ self.xor[:, None]) * self.times[:, None]
                h ^= h >> _U(29)
                np.minimum(out, h.min(1), out=out)
        return (out >> _U(16)).astype(np.uint32)


def orders(trees: int, depth: int, n: int, seed: int = 11) -> np.ndarray:
    """For each tree the components that it sorts by: shuffled rounds through all of them."""
    rng = np.random.default_rng(seed)
    need = np.concatenate([rng.permutation(n) for _ in range(-(-trees * depth // n))])
    return need[: trees * depth].reshape(trees, depth)


def _region_pairs(sig: np.ndarray, least: int, crowd: int, neighbours: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of candidates among the sorted rows of ``sig``, a few arrays at a time.

    Rows that agree on ``least`` columns share a region.  Each is cut at the least depth at which it holds ``crowd`` rows at most.
    """
    n, depth = sig.shape
    if n < 2:
        return
    same = sig[1:] == sig[:-1]
    lcp = np.where(same.all(1), depth, same.argmin(1))
    need, crowded = np.full(n, depth), np.ones(n, bool)
    for d in range(depth, least - 1, -1):
        region = np.cumsum(np.concatenate([[0], lcp < d]))
        small = np.bincount(region)[region] <= crowd
        need[small], crowded[small] = d, False
    reach = lcp.copy()
    for step in range(1, max(crowd, neighbours + 1)):
        if step > 1:
            reach = np.minimum(reach[:-1], lcp[step - 1 :])
        whole = (reach >= need[: len(reach)]) & ~crowded[: len(reach)]
        near = (reach >= least) & (step <= neighbours)
        i = np.flatnonzero(whole | near)
        if not len(i) and step > neighbours:
            break
        yield i, i + step


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a two-dimensional array."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _joined(column: pa.ChunkedArray | pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def block_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different ``label``; with two sides, of those across the sides.

    Every set outside the largest label meets all others: its shingles are marked, and the marks are counted set by set.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    mark = np.zeros(int(code.max()) + 1, bool)
    label, out = label.copy(), []
    across = side.min() != side.max()
    for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        if (label == label[i]).all():
            break
        own = code[start[i] : start[i] + size[i]]
        mark[own] = True
        both = np.add.reduceat(mark[code], start, dtype=np.int64)
        mark[own] = False
        near = (100 * both >= percent * (size + size[i] - both)) & (label != label[i])
        if across:
            near &= side != side[i]
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    width: int = 5,
    components_: int = 64,
    trees: int = 24,
    depth: int = 8,
    least_depth: int = 3,
    crowd: int = 24,
    neighbours: int = 3,
    block: int = 1024,
    block_shingles: int = 1 << 21,
) -> DataFrame:
    """For each row: id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their shingle sets; every link is
    confirmed on the full sets.  ``component_id`` is the smallest id reachable by links, ``kept`` says that it
    is the row's own.  Texts without words (or null) have no shingles and are linked with nothing.  Rows that
    repeat an id are one document, linked if any of its rows is.  A null id links with nothing: its
    component_id is null and the row is kept.  An empty table gives an empty result.

    Any two documents that share a region of any tree are compared, however large it is.  Of pairs at the limit of
    0.75 a tree has 0.42 in one region, so 24 trees miss about one in 500,000, and closer pairs still more rarely.

    Regions of more than ``crowd`` nodes are compared in blocks of about ``block`` nodes and ``block_shingles``
    shingles at most (a single text may be larger); that work grows with the square of a region's nodes outside its
    largest component, and is split over as many tasks as there are pairs of blocks.
    """
    spark = docs.sparkSession
    parts = max(partitions(spark), 8)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Hasher(components_)
        for b in pieces(batches, size=8 << 20):
            n, digests, signatures = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, width)
                n.append(len(s))
                digests.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(of(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["id", "n", "digest", "signature"])
        _WORDS.clear()
        give_back()

    signed = checkpoint(rows.mapInArrow(sign, f"id {id_type}, n long, digest binary, signature binary"))
    linked = signed.filter("id is not null and n > 0")
    classes = checkpoint(linked.groupBy("digest").agg(F.min("id").alias("node"), F.first("signature").alias("signature")))
    # ids whose rows fall into several classes tie these together
    several = linked.groupBy("id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).filter("one <> other").select("id")
    ties = linked.select("id", "digest").join(several, "id").distinct().join(classes.select("digest", "node"), "digest").select(F.col("id").alias("a"), F.col("node").alias("b")).filter("a <> b")

    order = orders(trees, depth, components_)

    def regions(sig: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        salt = _mix(np.arange(1, trees + 1, dtype=np.uint64))
        for t in range(trees):
            key = np.full(len(sig), salt[t])
            with np.errstate(over="ignore"):
                for k in order[t][:least_depth]:
                    key = _mix(key * _U(0x9E3779B97F4A7C15) + sig[:, k].astype(np.uint64))
            yield t, key.view(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 10_000):
            for _, key in regions(_joined(b.column(0), np.uint32, components_)):
                yield pa.RecordBatch.from_arrays([pa.array(key)], ["region"])

    def grow(deep: bool):
        """(region, path, node, bits) of each node in each tree; the path is the components behind the region's, as bytes in sorting order, if ``deep``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 10_000):
                sig = _joined(b.column(1), np.uint32, components_)
                bits, none = _binary(sig.astype(np.uint8)), pa.nulls(len(sig), pa.binary())
                for t, key in regions(sig):
                    path = _binary(sig[:, order[t][least_depth:]].astype(">u4")) if deep else none
                    yield pa.RecordBatch.from_arrays([pa.array(key), path, b.column(0), bits], ["region", "path", "node", "bits"])
            give_back()

        return classes.select("node", "signature").mapInArrow(run, f"region long, path binary, node {id_type}, bits binary")

    path = shared_dir(spark)
    large = classes.select("signature").mapInArrow(count, "region long").groupBy("region").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > crowd)
    large.select("region").write.parquet(f"{path}/large")
    large = spark.read.parquet(f"{path}/large")
    floor = _least_agreement(components_, percent)

    def pairs_of(t: pa.Table, keys: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
        node, bits = t["node"], _joined(t["bits"], np.uint8, components_)
        for i, j in _region_pairs(keys, least, crowd, neighbours):
            for lo in range(0, len(i), 100_000):
                x, y = i[lo : lo + 100_000], j[lo : lo + 100_000]
                agree = (bits[x] == bits[y]).sum(1)
                good = agree >= floor
                if good.any():
                    a, b = node.take(pa.array(x[good])).combine_chunks(), node.take(pa.array(y[good])).combine_chunks()
                    yield pa.RecordBatch.from_arrays([a, b, pa.array(agree[good].astype(np.int32))], ["a", "b", "agree"])

    def pair_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Regions of up to ``crowd`` rows, sorted by region: all pairs."""

        def close(t: pa.Table) -> Iterator[pa.RecordBatch]:
            region = t["region"].to_numpy()
            alone = np.ones(len(region), bool)
            alone[1:] &= region[1:] != region[:-1]
            alone[:-1] &= region[1:] != region[:-1]
            t, region = t.filter(pa.array(~alone)), region[~alone]
            if len(region):
                yield from pairs_of(t, np.cumsum(np.concatenate([[0], region[1:] != region[:-1]]))[:, None], 1)

        held: list[pa.RecordBatch] = []
        for b in pieces(batches, 10_000):
            held.append(b)
            if sum(x.num_rows for x in held) > 20_000:
                t = pa.Table.from_batches(held)
                whole = int(np.flatnonzero(np.diff(t["region"].to_numpy())).max(initial=-1)) + 1
                yield from close(t.slice(0, whole))
                held = t.slice(whole).to_batches()
        if held:
            yield from close(pa.Table.from_batches(held))
        give_back()

    def pair_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Larger regions in sorted order, some thousand rows at a time: parts and next neighbours."""
        for b in pieces(batches, 20_000):
            t = pa.Table.from_batches([b])
            keys = np.column_stack([np.unique(t["region"].to_numpy(), return_inverse=True)[1], _joined(t["path"], ">u4", depth - least_depth)]).astype(np.int64)
            yield from pairs_of(t, keys, 1)
        give_back()

    kinds = f"a {id_type}, b {id_type}, agree int"
    small = grow(False).join(large, "region", "left_anti").select("region", "node", "bits")
    small = small.repartition(parts, "region").sortWithinPartitions("region", "node").mapInArrow(pair_small, kinds)

    # one Python step a task: workers outlive their stage, and a second one for each core would keep its memory from then on
    crowds = checkpoint(grow(True).join(large, "region", "left_semi"))
    ranged = crowds.repartitionByRange(parts, "region", "path", "node").sortWithinPartitions("region", "path", "node")
    found = small.union(ranged.mapInArrow(pair_large, kinds)).filter("a <> b")
    candidates = checkpoint(found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("agree").alias("agree")))

    # the texts that any round needs, fetched once
    needed = candidates.select(F.col("a").alias("id")).union(candidates.select("b")).union(crowds.select("node"))
    texts = checkpoint(_texts(rows, needed))
    # round 1: each node and its likeliest smaller partner
    first = candidates.groupBy("b").agg(F.max_by("a", F.struct("agree", F.hash("a", "b"))).alias("a")).select("a", "b")
    links = checkpoint(verify(texts, first, percent, width).union(ties))
    labels = below(links)
    # round 2: candidates that round 1 has not brought together
    side = lambda c: labels.select(F.col("node").alias(f"n{c}"), F.col("component").alias(f"c{c}"))
    apart = candidates.join(side("a"), F.col("a") == F.col("na"), "left").join(side("b"), F.col("b") == F.col("nb"), "left")
    apart = apart.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).filter("ca <> cb").join(first.select(F.col("a").alias("fa"), F.col("b").alias("fb")), (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left_anti")
    more = checkpoint(verify(texts, apart.select("a", "b"), percent, width))
    labels = below(more, labels)
    # round 3: what large regions hold besides
    more = checkpoint(_crowd_links(texts, crowds.select("region", "node"), labels, signed, percent, width, block, block_shingles, parts))
    labels = below(more, labels)

    # every member of a class is in the component of its node
    node = classes.select("digest", F.col("node").alias("own"))
    labels = labels.select(F.col("node").alias("key"), "component")
    of_class = checkpoint(node.join(labels, F.col("own") == F.col("key"), "left").select(F.col("digest").alias("of"), F.coalesce("component", "own").alias("component")))
    out = signed.join(of_class, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _crowd_links(texts: DataFrame, crowds: DataFrame, labels: DataFrame, signed: DataFrame, percent: int, width: int, block: int, block_shingles: int, parts: int) -> DataFrame:
    """(a, b): links between nodes of one region in ``crowds`` (region, node) that lie in different components, enough to join these.

    Regions in blocks, by the number of their nodes and shingles; a pair of blocks is one unit of work.
    """
    kind = crowds.schema["node"].dataType
    known = labels.select(F.col("node").alias("key"), "component")
    members = crowds.distinct().join(known, F.col("node") == F.col("key"), "left").select("region", "node", F.coalesce("component", "node").alias("component"))
    weights = signed.join(crowds.select(F.col("node").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.max("n").alias("n")).select(F.col("id").alias("weighed"), "n")
    members = checkpoint(members.join(weights, F.col("node") == F.col("weighed")).select("region", "node", "component", "n"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("int")
    open_ = members.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most"), blocks.alias("blocks")).filter("least <> most").select(F.col("region").alias("open"), "blocks")
    placed = checkpoint(members.join(open_, F.col("region") == F.col("open")).select("region", "node", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["of", "set"])

    wanted = texts.join(placed.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    sets = wanted.mapInArrow(cut, f"of {kind.simpleString()}, set binary").filter("length(set) > 0")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    work = placed.select("region", "block", "node", "component", F.explode(meets).alias("m")).select("region", F.col("m.x").alias("x"), F.col("m.y").alias("y"), "block", "node", "component")
    units = work.join(sets, F.col("node") == F.col("of")).select("region", "x", "y", "block", "node", "component", "set")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            node = t["node"].combine_chunks()
            label = t["component"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            found = block_links([np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()], label, t["block"].to_numpy(), percent)
            if found:
                i, j = (pa.array(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([node.take(i), node.take(j)], ["a", "b"])

        last, held = None, []
        for b in pieces(batches, 10_000):
            keys = np.column_stack([b.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if (key := tuple(keys[lo])) != last:
                    if held:
                        yield from close(held)
                    last, held = key, []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from close(held)

    return units.repartition(parts, "region", "x", "y").sortWithinPartitions("region", "x", "y").mapInArrow(compare, f"a {kind.simpleString()}, b {kind.simpleString()}")


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the given ids, rows that repeat both once.  Both sides are dealt by id, whatever their size."""
    wanted = ids.distinct().hint("merge")
    return rows.filter("id is not null").join(wanted, "id", "left_semi").groupBy("id", F.md5("text").alias("digest")).agg(F.first("text").alias("text")).select("id", "text")


def _least_agreement(n: int, percent: int) -> int:
    """Signature components that must agree: five standard deviations below what a pair at the limit shows."""
    p = percent / 100
    return int(n * p - 5 * (n * p * (1 - p)) ** 0.5)


def verify(texts: DataFrame, pairs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the limit; ``texts`` holds (id, text).

    A text is copied once for each of its pairs; the two texts of a pair meet in a task, spread by pair.  Both joins
    are dealt by key at every size: a node has no more partners than the parts of its trees hold, so no key is hot.
    """
    spark = texts.sparkSession
    kind = pairs.schema["a"].dataType.simpleString()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key"), "a", "b").hint("merge")
    met = ends.join(texts, F.col("key") == F.col("id")).select("a", "b", (F.col("key") == F.col("b")).alias("right"), "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sets, out = None, {False: [], True: []}, []

        def close() -> None:
            if last is not None and any(_similar(x, y, percent) for x in sets[False] for y in sets[True]):
                out.append(last)

        for batch in pieces(batches):
            for a, b, right, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != last:
                    close()
                    last, sets = (a, b), {False: [], True: []}
                sets[right].append(shingles(text, width))
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], schema)
                out.clear()
        close()
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], schema)
        _WORDS.clear()
        give_back()

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(pairs.select("a", "b").schema)
    return met.repartition(max(partitions(spark), 8), "a", "b").sortWithinPartitions("a", "b", "right").mapInArrow(confirm, f"a {kind}, b {kind}")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
