"""Removal of repeated byte strings by a hash-compared suffix sort over anchored suffixes.

Sorting every suffix of a corpus would move many times its bytes.  It is enough to sort around *anchors*: in each
window of ``length`` bytes the ``gram``-byte string of least hash (the leftmost of equals) is the window's anchor.
Equal windows have equal anchors at equal places, so windows need comparing only where anchors are equal, and
anchors that occur once are dropped before any text moves.

For the rest, the stretch of text that holds all windows of an anchor is its context.  Equal contexts form one
class.  Within the classes of an anchor, suffixes to the right and (reversed) to the left are sorted by mergesort;
two suffixes are compared by binary search for their common extension over prefix polynomial hashes.  Neighbours
in sorted order give the longest extensions, and what they leave open is settled window by window.  Everything that
hashes call equal is compared byte by byte before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, pieces, shared_dir

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(3).integers(0, 2**64, 256, np.uint64)
_CHUNK = 1 << 21
_POS = 22  # bits of a position inside a chunk, with its overlap
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        out = np.ones(max(n + 1, 1 << 16), np.uint64)
        out[1:] = _U(base)
        with np.errstate(over="ignore"):
            _powers[base] = have = np.cumprod(out)
    return have


class Prefixes:
    """Prefix polynomial hashes of a byte array: the hash of any stretch in a few lookups."""

    def __init__(self, data: np.ndarray):
        self.data, n = data, len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTES[data] * powers(_BASE, n)[:n], out=self.sums[1:])
        self.back = powers(_INVERSE, n)

    def of(self, at: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The longest common extension of the suffixes at a and b, up to ``most``, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return h ^ (h >> _U(32))


def anchors(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor of a text; windows are given by their start."""
    found = []
    data = np.frombuffer(raw, np.uint8)
    width = length - gram + 1
    for base in range(0, len(data) - length + 1, _CHUNK):
        part = data[base : base + _CHUNK + length - 1]
        n = len(part) - gram + 1
        h = _mix(Prefixes(part).of(np.arange(n), gram))
        low = (h >> _U(_POS) << _U(_POS)) | np.arange(n, dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        at = (low & _U((1 << _POS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        found.append((h[at[first]].view(np.int64), at[first] + base, first + base, last + base))
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    return tuple(np.concatenate(c) for c in zip(*found))


def suffix_order(text: Prefixes, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order that sorts the suffixes (start ``at``, length ``size``) within runs of equal ``group``.

    Bottom-up mergesort: both halves of every merge are sorted, so an element's new place is its own place plus
    its rank in the other half, found by binary search.  All merges of a level go side by side.
    """
    n = len(at)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, np.int64)
    first = np.repeat(start, np.diff(np.append(start, n)))
    end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n))) if n else first
    order, run = np.arange(n), 1
    while n and (end - first).max() > run:
        k = np.arange(n)
        half = (k - first) // run
        left = half % 2 == 0
        lo = np.minimum(np.where(left, first + (half + 1) * run, first + (half - 1) * run), end)
        hi = np.minimum(lo + run, end)
        low, high = lo.copy(), hi.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            x, y = order[live], order[mid]
            most = np.minimum(size[x], size[y])
            c = text.common(at[x], at[y], most)
            ended = c == most
            bx = text.data[np.where(ended, 0, at[x] + c)]
            by = text.data[np.where(ended, 0, at[y] + c)]
            # is the other half's element before this one?  of equals, the left half's comes first
            sx, sy = size[x], size[y]
            before = np.where(ended, np.where(sx == sy, ~left[live], sy < sx), by < bx)
            low[live] = np.where(before, mid + 1, low[live])
            high[live] = np.where(before, high[live], mid)
            live = live[low[live] < high[live]]
        to = np.where(left, k + (low - lo), k - run + (low - lo))
        new = np.empty(n, np.int64)
        new[to] = order
        order, run = new, run * 2
    return order


def repeated_offsets(group: np.ndarray, contexts: list[bytes], near: np.ndarray, far: np.ndarray, many: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each class of contexts the least and the largest offset whose window also occurs elsewhere (-1: none).

    Rows of one ``group`` share an anchor and stand together.  A context holds the windows that start ``far``
    to ``near`` bytes before its anchor; ``many`` says that the context itself occurs more than once.
    """
    n = len(contexts)
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts), np.uint8)
    text, back = Prefixes(data), Prefixes(data[::-1])
    anchor = base + far
    right, left = base + sizes - anchor, far  # bytes from the anchor on, and before it
    mirrored = len(data) - anchor
    low, high = np.where(many, near, -1), np.where(many, far, -1)

    def neighbours(order: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = order[:-step], order[step:]
        same = group[a] == group[b]
        return a[same], b[same]

    best_right, best_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    pairs = []
    for view, at, size, best in ((text, anchor, right, best_right), (back, mirrored, left, best_left)):
        order = suffix_order(view, at, size, group)
        a, b = neighbours(order, 1)
        c = view.common(at[a], at[b], np.minimum(size[a], size[b]))
        np.maximum.at(best, a, c)
        np.maximum.at(best, b, c)
        pairs.append((a, b))
    for a, b in pairs:
        r = text.common(anchor[a], anchor[b], np.minimum(right[a], right[b]))
        l = back.common(mirrored[a], mirrored[b], np.minimum(left[a], left[b]))
        lo, hi = np.maximum(np.maximum(length - r, near[a]), near[b]), np.minimum(np.minimum(l, far[a]), far[b])
        good = np.flatnonzero((r >= gram) & (lo <= hi))
        good = good[_equal(data, anchor[a[good]] - hi[good], anchor[b[good]] - hi[good], length + hi[good] - lo[good])]
        for x in (a, b):
            np.maximum.at(high, x[good], hi[good])
            lowest = np.full(n, 1 << 30)
            np.minimum.at(lowest, x[good], lo[good])
            np.copyto(low, lowest, where=(lowest < 1 << 30) & ((low < 0) | (lowest < low)))
    # no window beyond these can be repeated; between them and what is found, ask each window
    floor, ceiling = np.maximum(length - best_right, near), np.minimum(best_left, far)
    open_ = (floor <= ceiling) & ((high < 0) | (low > floor) | (high < ceiling))
    if open_.any():
        ask = np.unique(group[open_])
        rows = np.flatnonzero(np.isin(group, ask))
        for o in range(int(floor[open_].min()), int(ceiling[open_].max()) + 1):
            wants = open_ & (floor <= o) & (o <= ceiling) & ((low < 0) | (o < low) | (o > high))
            if not wants.any():
                continue
            some = rows[(near[rows] <= o) & (o <= far[rows])]
            some = some[np.isin(group[some], group[wants])]
            key = text.of(anchor[some] - o, length)
            order = some[np.lexsort((key, group[some]))]
            key = text.of(anchor[order] - o, length)
            same = np.flatnonzero((group[order[1:]] == group[order[:-1]]) & (key[1:] == key[:-1]))
            same = same[_equal(data, anchor[order[same]] - o, anchor[order[same + 1]] - o, np.full(len(same), length))]
            hit = np.unique(np.concatenate([order[same], order[same + 1]]))
            low[hit] = np.where((low[hit] < 0) | (o < low[hit]), o, low[hit])
            high[hit] = np.maximum(high[hit], o)
    return low, high


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of those pairs of stretches that are equal byte by byte."""
    good = [np.empty(0, np.int64)]
    for lo in range(0, len(a), 4096):
        x, y, s = a[lo : lo + 4096], b[lo : lo + 4096], size[lo : lo + 4096]
        step = np.arange(int(s.max(initial=0)))
        inside = step < s[:, None]
        i, j = np.minimum(x[:, None] + step, len(data) - 1), np.minimum(y[:, None] + step, len(data) - 1)
        good.append(lo + np.flatnonzero(((data[i] == data[j]) | ~inside).all(1)))
    return np.concatenate(good)


def _raw(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def cover(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of a set of half-open intervals; runs that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


#: Up to so many repeated anchors (8 bytes each) are sent to all executors; beyond, they are joined by shuffle.
_BROADCAST_ANCHORS = 4_000_000
#: Up to so many classes of one anchor are sorted in one task; larger groups are split by window.
_GROUP = 20_000


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32) -> DataFrame:
    """(id, stamp, spans array<struct<s, e>>) for each text with a byte string of ``length`` that starts anywhere else too.

    ``stamp`` is the text's hash, which tells rows of one id apart.  Spans are byte positions, end exclusive.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.octet_length("text") >= length)
    rows = rows.select("id", "text", F.xxhash64("text").alias("stamp"))
    parts = max(partitions(spark), 8)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [anchors(_raw(t), length, gram)[0] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found]))], ["key"])

    counted = rows.select("text").mapInArrow(keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    path = shared_dir(spark)
    counted.write.parquet(f"{path}/keys")
    again = spark.read.parquet(f"{path}/keys")
    few = again.count() <= _BROADCAST_ANCHORS
    if few:
        known = spark.sparkContext.broadcast(np.sort(again.toArrow()["key"].to_numpy()))

    def cut(b: pa.RecordBatch, lists: list | None) -> Iterator[tuple]:
        """(key, near, far, context, id, stamp, place) of the repeated anchors of each text."""
        for k, (i, t, stamp) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]))):
            raw = _raw(t)
            key, at, first, last = anchors(raw, length, gram)
            own = known.value if few else np.sort(np.array(lists[k], np.int64))
            if not len(own):
                continue
            hit = np.minimum(np.searchsorted(own, key), len(own) - 1)
            for j in np.flatnonzero(own[hit] == key).tolist():
                yield int(key[j]), int(at[j] - last[j]), int(at[j] - first[j]), raw[first[j] : last[j] + length], i, stamp, int(at[j])

    def class_of(near: int, far: int, context: bytes) -> bytes:
        return md5(context + b":%d:%d" % (near, far), usedforsecurity=False).digest()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [(k, near, far, c) for k, near, far, c, *_ in cut(b, b.column(3).to_pylist() if b.num_columns > 3 else None)]
            for lo in range(0, len(found), 5000):
                cols = list(zip(*found[lo : lo + 5000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["key", "near", "far", "context"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [(class_of(near, far, c), i, stamp, at) for _, near, far, c, i, stamp, at in cut(b, b.column(3).to_pylist() if b.num_columns > 3 else None)]
            cols = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], kind), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["class", "id", "stamp", "at"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[id_col].dataType)
    source = rows.select("id", "text", "stamp")
    if not few:  # the repeated anchors of each text come to it by two shuffles
        def own(batches):
            for b in pieces(batches):
                found = [(i, s, anchors(_raw(t), length, gram)[0]) for i, t, s in zip(*(c.to_pylist() for c in b.columns))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, k in found for _ in k], kind), pa.array([s for _, s, k in found for _ in k], pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *(k for *_, k in found)]))], ["i", "s", "key"]
                )

        lists = source.mapInArrow(own, f"i {id_type}, s long, key long").join(again, "key").groupBy("i", "s").agg(F.collect_set("key").alias("keys"))
        source = source.join(lists, F.col("id").eqNullSafe(F.col("i")) & (F.col("stamp") == F.col("s"))).select("id", "text", "stamp", "keys")

    classes = source.mapInArrow(contexts, "key long, near int, far int, context binary")
    classes = classes.groupBy("key", "near", "far", "context").agg(F.count(F.lit(1)).alias("n")).withColumn("class", _class())
    classes.write.option("compression", "zstd").parquet(f"{path}/classes")
    results = settle(spark.read.parquet(f"{path}/classes"), f"{path}/split", length, gram, parts)
    found = source.mapInArrow(members, f"class binary, id {id_type}, stamp long, at long").join(results.withColumnRenamed("class", "c"), F.col("class") == F.col("c"))
    span = F.struct((F.col("at") - F.col("high")).alias("s"), (F.col("at") - F.col("low") + length).alias("e"))
    return found.groupBy("id", "stamp").agg(F.collect_set(span).alias("spans"))


def _class(*more: str):
    """The digest that names a class: of its context, its offsets, and where a context may stand in several groups, the group."""
    return F.unhex(F.md5(F.concat("context", *(F.encode(F.concat(F.lit(":"), F.col(c).cast("string")), "utf-8") for c in ("near", "far", *more)))))


def settle(classes: DataFrame, path: str, length: int, gram: int, parts: int, width: int | None = None) -> DataFrame:
    """(class, low, high) for classes (key, near, far, class, context, n): the offsets whose windows are repeated.

    A group of more than `_GROUP` classes is split by window: each class goes to several groups, each for a part
    of its offsets, named by the bytes that all windows of that part share; classes that are equal there become
    one.  Parts get narrower until groups are small; a part of one offset is decided by counting alone.
    """
    spark = classes.sparkSession
    width = width or length

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            low, high = repeated_offsets(t["key"].to_numpy(), t["context"].to_pylist(), t["near"].to_numpy().astype(np.int64), t["far"].to_numpy().astype(np.int64), t["n"].to_numpy() > 1, length, gram)
            good = np.flatnonzero(low >= 0)
            return pa.RecordBatch.from_arrays([t["class"].take(good).combine_chunks(), pa.array(low[good]), pa.array(high[good])], ["class", "low", "high"])

        held: list[pa.Table] = []
        for b in pieces(batches):
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held.append(t)
            if sum(map(len, held)) >= 5000:
                every = pa.concat_tables(held)
                key = every["key"].to_numpy()
                whole = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1  # the last group may go on
                if whole:
                    yield close(every.slice(0, whole))
                held = [every.slice(whole)]
        if held:
            yield close(pa.concat_tables(held))

    names = ["key", "near", "far", "class", "context", "n"]
    big = classes.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > _GROUP).select(F.col("key").alias("big"))
    whole = width == 1 or big.isEmpty()
    now = classes if whole else classes.join(big, F.col("key") == F.col("big"), "left_anti")
    done = now.select(*names).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(sort, "class binary, low long, high long")
    if whole:
        return done
    width = max(1, width // 8)
    hot = classes.join(big, F.col("key") == F.col("big"), "left_semi")
    hot = hot.withColumn("piece", F.explode(F.sequence(F.floor(F.col("near") / width), F.floor(F.col("far") / width))))
    hot = hot.withColumns({"near2": F.greatest("near", F.col("piece") * width).cast("int"), "far2": F.least("far", F.col("piece") * width + width - 1).cast("int")})
    # every window of a part holds the bytes from its latest start to its earliest end; they name the group
    shared = F.expr(f"substring(context, cast(far - piece * {width} + 1 as int), {length - width + 1})")
    hot = hot.withColumn("shared", shared).withColumn("context", F.expr("substring(context, far - far2 + 1, length(context) - (far - far2) - (near2 - near))"))
    hot = hot.select(F.xxhash64("key", "piece", "shared").alias("key"), F.col("near2").alias("near"), F.col("far2").alias("far"), "context", "n", F.col("class").alias("of"))
    hot = hot.withColumn("class", _class("key"))
    hot.write.option("compression", "zstd").parquet(path)
    hot = spark.read.parquet(path)
    inner = hot.groupBy("key", "near", "far", "class").agg(F.first("context").alias("context"), F.sum("n").alias("n"))
    settled = settle(inner, f"{path}-", length, gram, parts, width).withColumnRenamed("class", "c")
    parts_ = hot.select("of", F.col("class").alias("c")).distinct().join(settled, "c").groupBy("of").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return done.unionByName(parts_.withColumnRenamed("of", "class"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32) -> DataFrame:
    """For each row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Each byte inside a ``length``-byte string that also starts anywhere else, in the same text or another, is
    removed; strings are judged on the input.  Null and empty texts have 0 bytes; texts shorter than ``length``
    keep all.  Rows are texts of their own even if they repeat an id or are wholly equal (then both lose what they
    share).  An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    spans = repeats(docs, id_col, text_col, length, gram).select(F.col("id").alias("i"), F.col("stamp").alias("s"), "spans")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("stamp", F.xxhash64("text"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("stamp") == F.col("s")), "left").select("id", "text", F.transform("spans", lambda x: F.array(x["s"], x["e"])).alias("spans"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, runs, at, kept = _raw(t), cover(found or []), 0, []
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                left = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(left), len(runs), sha256(left).hexdigest(), left))
            cols = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(strip, f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
