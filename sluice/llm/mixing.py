"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all non-negative document rates w whose words sum to each source's target, entropy balancing takes the one
closest to 1 in relative entropy: w = exp(lambda * size), here held at most ``max_copies``.  The dual is convex and
falls apart into one unknown per source, which safeguarded Newton steps find.  Rates depend on (source, size) only,
so a step runs over the table of distinct (source, size) pairs; rates are then rounded into copies along the sizes,
which keeps each source's words within about half a document of their target.

Sums are exact decimals, so nothing depends on the order in which tasks finish: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpoint

_SUM = "decimal(38,12)"
#: Up to so many sources (a hundred bytes each) their state is broadcast; the number is counted first.
_BROADCAST_SOURCES = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Sources in code-point order, null last, take ``weights`` in turn.  Targets share out all words by weight;
    none exceeds ``max_copies`` times its source, and what is cut off goes to the others by weight.  Sources are
    cut in the order of source_size / weight, so the level at which the sharing stops has a closed form.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    # if all before this row are cut, what is left for each unit of weight from here on
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", level).withColumn("cut", F.col("level") * F.col("weight") >= F.col("cap"))
    stop = F.min(F.when(~F.col("cut"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(W.partitionBy())["level"]
    return w.select("source", "source_size", F.when(F.col("cut") | stop.isNull(), F.col("cap")).otherwise(F.least(stop * F.col("weight"), "cap")).alias("target"))


def rate(lam: Column, size: Column, max_copies: int) -> Column:
    # beyond the limit's logarithm the exponential is cut off, so it cannot overflow
    return F.least(F.exp(F.least(lam * size, F.log(F.lit(float(max_copies))) + 1)), F.lit(float(max_copies)))


def solve(table: DataFrame, goals: DataFrame, max_copies: int, steps: int, tolerance: float, few: bool) -> DataFrame:
    """(source, source_size, target, lam) for (source, size, n): safeguarded Newton on sum(n * size * rate) = target.

    ``few``: the sources are few enough to broadcast their state; otherwise it is joined by shuffle.  The root lies between two bounds known beforehand; a step that would leave them halves them instead.
    """
    size, lam = F.col("size").cast("double"), F.col("lam")
    # at ln(max_copies) every document is at the limit; at min(0, ln(target / size)) the sum cannot exceed the target
    high = F.log(F.lit(float(max_copies)))
    share = F.col("target") / F.greatest(F.col("source_size"), F.lit(1)).cast("double")
    state = goals.withColumns(
        {
            "full": F.col("target") >= F.col("source_size") * F.lit(max_copies * (1 - 1e-12)),
            "lo": F.least(F.lit(0.0), F.log(F.greatest(share, F.lit(1e-300)))),
            "hi": high,
        }
    ).withColumn("lam", F.when(F.col("full"), high).otherwise(F.lit(0.0)))
    state = checkpoint(state)
    for _ in range(steps):
        r = rate(lam, size, max_copies)
        grows = F.when(r < max_copies, F.col("n") * size * size * r).otherwise(F.lit(0.0))
        joined = table.join(F.broadcast(state) if few else state, F.col("source").eqNullSafe(F.col("of")))
        sums = joined.groupBy("of").agg(F.sum((F.col("n") * size * r).cast(_SUM)).alias("words"), F.sum(grows.cast(_SUM)).alias("slope"))
        gap = F.col("words").cast("double") - F.col("target")
        done = F.col("full") | (F.abs(gap) <= F.col("target") * tolerance)
        step = lam - gap / F.col("slope").cast("double")
        lo, hi = F.when(gap < 0, lam).otherwise(F.col("lo")), F.when(gap > 0, lam).otherwise(F.col("hi"))
        new = F.when(done, lam).when((F.col("slope") > 0) & (step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        same = sums.withColumnRenamed("of", "key")
        state = checkpoint(
            state.join(same, F.col("of").eqNullSafe(F.col("key")), "left")
            .withColumns({"new": F.coalesce(new, lam), "lo2": F.coalesce(lo, "lo"), "hi2": F.coalesce(hi, "hi"), "done": F.coalesce(done, F.lit(True))})
            .select("of", "source_size", "target", "full", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("new").alias("lam"), "done")
        )
        if state.filter(~F.col("done")).isEmpty():
            break
        state = state.drop("done")
    return state.select("of", "source_size", "target", "lam", "full")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_copies: int = 3,
    steps: int = 60,
    tolerance: float = 1e-9,
    rows_per_group: int = 20_000,
    keep: list[str] | None = None,
    nest: bool = False,
) -> DataFrame:
    """For each row: id, the columns in ``keep``, size, source_size, target, copies, taken (= copies * size).

    ``nest`` leaves id and ``keep`` in one struct ``row``, whatever their names.

    ``size`` is the number of words (null and empty texts: 0).  No document is copied more than ``max_copies``
    times; documents without words get no copy.  A null source is a source of its own.  An empty table gives
    an empty result; rows with equal or null ids are rounded one by one, each in its place.

    Ranks within a (source, size) group of more than ``rows_per_group`` rows are made in salted parts of about so
    many, and sums run first over a source's sizes, then over a size's parts, so a source or a size that holds most of
    the table is spread over tasks.  Rows are told apart by a hash of their id and text (and, where these agree, of
    their other columns but maps), so reruns agree.  One pass over the texts; afterwards only ids, sources and sizes
    move (with ``keep``, those columns too).
    """
    cols = [id_col, *(keep or [])]
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in cols)).alias("row")
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    hashed = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))
    h = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    sized = checkpoint(docs.select(row, F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"), h.alias("h"), hashed.alias("h2")))

    groups = checkpoint(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    table = groups.filter("size > 0")
    big = groups.filter(F.col("n") > rows_per_group).select(F.col("source").alias("s"), F.col("size").alias("z"), F.ceil(F.col("n") / rows_per_group).cast("int").alias("salts"))
    salted = sized.join(big, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    sized = salted.withColumn("salt", F.pmod(F.col("h"), F.coalesce("salts", F.lit(1))).cast("int")).select("row", "source", "size", "h", "h2", "salt")
    parts = checkpoint(sized.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n")))
    sizes = parts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(sizes, weights, max_copies).withColumnRenamed("source", "of")
    goals = checkpoint(goals)
    few = goals.count() <= _BROADCAST_SOURCES
    solved = solve(table, goals, max_copies, steps, tolerance, few)

    # the fraction of a copy that each part is owed, summed along the sizes; copies fall where the sum passes a half
    r = F.when(F.col("full"), F.lit(float(max_copies))).otherwise(rate(F.col("lam"), F.col("size").cast("double"), max_copies))
    r = F.when(F.col("size") > 0, r).otherwise(F.lit(0.0))
    rated = groups.join(F.broadcast(solved) if few else solved, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", r.cast("decimal(20,12)"))
    rated = rated.withColumn("part", F.col("rate") - F.floor("rate"))
    owed = F.col("part") * F.col("n")
    along = W.partitionBy("of").orderBy(F.col("size").desc())
    rated = rated.withColumn("first", F.sum(owed).over(along) - owed).select("of", F.col("size").alias("size_of"), "source_size", "target", "rate", "part", "first")
    # inside a size, its parts one after the other
    inside = W.partitionBy("source", "size").orderBy("salt")
    ahead = parts.select(F.col("source").alias("part_of"), F.col("size").alias("part_size"), "salt", (F.sum("n").over(inside) - F.col("n")).alias("ahead")).withColumnRenamed("salt", "salt_of")
    plan = ahead.join(rated, F.col("part_of").eqNullSafe(F.col("of")) & (F.col("part_size") == F.col("size_of"))).withColumn("start", F.col("first") + F.col("part") * F.col("ahead")).drop("part_of", "part_size")

    place = F.row_number().over(W.partitionBy("source", "size", "salt").orderBy("h", "h2")) - 1
    joined = sized.withColumn("place", place).join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("size_of")) & (F.col("salt") == F.col("salt_of")))
    at = F.col("start") + F.col("part") * F.col("place")
    half = F.lit("0.5").cast("decimal(2,1)")
    copies = (F.floor("rate") + F.floor(at + F.col("part") + half) - F.floor(at + half)).cast("long")
    return joined.select("row" if nest else "row.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def digest(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, size, source_size, target and taken, as `mix` has them."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row as often as `mix` copies it, with all its columns.

    Every row has its own copies, also where rows repeat an id or are wholly equal.  Null and empty texts have no
    words and are never taken.  An empty table gives an empty result; columns may have any names.
    """
    mixed = mix(docs, id_col, text_col, source_col, keep=[c for c in docs.columns if c != id_col], nest=True, **options).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*(F.col(f"row.`{c}`") for c in docs.columns))
