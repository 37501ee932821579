"""How filters act together: what each one removes, and would remove, in every order of applying them.

Documents are first reduced to mask cells: (part, bits of the filters that fail) with counts.  A recursive common table
expression then extends prefixes of filters by every unused letter, joins each with the cells of its part, carries the bits
already applied, and each level emits the metrics of that step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpoint

_WORDS = lambda t: F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))
_SIZE = lambda c: F.size(c).cast("long")
_CHARS = lambda t: F.length(t).cast("long")

#: letter -> does a text (never null) fail?
FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": lambda t: _SIZE(_WORDS(t)) < 100,
    "B": lambda t: 100 * _SIZE(F.array_distinct(_WORDS(t))) < 80 * _SIZE(_WORDS(t)),
    "C": lambda t: 100 * _CHARS(F.regexp_replace(t, "[^A-Z]+", "")) > 10 * _CHARS(t),
    "D": lambda t: t.rlike(r"[#$%&*|]"),
}
#: The letter of the filter against copies: a text equal to that of a smaller id, whatever the part.
COPIES = "E"
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = FILTERS, copies: str = COPIES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just the filters whose bits ``mask`` holds.

    Bits follow the order of ``filters``, the last is that of ``copies``.  Rows of one text meet only as counts: a group of
    copies, however large, sends a row for each task and label.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    mask = sum((F.when(fails(F.col("t")), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    d = d.select("id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("h"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.groupBy(F.col("doc_id").alias("k")).agg(flag("quality"), flag("toxic"))
    rows = d.join(known, F.col("id") == F.col("k"), "left").fillna(0, ["quality", "toxic"])
    group = ["h", "part", "mask", "quality", "toxic"]
    ids = rows.groupBy(*group, "id").agg(F.count(F.lit(1)).alias("n"))
    some = ids.groupBy(*group).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    # rows of a text are few now: one for each part and label it occurs with
    least = some.groupBy("h").agg(F.min("least").alias("least"), F.collect_list(F.struct("part", "mask", "quality", "toxic", "n", F.col("least").alias("own"), "at_least", "no_id")).alias("of"))
    one = least.select("least", F.inline("of"))
    first = F.col("no_id") + F.when(F.col("own") == F.col("least"), F.col("at_least")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), first.alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - first).alias("n")))
    cut = one.select("part", "quality", "toxic", F.inline(both)).filter("n > 0")
    return cut.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def enumerate_orders(masks: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and `METRICS` of every order of ``letters``, from the table of `cells` (bit k: letter k).

    The recursion holds a row for each part and prefix; a part's cells are at most 2 ** len(letters).
    """
    if not 1 <= len(letters) <= 7 or len(set(letters)) != len(letters):
        raise ValueError("1 to 7 different letters")
    packed = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("of"))
    of = lambda what, when: f"aggregate(c.of, 0L, (a, x) -> a + CASE WHEN {when} THEN x.{what} ELSE 0L END)"
    now = "x.mask & l.bit > 0 AND x.mask & s.applied = 0"
    metrics = {
        "kept": of("n", "x.mask & (s.applied | l.bit) = 0"), "removed": of("n", now), "redundant": of("n", "x.mask & l.bit > 0 AND x.mask & s.applied > 0"),
        "unique_fails": of("n", "x.mask = l.bit"), "good_lost": of("good", now), "toxic_lost": of("toxic", now),
    }
    kind = ", ".join(f"{m}: BIGINT" for m in METRICS)
    return masks.sparkSession.sql(
        f"""WITH RECURSIVE letters(letter, bit) AS (VALUES {", ".join(f"('{x}', {1 << k})" for k, x in enumerate(letters))}),
        prefixes(part, filter_order, applied, path) AS (
            SELECT part, '', 0, CAST(array() AS ARRAY<STRUCT<{kind}>>) FROM {{cells}}
            UNION ALL
            SELECT s.part, s.filter_order || l.letter, s.applied | l.bit, s.path || array(named_struct({", ".join(f"'{m}', {metrics[m]}" for m in METRICS)}))
            FROM prefixes s JOIN letters l ON s.applied & l.bit = 0 JOIN {{cells}} c ON c.part = s.part)
        SELECT part, filter_order, CAST(pos + 1 AS INT) AS step, {", ".join(METRICS)}
        FROM (SELECT part, filter_order, posexplode(path) AS (pos, m) FROM (SELECT * FROM prefixes LIMIT ALL) WHERE length(filter_order) = {len(letters)}) LATERAL VIEW inline(array(m)) x AS {", ".join(METRICS)}""",
        cells=checkpoint(packed),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = FILTERS, copies: str = COPIES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each part, order of filters and step: part, filter_order, step, `METRICS` and shapley, zeros included.

    kept: documents that no filter so far has removed; removed: those this step removes; redundant: those that fail its filter but
    are gone; unique_fails: those that fail no other; good_lost and toxic_lost: removed ones with a label quality = 1 or
    toxic = 1; shapley: what the filter removes, summed over all orders.

    Cases: null texts are empty; null parts are ''.  Rows that repeat an id and a text are documents each, and none of them is a
    copy of the other (neither id is smaller); a row without an id is no copy and makes none.  Of several labels of one document
    any counts, and documents without labels are neither good nor toxic.  An empty table gives no rows.  Other columns play no
    part.
    """
    steps = enumerate_orders(cells(docs, labels, filters, copies, id_col, text_col, part_col), "".join(filters) + copies)
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", F.expr("substr(filter_order, step, 1)"))))
