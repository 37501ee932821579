"""Conversations as one training text each, by Spark expressions alone.

The template: a block opens with ``### role`` and a line end, each of its turns closes with ``</turn>``, and a line end closes the
block.  Adjacent turns of one role share a block.  Inside texts and roles a control string becomes a backslash and a digit, so
that neither ``###`` nor ``</turn>`` occurs there and the output can be split by plain strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

OPEN, CLOSE, END = "### ", "</turn>", "\n"
#: Backslash first: every backslash of an escaped text starts one of these.
CODES = [("\\", "\\0"), ("###", "\\1"), (CLOSE, "\\2"), ("\n", "\\3")]


def escape(text: Column, name: bool = False) -> Column:
    """Control strings as codes; in a role's name line ends as well."""
    for plain, code in CODES if name else CODES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value reckoned once: a column that a lambda names may be put into it whole, and run for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def before(sizes: Column, step: int = 256) -> Column:
    """For each element of an array of numbers the sum of those before it.

    Appending copies the list, so sums run inside pieces of ``step`` elements and over the pieces: n ** 1.5 copies, not n ** 2.
    """
    nothing = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("list"))
    running = lambda xs: F.aggregate(xs, nothing, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["list"], F.array(a["sum"])).alias("list")), lambda a: a["list"])
    cuts = lambda xs: F.filter(F.sequence(F.lit(0), F.size(xs)), lambda i: (i % step == 0) & (i < F.size(xs)))
    parts = _let(sizes, lambda xs: F.transform(cuts(xs), lambda i: F.slice(xs, i + 1, step)))
    sums = lambda ps: F.transform(ps, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
    return _let(parts, lambda ps: F.flatten(F.zip_with(ps, running(sums(ps)), lambda p, base: F.transform(running(p), lambda x: x + base))))


def format_conversations(rows: DataFrame, learn: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, loss array<struct<turn int, start bigint, length int>>): one row for each conversation.

    ``loss`` marks the texts of the roles in ``learn``: the number of the turn (from 0), and in ``formatted`` the first code point (from
    0) and how many.  Headers and closing strings are not learnt.

    Cases: null texts and roles are empty; an empty text has a span of length 0.  Turns that share a number go by role, then text;
    null numbers come first.  Repeated rows are turns each.  Rows without an id are one conversation.  An empty table gives no rows.
    Other columns play no part.  A conversation is one row of the result, so its turns meet in one task and are sorted there; Spark
    holds rows of up to 2 GB.
    """
    col = lambda c: F.col(f"`{c}`")
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    turn = F.struct(col(turn_col).alias("n"), text(role_col).alias("role"), text(text_col).alias("text"))
    out = rows.select(col(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # adjacent turns of one role, as slices between the places where the role changes
    change = lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"])
    out = out.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("t") - 1), change))
    until = lambda k: F.coalesce(F.get("at", k + 1), F.size("t"))
    out = out.withColumn("blocks", F.transform("at", lambda i, k: F.slice("t", i + 1, until(k) - i)))

    def pieces(block: Column) -> Column:
        """Turns of a block: the first carries the header, the last ends the block."""
        head = lambda x, j: F.when(j == 0, F.concat(F.lit(OPEN), escape(x["role"], name=True), F.lit(END))).otherwise("")
        tail = lambda j: F.when(j == F.size(block) - 1, CLOSE + END).otherwise(CLOSE)
        return F.transform(block, lambda x, j: F.struct(x["role"].alias("role"), head(x, j).alias("head"), escape(x["text"]).alias("text"), tail(j).alias("tail")))

    out = out.withColumn("p", F.flatten(F.transform("blocks", pieces)))
    starts = before(F.transform("p", lambda x: F.length(x["head"]) + F.length(x["text"]) + F.length(x["tail"])))
    own = F.zip_with("p", starts, lambda x, s: F.struct(x["role"].alias("role"), (s + F.length(x["head"])).alias("start"), F.length(x["text"]).alias("length")))
    span = F.transform(own, lambda x, i: F.struct(x["role"].alias("role"), F.struct(i.alias("turn"), x["start"].alias("start"), x["length"].alias("length")).alias("of")))
    loss = F.transform(F.filter(span, lambda x: x["role"].isin(*learn)), lambda x: x["of"])
    formatted = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["text"], x["tail"])), "")
    return out.select(F.col("id").alias(id_col), formatted.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, formatted, turns array<struct<role, text>>, learnt array<string>): what `format_conversations` has put into ``formatted``.

    Turns come from the text alone; ``learnt`` holds the unescaped text under each span of ``loss``.
    """
    placed = lambda ps: F.zip_with(ps, before(F.transform(ps, lambda x: F.length(x) + len(CLOSE))), lambda x, at: F.struct(x.alias("piece"), at.alias("start")))
    role = lambda b: F.substring_index(b, END, 1)
    texts = lambda b: F.split(F.substr(b, F.length(role(b)) + 2), CLOSE)
    turns = lambda b: F.transform(F.slice(texts(b), 1, F.size(texts(b)) - 1), lambda x: F.struct(unescape(role(b)).alias("role"), unescape(x).alias("text")))
    under = lambda p, s: unescape(F.substr(p["piece"], (s["start"] - p["start"] + 1).cast("int"), s["length"]))
    learnt = _let(_let(F.split("formatted", CLOSE), placed), lambda ps: F.transform("loss", lambda s: under(F.get(ps, s["turn"]), s)))
    every = _let(F.split("formatted", OPEN), lambda bs: F.flatten(F.transform(F.slice(bs, F.lit(2), F.size(bs)), turns)))
    return formatted.select(F.col(f"`{id_col}`"), "formatted", every.alias("turns"), learnt.alias("learnt"))


def digest(rows: DataFrame, **columns: str) -> DataFrame:
    """Formats all conversations, writes them, and digests what is read back; the cases are those of `format_conversations`.

    id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars and loss_sha256 (all text under the mask),
    formatted_chars.
    """
    id_col = columns.get("id_col", "conv_id")
    back = read_turns(checkpoint(format_conversations(rows, **columns)), id_col)
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = back.select(F.col(f"`{id_col}`"), "formatted", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), F.array_join("learnt", "").alias("learnt"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    chars = lambda c: F.length(c).cast("long")
    return out.select(f"`{id_col}`", "n_turns", sha("told").alias("turns_sha256"), chars("learnt").alias("loss_chars"), sha("learnt").alias("loss_sha256"), chars("formatted").alias("formatted_chars"))
