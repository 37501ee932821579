"""Secret scans in SQL expressions only: fixed patterns, and sliding-window entropy over candidate strings.

Java's regular expressions give matches but no positions, so a text is split by the pattern and the lengths
of the pieces between the matches give them back.  Everything happens within a row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in order, the pattern of each, the group that must be long enough and its least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Words of placeholders and alphabets in order.
WORDS = r"(?i:example|placeholder|changeme|dummy|sample|your[_-]|xxxx|0123456789|abcdefgh)"
#: Maximal runs of the characters that keys are written in.  All but the assignments lie inside one.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: What every text with such a run holds: one range of code points, which is soon searched for.
LIKELY = r"(?<![+-z])[+-z]{20}"
#: What every assignment holds, in small letters.
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]
#: Candidate strings of the entropy scan: runs cut at `WORDS` (which match as themselves).
CANDIDATE = WORDS + r"|(?:(?!" + WORDS + r")[A-Za-z0-9+/_=-]){20,}+"
#: Their pieces between signs, so that a name before a key does not decide on the key.
PIECE = r"[A-Za-z0-9]{20,}"
#: name -> (what a whole window is made of, what the candidate must hold besides, least entropy in bits over the window).
CLASSES = {
    "hex": (r"^[0-9A-Fa-f]+$", r"(?=.*[0-9])(?=.*[A-Fa-f])", 3.0),
    "base64": (r"^[A-Za-z0-9+/_=-]+$", r"(?=.*[0-9].*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3.9),
}
#: The same for pieces; base32 and base36 keys have one case only.
PIECE_CLASSES = {
    "hex": CLASSES["hex"],
    "upper": (r"^[A-Z0-9]+$", r"(?=.*[0-9].*[0-9])(?=.*[A-Z])", 3.5),
    "lower": (r"^[a-z0-9]+$", r"(?=.*[0-9].*[0-9])(?=.*[a-z])", 3.5),
    "mixed": (r"^[A-Za-z0-9]+$", r"(?=.*[0-9].*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3.7),
}
#: Strings that look random and are none: UUIDs, placeholders, alphabets in order, account numbers, paths and slugs of plain words.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    WORDS,
    r"^[A-Z]{2}[0-9]{13,32}$",
    r"^[A-Z]{2}[0-9]{2}[A-Z]{1,4}[0-9]{10,26}$",
    r"^[/_-]?+[A-Za-z]*+[0-9]{0,4}+(?:[/_-][A-Za-z]*+[0-9]{0,4}+)*+=?$",
]


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once: inside a lambda only variables are not computed again at each step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join, zero: Column) -> Column:
    """For each element what ``join`` makes of all elements before it.

    An accumulator that holds an array is copied at each step, so this goes in two levels: over blocks of about the
    root of the size, and inside a block.
    """
    total = lambda part: F.aggregate(part, zero, join)

    def blocks(v: Column) -> Column:
        def inside(step: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / step).cast("int")), lambda b: total(F.slice(v, b * step + 1, step)))
            before = lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))
            each = lambda p: F.transform(v, lambda _, i: join(F.get(p, F.floor(i / step).cast("int")), total(F.slice(v, i - i % step + 1, i % step))))
            return let(sums, lambda s: let(before(s), each))

        return let(F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1)), inside)

    return let(values, blocks)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as array<struct<s, e, m, g>>: code points, end exclusive, the match, its group.

    Texts without a match are told apart by one search and get an empty array.
    """
    p = F.lit(pattern)
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, p, F.lit(0))
    groups = F.regexp_extract_all(text, p, F.lit(group)) if group else found

    def placed(rows: Column) -> Column:
        sizes = F.transform(rows, lambda x: x["gap"] + F.length(x["m"]))
        both = F.arrays_zip(rows.alias("row"), running(sizes, lambda x, y: x + y, F.lit(0)).alias("before"))
        start = lambda x: x["before"] + x["row"]["gap"]
        return F.transform(both, lambda x: F.struct(start(x).alias("s"), (start(x) + F.length(x["row"]["m"])).alias("e"), x["row"]["m"].alias("m"), x["row"]["g"].alias("g")))

    gaps = lambda m: F.transform(F.slice(between, F.lit(1), F.size(m)), F.length)
    walked = let(found, lambda m: let(F.arrays_zip(m.alias("m"), groups.alias("g"), gaps(m).alias("gap")), placed))
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast("array<struct<s:int,e:int,m:string,g:string>>"))


def runs(text: Column) -> Column:
    """`RUN` in the text, as `matches` gives it."""
    return F.when(text.rlike(LIKELY), matches(text, RUN)).otherwise(F.array().cast("array<struct<s:int,e:int,m:string,g:string>>"))


def inside(found: Column, search) -> Column:
    """What ``search`` (of a string, as `matches` gives it) finds inside each of ``found``, placed in the text."""
    moved = lambda run, x: F.struct((run["s"] + x["s"]).alias("s"), (run["s"] + x["e"]).alias("e"), x["m"].alias("m"), x["g"].alias("g"))
    return F.flatten(F.transform(found, lambda run: F.transform(search(run["m"]), lambda x: moved(run, x))))


def base_matches(text: Column, found: Column) -> list[Column]:
    """The fixed patterns' spans, a column for each kind; ``found`` is `runs` of the text.

    A match of 20 or more key characters lies inside one run, and matches never reach beyond a run, so those
    inside shorter runs, which are dropped anyway, need no search.  Texts without a name of `NAMES` have no assignment.
    """
    low, named = F.lower(text), F.lit(False)
    for name in NAMES:
        named = named | low.contains(name)
    out = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign":
            at = F.when(named, matches(text, pattern, group)).otherwise(F.array().cast("array<struct<s:int,e:int,m:string,g:string>>"))
        else:
            at = inside(found, lambda run, pattern=pattern, group=group: matches(run, pattern, group))
        out.append(_spans(F.filter(at, _at_least(least)), kind, order))
    return out


def window_entropy(s: Column, window: int) -> Column:
    """The largest Shannon entropy in bits of any ``window`` characters in a row of ``s``.

    The window slides by one character at a time.  Its state is the count of every character in it and the
    sum of count * log2(count); a step changes the counts and the two terms of the character that comes and the
    one that goes.  Nothing else is carried along, so the cost of a step does not depend on the string's length.
    """
    term = lambda n: F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def slide(codes: Column, size: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            counts = state["counts"]
            new, old = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(0))
            changes = new != old
            up, down = F.get(counts, new - 1), F.get(counts, old - 1)
            gained = F.when(changes, term(up + 1) - term(up)).otherwise(F.lit(0.0))
            lost = F.when(changes & (old > 0), term(down - 1) - term(down)).otherwise(F.lit(0.0))
            total = state["total"] + gained + lost
            return F.struct(
                F.when(changes, F.transform(counts, lambda n, k: n + (k == new - 1).cast("int") - (k == old - 1).cast("int"))).otherwise(counts).alias("counts"),
                total.alias("total"),
                F.when(i >= window - 1, F.least(state["least"], total)).otherwise(state["least"]).alias("least"),
            )

        start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))
        steps = F.sequence(F.lit(0), F.greatest(F.size(codes) - 1, F.lit(0)))
        # H = log2(w) - sum(c log2 c) / w
        return F.aggregate(steps, start, step, lambda st: F.log2(F.lit(float(window))) - st["least"] / F.lit(float(window)))

    coded = lambda chars, alphabet: let(F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int")), lambda codes: slide(codes, F.size(alphabet)))
    return let(F.filter(F.split(s, ""), lambda c: c != ""), lambda chars: let(F.array_distinct(chars), lambda alphabet: coded(chars, alphabet)))


def entropy_matches(found: Column, window: int = 20, classes: dict | None = None, allowed: list[str] | None = None, piece_classes: dict | None = None) -> Column:
    """array<struct<k, s, e, o>>: candidate strings, and pieces of others, of which some window is as mixed as random text of its class.

    ``found`` is `runs` of the text: candidates are runs cut at `WORDS`, and pieces lie inside runs.  The allow-list is matched against the string or piece itself, before any entropy is computed.
    """
    allowed = ALLOWED if allowed is None else allowed

    def suspicious(kinds: dict):
        def test(x: Column) -> Column:
            of = lambda pattern, needs: x["m"].rlike(pattern) & x["m"].rlike("^" + needs)
            some, mixed, free = F.lit(False), F.lit(False), F.lit(True)
            for pattern, needs, least in kinds.values():
                some = some | of(pattern, needs)
                mixed = mixed | F.when(of(pattern, needs), window_entropy(x["m"], window) >= least).otherwise(F.lit(False))
            for pattern in allowed:
                free = free & ~x["m"].rlike(pattern)
            return F.when((F.length(x["m"]) >= 20) & some & free, mixed).otherwise(F.lit(False))

        return test

    uncut = lambda run: F.array(F.struct(F.lit(0).alias("s"), F.length(run).alias("e"), run.alias("m"), run.alias("g")))
    cut = lambda run: F.when(run.rlike(WORDS), matches(run, CANDIDATE)).otherwise(uncut(run))
    whole = _spans(F.filter(inside(found, cut), suspicious(classes or CLASSES)), "entropy", len(BASE))
    pieces = _spans(F.filter(inside(found, lambda run: matches(run, PIECE)), suspicious(piece_classes or PIECE_CLASSES)), "entropy", len(BASE) + 1)
    return F.concat(whole, pieces)


def uncovered(spans: Column) -> Column:
    """Of spans by start, then order: those that no span of a lower order before them covers; the fixed patterns' all stay."""
    ends = lambda below: running(F.transform(spans, lambda x: F.when(x["o"] < below, x["e"]).otherwise(F.lit(0))), lambda x, y: F.greatest(x, y), F.lit(0))
    n = len(BASE)
    zipped = F.arrays_zip(spans.alias("x"), ends(n).alias("base"), ends(n + 1).alias("whole"))
    stays = lambda z: (z["x"]["o"] < n) | (F.when(z["x"]["o"] == n, z["base"]).otherwise(z["whole"]) < z["x"]["e"])
    return F.transform(F.filter(zipped, stays), lambda z: z["x"])


def _at_least(least: int):
    return lambda x: F.length(x["g"]) >= least


def _spans(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(order).alias("o")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, keep: list[str] | None = None) -> DataFrame:
    """For each row: row (a struct of `id_col` and ``keep``), and base, all: array<struct<k, s, e, o>> by start, then kind.

    ``base`` holds the spans of the fixed patterns, ``all`` those and the entropy scan's (kind "entropy") that
    no base span of the same place already covers.  The allow-list suppresses entropy spans only.  Null and
    empty texts have none; one row comes back for each row, whatever its id.
    """
    text = F.col("text")
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in [id_col, *(keep or [])])).alias("row")
    rows = docs.select(row, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("runs", runs(text))
    by_start = lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["o"] - b["o"])
    found = rows.withColumn("base", F.array_sort(F.concat(*base_matches(text, F.col("runs"))), by_start)).withColumn("more", entropy_matches(F.col("runs"), window))
    merged = F.when(F.size("more") == 0, F.col("base")).otherwise(let(F.array_sort(F.concat("base", "more"), by_start), uncovered))
    return found.select("row", "base", merged.alias("all"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have counts of 0, the hash of the empty string and no spans; repeated rows and null ids
    come back one by one; an empty table gives an empty result.
    """
    found = find_secrets(docs, id_col, text_col)
    n = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col(f"row.`{id_col}`"), *(n(k) for k, *_ in BASE), F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("all")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", id_col: str = "doc_id") -> DataFrame:
    """The rows with every secret replaced by ``mark``; overlapping spans become one mark, null and empty texts stay as they are.

    Repeated rows come back one by one; an empty table gives an empty result; columns may have any names.
    """
    columns = docs.columns
    found = find_secrets(docs, id_col, text_col, keep=[c for c in columns if c != id_col])
    text = F.col(f"row.`{text_col}`")
    reached = running(F.transform("all", lambda x: x["e"]), lambda x, y: F.greatest(x, y), F.lit(0))
    both = F.arrays_zip(F.col("all").alias("x"), reached.alias("at"))
    piece = lambda z: F.when(z["x"]["s"] >= z["at"], F.concat(F.substring(text, z["at"] + 1, z["x"]["s"] - z["at"]), F.lit(mark))).otherwise(F.lit(""))
    end = F.array_max(F.transform("all", lambda x: x["e"]))
    cut = F.concat(F.array_join(F.transform(both, piece), ""), F.substring(text, end + 1, F.length(text)))
    return found.select(*(F.when(F.size("all") > 0, cut).otherwise(text).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns))
