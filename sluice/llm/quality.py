"""Quality rules: base counts, and divergence of a document's histograms from those of its possible languages.

Pass 1 reads every text once and keeps its counts and two small histograms: character classes, and common
words of the supported languages (all other words share one bin).  Their sums over all documents that pass the
base rules are the languages' references.  Pass 2 compares each document with every reference by Jensen-Shannon
distance and takes the nearest, so that a wrong or missing language label costs nothing.

The distance of common words is mostly noise in short texts and falls as 1 / sqrt(words), so its limit does too,
between a floor and a ceiling.  Texts in two languages lie far from either; beyond the limit the nearest mix of two
references counts.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, give_back, pieces

#: The commonest function words of each supported language (general knowledge, a parameter of the operator).
COMMON = {
    "en": "the of and to in a is that it for was on are as with be at by this have from or had not but".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus ne avec se ce sont".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le".split(),
}
#: The classes of characters, by UTF-8 lead byte; continuation bytes stand for no character.
CLASSES = ["lower", "upper", "digit", "blank", "line end", "sentence mark", "other mark", "control", "two bytes", "three bytes", "four bytes"]
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"


def _class_of() -> np.ndarray:
    """Byte -> its class; `len(CLASSES)` where it counts for nothing."""
    of = np.full(256, 7)
    for b in range(33, 127):
        of[b] = 6
    of[list(b".,;:!?'\"-()")] = 5
    of[ord("a") : ord("z") + 1], of[ord("A") : ord("Z") + 1], of[ord("0") : ord("9") + 1] = 0, 1, 2
    of[[32, 9]], of[10] = 3, 4
    of[128:192], of[192:224], of[224:240], of[240:] = len(CLASSES), 8, 9, 10
    return of


def words_of(raw: bytes) -> list[bytes]:
    """Runs without ASCII white space; bytes.split() knows exactly those six characters."""
    return raw.split()


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more, first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    n, covered, to = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered += i + 3 - max(i, to)
            to = i + 3
    return covered


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


class Counts:
    """Base counts and histograms of texts."""

    def __init__(self, common: dict[str, list[str]]):
        self.class_of = _class_of()
        self.bins = {w.encode(): i for i, w in enumerate(sorted({w for words in common.values() for w in words}))}
        upper, marks = bytes(range(65, 91)), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
        self.fold = bytes.maketrans(upper + marks, upper.lower() + b" " * len(marks))

    def __call__(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words, size = words_of(raw), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        chars = int(size[:128].sum() + size[192:].sum() - size[list(_SPACE)].sum())
        base = [len(words), chars, int(size[list(SYMBOLS)].sum()), repeated_lines(raw), repeated_words(words)]
        classes = np.bincount(self.class_of, size, len(CLASSES) + 1)[:-1].astype(np.int32)
        found = raw.translate(self.fold).split()
        n, common = Counter(found), np.zeros(len(self.bins) + 1, np.int32)
        for w, i in self.bins.items():
            common[i] = n.get(w, 0)
        common[-1] = len(found) - common[:-1].sum()
        return base, classes, common


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance in [0, 1] of each row of counts p from the counts q; 0 for rows without counts."""
    total = p.sum(1, keepdims=True)
    p, q = p / np.maximum(total, 1), q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0.0).sum(1)
        d = (kl(p) + kl(np.broadcast_to(q, p.shape))) / 2
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(d, 0)), 0.0)


class Rules:
    """The verdict on base counts and histograms, given the languages' references."""

    def __init__(self, references: list[tuple[np.ndarray, np.ndarray]], limits: dict[str, float]):
        self.references, self.limits = references, limits
        shares = [(r[1] / max(r[1].sum(), 1)) for r in references]
        self.mixes = [(k * a + (8 - k) * b) / 8 for a, b in combinations(shares, 2) for k in range(1, 8)]

    def __call__(self, n_words: np.ndarray, chars: np.ndarray, repeats: np.ndarray, classes: np.ndarray, words: np.ndarray):
        """(base_failed, class distance, word distance, kept) of each row."""
        far = [np.min([js_distance(x, r[k]) for r in self.references], 0) if self.references and len(x) else np.zeros(len(x)) for k, x in enumerate((classes, words))]
        failed = (n_words < 50) | (100 * repeats > 50 * n_words)
        limit = np.clip(self.limits["noise"] / np.sqrt(np.maximum(n_words, 1)), self.limits["least"], self.limits["common"])
        if self.mixes and (at := np.flatnonzero(far[1] > limit)).size:
            far[1][at] = np.min([far[1][at], *(js_distance(words[at], m) for m in self.mixes)], 0)
        odd = (far[0] > self.limits["classes"]) & (chars >= self.limits["chars"]) | (far[1] > limit)
        return failed, *far, ~failed & ~odd


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def count_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, common: dict[str, list[str]]) -> DataFrame:
    """(id, lang, base counts, classes, words) of each row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    ints = pa.list_(pa.int32())

    def count(batches):
        of = Counts(common)
        for b in pieces(batches):
            rows = [of(t) for t in b.column(2).to_pylist()]
            base = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *base, pa.array([r[1] for r in rows], ints), pa.array([r[2] for r in rows], ints)], ["id", "lang", *NAMES, "classes", "words"])

    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), lang.alias("lang"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(count, f"id {id_type}, lang string, " + ", ".join(f"{n} long" for n in NAMES) + ", classes array<int>, words array<int>")


def references(counted: DataFrame, common: dict[str, list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The summed histograms of each supported language: at most one row per language reaches the driver.

    Exact integer sums over all documents that pass the base rules.
    """
    n_classes, n_bins = len(CLASSES), len({w for words in common.values() for w in words}) + 1
    sums = [F.sum(F.get("classes", F.lit(i)).cast("long")).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.get("words", F.lit(i)).cast("long")).alias(f"w{i}") for i in range(n_bins)]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = counted.filter(~failed & F.col("lang").isin(*common)).groupBy("lang").agg(*sums).collect()
    return [(np.array(r[1 : 1 + n_classes], float), np.array(r[1 + n_classes :], float)) for r in sorted(found)]


def _limits(max_class_distance: float, max_word_distance: float, least_word_distance: float, word_noise: float, min_chars: int) -> dict[str, float]:
    return {"classes": max_class_distance, "common": max_word_distance, "least": least_word_distance, "noise": word_noise, "chars": min_chars}


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common: dict[str, list[str]] | None = None,
    max_class_distance: float = 0.30,
    max_word_distance: float = 0.35,
    least_word_distance: float = 0.24,
    word_noise: float = 3.6,
    min_chars: int = 300,
) -> DataFrame:
    """For each row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    ``base_failed``: fewer than 50 words, or over half of them in repeated three-word windows.  Otherwise a
    document is rejected if its character classes lie further than ``max_class_distance`` from every
    language's reference (and it has ``min_chars`` characters), or its common words further than
    ``word_noise`` / sqrt(n_words), but no less than ``least_word_distance`` and no more than ``max_word_distance``,
    from every reference and every mix of two in eighths.  Null texts count as empty and fail the base rules;
    null or unknown languages add to no reference.  Without any reference (an empty table, no known language)
    nothing is rejected beyond the base rules.  Repeated rows come back one by one.
    """
    common = common or COMMON
    id_type = docs.schema[id_col].dataType.simpleString()
    counted = checkpoint(count_texts(docs, id_col, text_col, lang_col, common))
    rules = docs.sparkSession.sparkContext.broadcast(Rules(references(counted, common), _limits(max_class_distance, max_word_distance, least_word_distance, word_noise, min_chars)))

    def compare(batches):
        for b in pieces(batches):
            classes, words = (np.array(b.column(k).to_pylist(), float).reshape(b.num_rows, -1) for k in (6, 7))
            n_words, chars, repeats = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 5))
            verdict = [pa.array(x) for x in rules.value(n_words, chars, repeats, classes, words)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(6)), *verdict], [id_col, *NAMES, "base_failed", "class_distance", "word_distance", "kept"])

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{n} long" for n in NAMES) + ", base_failed boolean, class_distance double, word_distance double, kept boolean"
    return counted.drop("lang").mapInArrow(compare, schema)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """The rows that `judge` keeps, with all their columns.  Texts are counted twice; nothing is shuffled but the references.

    Null and empty texts fail the base rules and go; repeated rows are judged one by one; an empty table gives an empty result.
    """
    limits = {"max_class_distance": 0.30, "max_word_distance": 0.35, "least_word_distance": 0.24, "word_noise": 3.6, "min_chars": 300} | limits
    counted = count_texts(docs, text_col, text_col, lang_col, COMMON).drop("id")
    rules = docs.sparkSession.sparkContext.broadcast(Rules(references(counted, COMMON), _limits(**limits)))
    at = docs.columns.index(text_col)

    def keep(batches):
        of = Counts(COMMON)
        for b in pieces(batches):
            if not b.num_rows:
                continue
            base, classes, words = zip(*map(of, b.column(at).to_pylist()))
            base = np.array(base)
            yield b.filter(pa.array(rules.value(base[:, 0], base[:, 1], base[:, 4], np.array(classes, float), np.array(words, float))[3]))
        give_back()

    return docs.mapInArrow(keep, docs.schema)
