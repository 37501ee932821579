"""Personal data in whole texts: patterns propose, checksums confirm, nearby words adjust a score.

The base kinds (email, ip, card, phone) are reported whatever their score.  The method adds IBANs (mod 97),
and US social security numbers, which have no checksum and so need words nearby that speak for them; words that speak against an IBAN drop it.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: The base kinds in order, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Words within `NEAR` characters that speak for or against a kind, and what they add to its score.
CONTEXT = {
    "email": (re.compile(r"(?i)mail|contact|write|@"), re.compile(r"(?i)noreply|no-reply")),
    "ip": (re.compile(r"(?i)\bip\b|address|host|server|login"), re.compile(r"(?i)version|\bv[0-9]|release|section")),
    "card": (re.compile(r"(?i)card|visa|master|amex|credit|payment"), re.compile(r"(?i)order|serial|invoice|isbn|tracking")),
    "phone": (re.compile(r"(?i)phone|call|tel|mobile|fax|dial"), re.compile(r"(?i)version|score")),
    "iban": (re.compile(r"(?i)iban|account|bank|konto|cuenta|compte"), re.compile(r"(?i)serial|part no")),
    "ssn": (re.compile(r"(?i)\bssn\b|social security|taxpayer"), re.compile(r"(?i)order|serial|part|invoice")),
}
NEAR = 40
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "ssn": 0.3}
ADDED_FROM = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    """The leftmost non-overlapping matches of the address pattern, found from their @ signs in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        if (m := _DOMAIN.match(text, at)) is not None:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str):
    """The leftmost non-overlapping matches of four dotted numbers with all parts at most 255.

    A match starts with a whole run of digits, so it is four runs in a row of a dotted sequence; each sequence is read once.
    """
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        runs, at = m[0].split("."), m.start()
        for k in range(0, len(runs) - 3, 4):
            four = runs[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds' confirmed spans, by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if text.count(".") > 2:
        out += [("ip", s, e) for s, e in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    speaks_for, against = CONTEXT[kind]
    return min(1.0, max(0.0, PRIOR[kind] + 0.3 * bool(speaks_for.search(around)) - 0.3 * bool(against.search(around))))


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """(base spans, all spans with their scores, by kind, then start)."""
    base = base_spans(text)
    more = [("iban", *m.span()) for m in IBAN.finditer(text) if mod97(m[0])] + [("ssn", *m.span()) for m in SSN.finditer(text)]
    scored = [(k, s, e, score(text, k, s, e)) for k, s, e in [*base, *more]]
    return base, [x for x in scored if x[0] in KINDS or x[3] >= ADDED_FROM]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, spans: array<struct<kind, start, end, score>> in code points, end exclusive.

    Base kinds come first in their order, then the added ones, each by start.  Null and empty texts have an
    empty array; repeated rows one row each.  No shuffle, and a task holds one bounded Arrow batch.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def make():
        return lambda texts: {"spans": pa.array([[dict(zip(("kind", "start", "end", "score"), x)) for x in find(t or "")[1]] for t in texts.to_pylist()], kind)}

    return map_texts(docs, id_col, text_col, "spans array<struct<kind:string,start:int,end:int,score:double>>", make)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have counts of 0, the hash of the empty string and no spans; repeated rows and null ids
    come back one by one; an empty table gives an empty result.
    """
    columns = [f"n_{k}" for k in KINDS]

    def make():
        def of(texts):
            out: dict[str, list] = {c: [] for c in [*columns, "base_sha256", "spans"]}
            for t in texts.to_pylist():
                base, every = find(t or "")
                for k in KINDS:
                    out[f"n_{k}"].append(sum(x[0] == k for x in base))
                out["base_sha256"].append(sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
                out["spans"].append(",".join(f"{k}:{s}:{e}" for k, s, e, _ in every))
            return out

        return of

    return map_texts(docs, id_col, text_col, ", ".join(f"{c} long" for c in columns) + ", base_sha256 string, spans string", make)
