"""Whole span lists of the secret scan against a plain version, and planted keys of each class."""

from __future__ import annotations

import random
import re
from collections import Counter
from math import log2

import pytest

pytest.importorskip("sluice.llm")
from sluice.llm import secrets  # noqa: E402

FRAGMENTS = ["example", "EXAMPLE", "your_", "your-", "xxxx", "sample", "0123456789", "abcdefgh", "AKIA", "AKIAAKIA", "token=", "secret: ", "api_key='", 'PassWord" :', "deadbeef" * 3, "a", "é", "😀", " ", "\n", "/", "=", "-", "+", ".", "_"]
FRAGMENTS += ["Qz7pL0vX2mN9bR4tY6wE1uK8", "internationalisationen", "123e4567-e89b-12d3-a456-426614174000", "GB82WEST12345698765432", "docs/guide-2024"]
HEX, UPPER, LOWER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789"
MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def most(s, w=20):
    return max(-sum(n / w * log2(n / w) for n in Counter(s[i : i + w]).values()) for i in range(len(s) - w + 1))


def plain_spans(t):
    """Every span of a text: fixed patterns, then candidates, then pieces; those inside a span of a lower kind go."""
    base = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(secrets.BASE) for m in re.finditer(p, t, re.A) if len(m[g]) >= least]
    found = []
    for order, pattern, classes in ((3, r"[A-Za-z0-9+/_=-]+", secrets.CLASSES), (4, r"[A-Za-z0-9]+", secrets.PIECE_CLASSES)):
        for run in re.finditer(pattern, t):
            places, at = [], run.start()
            for m in [*re.finditer(secrets.WORDS, run[0])] if order == 3 else []:
                places.append((at, run.start() + m.start()))
                at = run.start() + m.end()
            for s, e in [*places, (at, run.end())]:
                x = t[s:e]
                if len(x) >= 20 and not any(re.search(a, x, re.A) for a in secrets.ALLOWED) and any(re.search(p, x) and re.match(needs, x) and most(x) >= least for p, needs, least in classes.values()):
                    found.append((s, order, e))
    spans = sorted(base + found)
    covers = lambda x, y: y[0] <= x[0] and (y[0], y[1]) < (x[0], x[1]) and y[2] >= x[2] and y[1] < min(x[1], 4) and (x[1] == 4 or y[1] < 3)
    return ",".join(f"{secrets.BASE[k][0] if k < 3 else 'entropy'}:{s}:{e}" for s, k, e in spans if k < 3 or not any(covers((s, k, e), y) for y in spans))


def test_span_lists(spark):
    rng = random.Random(21)
    part = lambda: rng.choice(FRAGMENTS) if rng.random() < 0.6 else "".join(rng.choice("ABCDEFabcdef0123456789") for _ in range(rng.randint(1, 30)))
    texts = ["".join(part() for _ in range(rng.randint(1, 25))) for _ in range(600)]
    got = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    wrong = [(t, got[i], plain_spans(t)) for i, t in enumerate(texts) if got[i] != plain_spans(t)]
    assert wrong == [] and sum("entropy" in s for s in got.values()) > 300


def test_planted_keys(spark):
    """Keys of random characters in prose: nearly all of 32 and more are found, in every class and after every name; prose alone gives none."""
    rng = random.Random(22)
    words = "the sensor reports values every quarter hour and /var/log/messages or https://host.org/a-page_of/some-words2024 keep them".split()
    prose = lambda: " ".join(rng.choice(words) for _ in range(40))
    plant, rows = {}, []
    for name, alphabet in (("hex", HEX), ("upper hex", HEX.upper()), ("base32", UPPER), ("base36", LOWER), ("mixed", MIXED)):
        for k in range(200):
            key = "".join(rng.choice(alphabet) for _ in range(32 if name != "hex" else 40))
            before = prose() + " " + rng.choice(["", "sig=", "id-", "/docs/example/"])
            plant[len(rows)] = (name, len(before), len(before) + len(key))
            rows.append((len(rows), before + key + " " + prose()))
    first = len(rows)
    rows += [(first + k, prose()) for k in range(300)]
    got = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = Counter(name for i, (name, s, e) in plant.items() if any(a <= s and e <= b for a, b in got[i]))
    print(dict(found))
    assert all(found[name] >= 194 for name, *_ in plant.values())
    assert all(not got[i] for i in range(first, len(rows)))
