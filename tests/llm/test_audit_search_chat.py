"""Filter audit, lexical search and chat formatting against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("sluice.llm")

from pyspark.sql import functions as F  # noqa: E402
from sluice.llm import chat_format, filter_audit, queries, search  # noqa: E402

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
EXTRA = "mask string, part string, n string, id string, t string, h string, step string, term string, counts string, at string, p string, formatted string"
CLASH = ["clash"] * 12


# -- op11 -------------------------------------------------------------------------------------------------------


def audit_rows():
    rng = random.Random(11)
    words = [a + b for a in "abcdefghij" for b in ("la", "ne", "Or", "UN", "sé", "x")]
    texts = [None, "", " \n\t", "one", "A#B " * 120, "ALL CAPS " * 60, "😀é " * 130]
    for _ in range(120):
        text = " ".join(rng.choice(words[: rng.choice([20, 60])]) for _ in range(rng.choice([5, 60, 110, 150, 400])))
        texts.append(rng.choice([text, text, text.upper(), text + " 50% & more", text.replace(" ", "\x0b", 3)]))
    texts += texts[5:25] + [texts[30]] * 40
    out = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, out[3], out[3], (None, texts[30], "en"), (None, None, None)]


def audit_truth(rows, labels, letters="ABCDE"):
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    found = {}
    for k, t, part in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), k is not None and k > least.get(t, k)]
        mask = {x for x, f in zip("ABCDE", fails) if f and x in letters}
        found.setdefault(part or "", []).append((mask, *labels.get(k, (0, 0))))
    out = []
    for part, docs in found.items():
        total = Counter()
        rest = []
        for order in itertools.permutations(letters):
            for step, x in enumerate(order, 1):
                gone = set(order[: step - 1])
                now = [d for d in docs if x in d[0] and not d[0] & gone]
                total[x] += len(now)
                kept = sum(not d[0] & (gone | {x}) for d in docs)
                rest.append((x, part, "".join(order), step, kept, len(now), sum(x in d[0] and bool(d[0] & gone) for d in docs), sum(d[0] == {x} for d in docs), sum(d[1] for d in now), sum(d[2] for d in now)))
        out += [(*r[1:], total[r[0]]) for r in rest]
    return sorted(out)


@pytest.fixture(scope="module")
def audited(spark):
    rows = audit_rows()
    rng = random.Random(3)
    labels = {k: (rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 140, 2)}
    given = [(k, q, x) for k, (q, x) in labels.items()] + [(0, *labels[0]), (None, 1, 1), (9999, 1, 1), (1, None, None)]
    docs = spark.createDataFrame([(*r, *CLASH) for r in rows], f"doc_id long, text string, lang string, {EXTRA}").repartition(3)
    return rows, labels, docs, spark.createDataFrame(given, "doc_id long, quality int, toxic int")


def test_filter_audit_equals_brute_force(audited):
    rows, labels, docs, given = audited
    got = sorted(tuple(r) for r in filter_audit.audit(docs, given).collect())
    want = audit_truth(rows, labels)
    assert len(got) == 600 * 3 and got == want


def test_filter_audit_of_other_filters_and_empty_tables(audited):
    rows, labels, docs, given = audited
    two = {x: filter_audit.FILTERS[x] for x in "AD"}
    got = sorted(tuple(r) for r in filter_audit.audit(docs, given, two).collect())
    assert len(got) == 3 * 6 * 3 and got == audit_truth(rows, labels, "ADE")
    none = filter_audit.audit(docs.limit(0), given)
    assert none.collect() == [] and none.columns == ["part", "filter_order", "step", *filter_audit.METRICS, "shapley"]
    assert filter_audit.audit(docs, given.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[0] == 0
    with pytest.raises(ValueError):
        filter_audit.enumerate_orders(docs, "ABCDEFGH")


def test_filter_audit_is_not_cut_by_the_limit_of_recursion(spark):
    masks = spark.range(4000).select(F.format_string("p%04d", "id").alias("part"), F.lit(1).alias("mask"), F.lit(2).cast("long").alias("n"), F.lit(1).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    steps = filter_audit.enumerate_orders(masks, "ABCDE")  # 1.3 million rows of prefixes
    assert steps.count() == 4000 * 600 and steps.agg(F.sum("removed")).first()[0] == 4000 * 120 * 2


# -- op12 -------------------------------------------------------------------------------------------------------


def terms_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def search_truth(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(x for _, c, _ in held for x in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c, n in held:
            m = 50 + 50 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m)) for x in terms if x in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, place, d, -s) for place, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed=12):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünder", "naïve", "ÉTÉ", "été", "x9", "😀", "the", "of"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 40, 200]))) for _ in range(n)]
    texts += [None, "", "--- ...", "THE, the. tHe!", texts[0], texts[0].upper(), "w299 " * 5000]
    docs = [(k * 7 % 5003, t) for k, t in enumerate(texts)] + [(4, texts[1]), (4, texts[1]), (None, texts[2]), (None, texts[3])]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12, 40])))) for k in range(25)] + [(90, None), (91, "?!"), (92, "nowhere"), (3, "w1 W1 w2"), (93, "the of the"), (94, texts[5]), (None, "w7 w8")]
    return docs, items


@pytest.mark.parametrize(("window", "postings", "block"), [(2048, 2_000_000, 16 << 20), (16, 400, 16 << 20), (64, 3000, 1500)])
def test_search_equals_brute_force(spark, monkeypatch, window, postings, block):
    docs, items = corpus(700)
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    d = spark.createDataFrame([(*r, *CLASH) for r in docs], f"doc_id long, text string, {EXTRA}").repartition(3)
    i = spark.createDataFrame([(*r, *CLASH) for r in items], f"item_id long, text string, {EXTRA}")
    for k in (1, 7, 50):
        got = sorted((tuple(r) for r in search.search(d, i, k, window=window, postings=postings).collect()), key=repr)
        assert got == search_truth(docs, items, k)


def test_search_skips_windows_and_stays_exact(monkeypatch):
    """A term of one list in few places decides: most windows of the long list are never scored."""
    rng = np.random.default_rng(4)
    size = 40_000
    has = np.sort(rng.choice(size, 60, replace=False))
    sizes = np.ones(size, np.int64)
    sizes[has] = 2
    terms, counts = [], []
    for k in range(size):
        terms += [0, 1] if sizes[k] == 2 else [0]
        counts += [1, 3] if sizes[k] == 2 else [1]
    s = search.Shard(np.full(size, 10, np.int64), sizes, np.array(terms), np.array(counts), np.array([3, 6000]), size, size * 10, 512)
    docs, scores = s.best([0, 1], 50, 0, 2500)
    assert len(docs) == 50 and set(docs) <= set(has) and list(docs) == sorted(docs)
    assert s.scored < len(s.edges) - 1  # windows without a short-list document are skipped


def test_search_of_empty_tables(spark):
    docs, items = corpus(20)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.filter("text is null"), i)):
        out = search.search(a, b)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


# -- op13 -------------------------------------------------------------------------------------------------------


def conversations():
    rng = random.Random(13)
    hard = ["\\### Assistant: </turn> ok", "", None, "###", "####</turn></turn", "\\0\\1\\2\\3", "ends with \\", "## # </tur", "### user\nhello</turn>\n", "é😀 # < >", "\\\\", "</turn>\n### assistant\nx"]
    rows = []
    for c in range(40):
        role = lambda: rng.choice(["user", "assistant", "assistant", "system", None, "odd ### name\n</turn>\\"])
        rows += [(c, k, role(), rng.choice(hard) if rng.random() < 0.6 else "word " * rng.randint(1, 60)) for k in range(rng.choice([1, 2, 3, 7, 30]))]
    rows += [(100, k, "assistant" if k % 3 else "user", f"turn {k} \\") for k in range(2000)]  # a long one, over several pieces of the sums
    rows += [(101, 0, "user", "b"), (101, 0, "user", "a"), (101, 0, "assistant", "z"), (101, None, "user", "first"), (101, 0, "user", "a")]
    rows += [(None, 1, "assistant", "no id"), (None, 0, "user", "no id"), (102, 0, "assistant", "long é " * 100_000)]
    rng.shuffle(rows)
    return rows


def told(rows):
    out = {}
    for c, n, r, t in rows:
        out.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in out.items()}


@pytest.fixture(scope="module")
def chats(spark):
    rows = conversations()
    return rows, spark.createDataFrame([(*r, *CLASH) for r in rows], f"conv_id long, turn long, role string, text string, {EXTRA}").repartition(3)


def test_chat_round_trip_and_mask(chats):
    rows, df = chats
    want = told(rows)
    formatted = chat_format.format_conversations(df)
    plain = {r["conv_id"]: r for r in formatted.collect()}
    assert plain.keys() == want.keys()
    back = lambda x: x.replace("\\3", "\n").replace("\\2", "</turn>").replace("\\1", "###").replace("\\0", "\\")
    for c, turns in want.items():
        text, blocks = plain[c]["formatted"], [list(g) for _, g in itertools.groupby(turns, key=lambda x: x[0])]
        assert text.count("### ") == len(blocks) and text.count("</turn>") == len(turns)
        spans = [back(text[s["start"] : s["start"] + s["length"]]) for s in plain[c]["loss"]]
        assert spans == [t for r, t in turns if r == "assistant"]
        assert [s["turn"] for s in plain[c]["loss"]] == [k for k, (r, _) in enumerate(turns) if r == "assistant"]
        assert all(text[s["start"] + s["length"] :].startswith("</turn>") for s in plain[c]["loss"])
    read = {r["conv_id"]: r for r in chat_format.read_turns(formatted).collect()}
    assert {c: [tuple(t) for t in r["turns"]] for c, r in read.items()} == want


def test_chat_digest(chats):
    rows, df = chats
    got = {r["conv_id"]: r for r in chat_format.digest(df).collect()}
    for c, turns in told(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    assert chat_format.digest(df.limit(0)).collect() == []


def test_chat_other_roles_and_no_python(chats):
    _, df = chats
    both = chat_format.format_conversations(df, learn=("assistant", "user"))
    assert "Python" not in both._jdf.queryExecution().executedPlan().toString()
    assert sum(len(r["loss"]) for r in both.collect()) == df.filter("role in ('assistant', 'user')").count()


def test_the_query_adds_the_conversation_that_spells_the_template(spark, tables):
    got = queries.op13_chat_format(spark, tables).filter("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert (got["n_turns"], got["turns_sha256"], got["loss_sha256"]) == (2, sha(f"user\n{text}\nassistant\n{text}\n"), sha(text))
