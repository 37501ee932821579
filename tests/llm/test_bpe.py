"""The encoder against the tokenizers library."""

import random
import time
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")

from sluice.llm.bpe import ByteBPE, Encoder  # noqa: E402
from sluice.llm.queries import vocab_path  # noqa: E402

SOURCE = open(vocab_path(), encoding="utf-8").read()
BPE = ByteBPE.from_json(SOURCE)
LIBRARY = tokenizers.Tokenizer.from_str(SOURCE)
PARTS = ["a", "b", " ", "  ", "\n", "\t", "the", "ing", "'s", "'ll", "é", "ß", "日", "1", "22", "!", "?", "<|endoftext|>", "\xa0", "　", "\x1c", "_", "-", "aaaa", "zzzz", "\r\n", "😀", "՘", "́"]


def same(texts):
    want = [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    ids, sizes = Encoder(BPE).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])][: len(want)] == want
    assert Encoder(BPE, count=True).encode(texts)[1].tolist() == list(map(len, want))
    decoded = [LIBRARY.decode(w, skip_special_tokens=False) for w in want]
    assert [BPE.decode(w) for w in want] == BPE.decode_many(ids, sizes) == decoded


def test_mixed_texts():
    rng = random.Random(1)
    same(["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(3000)])


def test_edges():
    same([None, "", " ", "\n", "\n\n", " \n ", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "a" * 5000, "ab" * 3000, "0" * 4000, " " * 3000 + "x", "-" * 999])


def test_many_special_strings_take_linear_time():
    began = time.perf_counter()
    same(["<|endoftext|> x " * 300_000, "a<|endoftext|><|endoftext|> b" * 1000, "<|endoftext|>" * 100_000])
    assert time.perf_counter() - began < 60  # minutes, if each special string looked at all chunks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    same(texts)


def test_memory_is_bounded_and_forgetting_is_harmless():
    rng = random.Random(2)
    small, large = Encoder(BPE, keep=50, bits=3), Encoder(BPE)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.choice([6, 20]))) for _ in range(30)) for _ in range(40)]
    for t in texts:
        assert [x.tolist() for x in small.encode([t])] == [x.tolist() for x in large.encode([t])]
        assert small.pool.n <= 50 + 40 and small.pool.used <= 8 * 50 + 900 and len(small.long) <= 40


def test_white_space_of_any_width_and_chunks_of_any_length():
    rng = random.Random(4)
    blanks = [" ", "\n", "\t", "\xa0", "\x85", "\u2003", "\u2028", "\u3000", "\u1680", "\x1c", "\u200b"]
    words = ["", "a", "\x00", "a\x00", "a\x00\x00", "abcdefgh", "abcdefghijklmnop", "abcdefghijklmnopq", "é" * 8, "日本語の文章です。", "<|endoftext|>", "it's", "x" * 300]
    same([None, "", *("".join(rng.choice(blanks) * rng.randint(0, 2) + rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(1500))])


def test_whole_tokens_are_proved():
    ids = list(BPE.whole.values())[::977]
    assert all(BPE.merge(BPE.token_bytes[i]) == [i] for i in ids)


def test_pairs_by_merging():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50256, (2, 4000))
    want = [BPE.merge(BPE.token_bytes[x] + BPE.token_bytes[y]) == [x, y] for x, y in zip(a, b)]
    assert BPE.pairs_stable(a, b).tolist() == want
    ids = BPE.merge(b"unbelievably long compound words and such")
    assert BPE.pairs_stable(*np.array(list(pairwise(ids))).T).all()


def test_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        ByteBPE.from_json(open(vocab_path("word_bpe_49k.json"), encoding="utf-8").read())
