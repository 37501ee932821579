"""Byte-level BPE over one vocabulary file, as plain Python/numpy objects.

The classes here know nothing of Spark.  The driver reads the vocabulary once,
`ByteBPE.from_json` turns it into tables whose size is fixed by the vocabulary,
and those tables travel to the executors as one broadcast value.

Three ideas make encoding fast and exact:

* Texts are cut at every border between a non-space and a space.  No pre-token
  of the byte-level pattern crosses such a border, so a chunk (``" word,"``) is
  encoded independently of its neighbours and can be remembered.  Cutting and
  looking up work on arrays: a chunk of up to 16 bytes is its own exact key.
* A pre-token that the vocabulary holds *and* that provably encodes to that one
  entry needs no merging (`whole`).
* Other pre-tokens are proposed by greedy longest match; the proposal is the
  true encoding exactly if every adjacent pair of it is stable under merging
  (`pairs_stable`), and only unstable words are merged step by step (`merge`).
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed by the byte-level pre-tokenizer: the white space it knows.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed by the byte-level pre-tokenizer: its pattern.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Code points whose class differs between Unicode versions lie beyond these; there the library itself cuts.
_UNSURE = re.compile("[^\\u0000-\\u0530\\u1e00-\\u1fff\\u2010-\\u205e\\u20a0-\\u20b5\\u2190-\\u21ff\\u3000-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3]")
_NAIVE_UP_TO = 24
_MARK, _LATIN = "\u0100", lambda raw: raw.decode("latin-1")
_MEMORY_BITS = 20
#: Bytes of text that are cut and looked up together.
_TOGETHER = 1 << 22
#: Chunks of so many bytes at most are keys of the table of known chunks; of longer ones those up to `_LONG` bytes are kept in a dict.
_SHORT, _LONG = 16, 256
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in WHITE if c < "\x80"]] = True
_WIDE = np.array([int.from_bytes(c.encode().ljust(3, b"\0"), "big") for c in WHITE if c >= "\x80"], np.uint32)
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[_WIDE >> 16] = True
#: Size of a chunk -> which bits of its 16 bytes count.
_KEEP = np.array([[(1 << 8 * min(k, 8)) - 1, (1 << 8 * max(0, k - 8)) - 1] for k in range(_SHORT + 1)], np.uint64)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Position of a key in an array of distinct keys, for whole arrays of keys at a time; `NONE` where it is absent.

    Keys that share a slot go on to the next, smaller table, until none is left over.
    """

    NONE = np.iinfo(np.int64).max

    def __init__(self, keys: np.ndarray):
        self.levels, at, factor = [], np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(at):
            bits = max(8, int(len(at) * 8).bit_length())
            slot = self._slot(keys[at], factor, bits)
            first = np.unique(slot, return_index=True)[1]
            held, place = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int64)
            held[slot[first]], place[slot[first]] = keys[at[first]], at[first]
            self.levels.append((factor, bits, held, place))
            at, factor = np.delete(at, first), (factor * 0xD1342543DE82EF95 + 2) % 2**64 | 1

    @staticmethod
    def _slot(keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, self.NONE, np.int64)
        for factor, bits, held, place in self.levels:
            slot = self._slot(keys, factor, bits)
            out = np.where(held[slot] == keys, place[slot], out)
        return out


class ByteBPE:
    """Tables of one byte-level BPE vocabulary.  Picklable; bounded by the vocabulary's size."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[int, int, int]], special: dict[str, int]):
        """merges: (left id, right id, merged id) by rank."""
        self.vocab, self.special = vocab, special
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for raw, i in vocab.items():
            self.token_bytes[i] = raw
        for text, i in special.items():
            self.token_bytes[i] = text.encode()
        self.longest = max(map(len, vocab))
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges)}
        # arrays for the pair test: what a token was merged from, and at which rank (-1: a byte)
        self.part = np.full((self.size, 2), -1, np.int64)
        self.made_at = np.full(self.size, -1, np.int64)
        for r, (a, b, c) in enumerate(merges):
            if self.made_at[c] < 0:
                self.part[c], self.made_at[c] = (a, b), r
        self.made = np.array([c for _, _, c in merges] or [0], np.int64)
        self.pair_ranks = PairTable(np.array([a * self.size + b for a, b, _ in merges], np.int64))
        self.token_length = np.fromiter(map(len, self.token_bytes), np.int64, self.size)
        self.automaton = self.verdicts = None  # made where they are first needed
        self.whole: dict[bytes, int] = {}
        self._prove_whole()

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "verdicts": None}

    @classmethod
    def from_json(cls, source: str) -> ByteBPE:
        """From the text of a tokenizer file; refuses what byte-level BPE does not cover."""
        spec = json.loads(source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        added = spec.get("added_tokens") or []
        if not plain or odd or spec.get("normalizer") or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("not a plain byte-level BPE vocabulary")
        of = byte_alphabet()
        raw = lambda s: bytes(of[c] for c in s)
        special = {t["content"]: t["id"] for t in added}
        ids = {s: i for s, i in model["vocab"].items() if s not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls({raw(s): i for s, i in ids.items()}, [(ids[a], ids[b], ids[a + b]) for a, b in merges], special)

    def _prove_whole(self) -> None:
        """Keep the vocabulary strings that merging alone turns into exactly their own id."""
        self.whole = {raw: i for (raw, i), ids in zip(self.vocab.items(), self.merge_many(list(self.vocab))) if ids == [i]}
        if len({(int(a), int(b)) for a, b in self.part if a >= 0}) != len(self.rank) or len(self.whole) != len(self.vocab):
            self.speculative = False  # some token has several makers, so the pair test would not be a proof
        else:
            self.speculative = True

    # -- exact merging ----------------------------------------------------------------
    def merge(self, word: bytes) -> list[int]:
        """The encoding by definition: merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > _NAIVE_UP_TO:
            return self._merge_long(ids)
        rank = self.rank
        while len(ids) > 1:
            best, at, into = None, -1, -1
            for i, pair in enumerate(zip(ids, ids[1:])):
                if (found := rank.get(pair)) and (best is None or found[0] < best):
                    best, at, into = found[0], i, found[1]
            if best is None:
                break
            ids[at : at + 2] = [into]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for words of any length."""
        n, rank = len(ids), self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := rank.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """`merge` for many words; those of one length take each step side by side."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if 2 <= len(w) <= _NAIVE_UP_TO:
                by_length.setdefault(len(w), []).append(k)
            else:
                out[k] = self.merge(w)
        byte_id = np.array(self.byte_id, np.int64)
        for n, at in by_length.items():
            live = np.array(at)
            ids = byte_id[np.frombuffer(b"".join([words[k] for k in at]), np.uint8)].reshape(-1, n)
            column = np.arange(n)
            while len(live):
                pair = np.where(ids[:, 1:] >= 0, ids[:, :-1] * self.size + ids[:, 1:], -2)
                ranks = self.pair_ranks.find(pair)
                j = ranks.argmin(1)
                best = ranks[np.arange(len(live)), j]
                go = best != PairTable.NONE
                for k, row in zip(live[~go].tolist(), ids[~go].tolist()):
                    out[k] = [x for x in row if x >= 0]
                live, ids, j = live[go], ids[go], j[go, None]
                width = max(1, int((ids >= 0).sum(1).max(initial=1)))
                moved = np.concatenate([ids[:, 1:], np.full((len(live), 1), -1)], 1)
                ids = np.where(column[: ids.shape[1]] > j, moved, ids)
                ids[np.arange(len(live)), j[:, 0]] = self.made[best[go]]
                ids = ids[:, :width]
        return out

    # -- speculation ------------------------------------------------------------------
    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match from the left in every word: the tokens of all words, and how many each has.

        One pass of an Aho-Corasick automaton over the joined words; a mark that no token holds ends each.
        """
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for raw, i in self.vocab.items():
                self.automaton.add_word(raw.decode("latin-1"), i)
            self.automaton.add_word(_MARK, -1)
            self.automaton.make_automaton()
        joined = _MARK.join(map(_LATIN, words)) + _MARK
        found = np.fromiter((i for _, i in self.automaton.iter_long(joined)), np.int64)
        ends = np.flatnonzero(found < 0)
        return found[found >= 0], np.diff(ends, prepend=-1) - 1

    def pairs_stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does merging their joined bytes give this very pair again?

        Undo the merges of both tokens from the latest to the earliest.  A merge across the border
        breaks the pair if it comes before the merge that was undone last; of equal ranks the one
        further left comes first.  All pairs are undone side by side.
        """
        a, b = left.astype(np.int64), right.astype(np.int64)
        stable = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            crossing = self.pair_ranks.find(x * self.size + y) < limit[live]
            stable[live[crossing]] = False
            rx, ry = self.made_at[x], self.made_at[y]
            go = ~crossing & ((rx >= 0) | (ry >= 0))
            take_left = go & (rx > ry)
            take_right = go & ~take_left
            l, r = live[take_left], live[take_right]
            limit[l], a[l] = rx[take_left], self.part[x[take_left], 1]
            limit[r], b[r] = ry[take_right] + 1, self.part[y[take_right], 0]
            live = live[go]
        return stable

    def known_stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`pairs_stable` with a direct-mapped memory of verdicts; its size is fixed."""
        if self.verdicts is None:
            self.verdicts = np.full(1 << _MEMORY_BITS, -1, np.int64)
        key = left * self.size + right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MEMORY_BITS)).astype(np.int64)
        held = self.verdicts[slot]
        miss = np.flatnonzero((held >> 1) != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            held[miss] = (new << 1 | self.pairs_stable(new // self.size, new % self.size))[back]
            self.verdicts[slot[miss]] = held[miss]
        return (held & 1).astype(bool)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Speculate and verify for a batch of pre-tokens: the ids of all words, and how many each has."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if self.speculative:
            flat, sizes = self.propose(words)
            owner = np.repeat(np.arange(len(words)), sizes)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            bad = np.zeros(len(words), bool)
            bad[owner[inner[~self.known_stable(flat[inner], flat[inner + 1])]]] = True
            length = np.fromiter(map(len, words), np.int64, len(words))
            bad |= np.bincount(owner, self.token_length[flat], len(words)) != length  # proposals that are no cover
        else:
            flat, sizes, bad = np.empty(0, np.int64), np.zeros(len(words), np.int64), np.ones(len(words), bool)
        failing = np.flatnonzero(bad)
        if len(failing):
            merged = self.merge_many([words[k] for k in failing.tolist()])
            good = ~np.repeat(bad, sizes)
            sizes[failing] = np.fromiter(map(len, merged), np.int64, len(merged))
            out = np.empty(int(sizes.sum()), np.int64)
            fresh = np.repeat(bad, sizes)
            out[~fresh] = flat[good]
            out[fresh] = np.fromiter(chain.from_iterable(merged), np.int64)
            flat = out
        return flat, sizes

    def decode(self, ids) -> str:
        """Ids to text; bytes that are no UTF-8 become U+FFFD, special tokens their string."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_many(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """`decode` for many texts: their ids joined, and how many each has."""
        return [x.decode("utf-8", "replace") for x in spelled(self.token_bytes, ids, sizes)]


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``pool[start[k] : start[k] + size[k]]``, joined."""
    ends = np.cumsum(size)
    return pool[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def spelled(strings: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each of the stretches of ``ids``, ``sizes[k]`` long, what its ids stand for, joined."""
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    size = length[ids]
    joined = gather(np.frombuffer(b"".join(strings), np.uint8), (np.cumsum(length) - length)[ids], size).tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [joined[a:b] for a, b in zip(ends, ends[1:])]


class Pool:
    """Stretches of one growing array, by number."""

    def __init__(self, dtype):
        self.data, self.start, self.size = np.empty(1 << 16, dtype), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = self.n = 0

    def add(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of new stretches: ``data`` joined, and the size of each."""
        while self.used + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        while self.n + len(size) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        at = slice(self.n, self.n + len(size))
        self.data[self.used : self.used + len(data)] = data
        self.start[at], self.size[at] = self.used + np.cumsum(size) - size, size
        self.used, self.n = self.used + len(data), self.n + len(size)
        return np.arange(at.start, at.stop)


class Encoder:
    """Token counts (``count``) or ids of whole columns of texts.

    A column's bytes are cut into chunks and looked up as arrays.  Unknown chunks of some megabytes of text are
    encoded together, so that all their token pairs are verified in one vectorised pass.  What is remembered is
    bounded: a table of two places for each chunk, and at most ``keep`` chunks and eight times as many ids before everything is forgotten.
    """

    def __init__(self, bpe: ByteBPE, count: bool = False, bits: int = 20, keep: int = 1 << 21):
        self.bpe, self.count, self.bits, self.keep = bpe, count, bits, keep
        self.find_pre_tokens = regex.compile(PRE_TOKEN).findall
        self.library = None
        self.specials = sorted((s.encode() for s in bpe.special), key=len, reverse=True)
        self.find_special = re.compile(b"|".join(map(re.escape, self.specials)) or b"(?!)").finditer
        self._forget()

    def _forget(self) -> None:
        #: per place: 16 bytes of a chunk, then its size and its number in the pool
        self.table = np.zeros((2, 1 << self.bits, 3), np.uint64)
        self.long: dict[bytes, int] = {}
        self.pool = Pool(np.int32)
        self.special_at = {s: int(self.pool.add(np.array([self.bpe.special[s.decode()]], np.int32), np.array([1]))[0]) for s in self.specials}

    def pre_tokens(self, chunk: str) -> list[str]:
        if chunk.isascii() or not _UNSURE.search(chunk):
            if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
                return [chunk]
            if chunk[0] == " " and chunk[1:-1].isalpha() and chunk[-1] in ",.;:!?":
                return [chunk[:-1], chunk[-1]]
            return self.find_pre_tokens(chunk)
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenize_str(chunk)]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), joined, and how many each text has; no ids if only counts are wanted."""
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.string()), "")
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data or b"", np.uint8)
        out, at = [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + _TOGETHER, "right")) - 1)
            out.append(self._encode(data[ends[at] : ends[end]], ends[at : end + 1] - ends[at]))
            at = end
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _encode(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.empty(0, np.int32), np.zeros(len(ends) - 1, np.int64)
        if self.pool.n > self.keep or self.pool.used > 8 * self.keep:
            self._forget()
        padded = np.zeros(len(raw) + _SHORT, np.uint8)
        padded[: len(raw)] = raw
        blank = _BLANK[raw]
        wide = np.flatnonzero(_WIDE_LEAD[raw])
        if len(wide):  # white space of two or three bytes
            code = padded[wide].astype(np.uint32) << 16 | padded[wide + 1].astype(np.uint32) << 8
            for length, code in ((2, code), (3, code | padded[wide + 2])):
                blank[(wide[np.isin(code, _WIDE)][:, None] + np.arange(length)).ravel()] = True
        first = np.ones(len(raw), bool)
        np.greater(blank[1:], blank[:-1], out=first[1:])
        first[ends[:-1][ends[:-1] < len(raw)]] = True
        alone = self._find_specials(raw, ends, first)
        pos = np.flatnonzero(first)
        found = self._look_up(padded, pos, np.diff(pos, append=len(raw)), alone)
        size = self.pool.size[found]
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(pos, ends)]
        ids = np.empty(0, np.int32) if self.count else gather(self.pool.data, self.pool.start[found], size)
        return ids, np.diff(upto)

    def _find_specials(self, raw: np.ndarray, ends: np.ndarray, first: np.ndarray) -> dict[int, int]:
        """Place -> number in the pool of special tokens; each becomes a chunk of its own."""
        whole, out = raw.tobytes(), {}
        if any(s in whole for s in self.specials):
            for a, b in zip(ends.tolist(), ends[1:].tolist()):
                for m in self.find_special(whole[a:b]):
                    first[a + m.start() : a + m.end()] = False
                    first[a + m.start()] = True
                    if a + m.end() < b:
                        first[a + m.end()] = True
                    out[a + m.start()] = self.special_at[m[0]]
        return out

    def _look_up(self, padded: np.ndarray, pos: np.ndarray, size: np.ndarray, alone: dict[int, int]) -> np.ndarray:
        """The number in the pool of each chunk."""
        found = np.full(len(pos), -1, np.int64)
        key = np.lib.stride_tricks.sliding_window_view(padded, _SHORT)[pos].view(np.uint64)
        key &= _KEEP[np.minimum(size, _SHORT)]
        length = size.astype(np.uint64)
        h = key[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (key[:, 1] + length) * np.uint64(0xD1342543DE82EF95)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        places = (h >> np.uint64(64 - self.bits)).astype(np.int64), (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        open_ = np.flatnonzero(size <= _SHORT)
        for way in (0, 1):
            row = self.table[way][places[way][open_]]
            hit = (row[:, 0] == key[open_, 0]) & (row[:, 1] == key[open_, 1]) & (row[:, 2] >> np.uint64(32) == length[open_])
            found[open_[hit]] = (row[hit, 2] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            open_ = open_[~hit]
        if alone:
            k = np.searchsorted(pos, np.fromiter(alone, np.int64, len(alone)))
            found[k] = np.fromiter(alone.values(), np.int64, len(alone))
            taken = np.zeros(len(pos), bool)
            taken[k] = True
            open_ = open_[~taken[open_]]
        raw = padded.tobytes()
        if len(open_):
            order = open_[np.lexsort((length[open_], key[open_, 1], key[open_, 0]))]
            new = np.ones(len(order), bool)
            new[1:] = (key[order[1:]] != key[order[:-1]]).any(1) | (length[order[1:]] != length[order[:-1]])
            one = order[new]
            numbers = self._learn([raw[p : p + n] for p, n in zip(pos[one].tolist(), size[one].tolist())])
            found[order] = numbers[np.cumsum(new) - 1]
            value = length[one] << np.uint64(32) | numbers.astype(np.uint64)
            free = self.table[0][places[0][one], 2] == 0
            for way, at in ((0, free), (1, ~free)):
                self.table[way][places[way][one[at]]] = np.column_stack([key[one[at]], value[at]])
        rest = np.flatnonzero(found < 0)
        if len(rest):
            chunks = [raw[p : p + n] for p, n in zip(pos[rest].tolist(), size[rest].tolist())]
            known = self.long
            new = [c for c in dict.fromkeys(chunks) if c not in known]
            fresh = dict(zip(new, self._learn(new).tolist())) if new else {}
            found[rest] = [fresh[c] if c in fresh else known[c] for c in chunks]
            if len(known) > self.keep >> 4:
                known.clear()
            known.update((c, k) for c, k in fresh.items() if len(c) <= _LONG)
        return found

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """Encode new chunks; their numbers in the pool."""
        parts = [self.pre_tokens(c.decode()) for c in chunks]
        words = list(chain.from_iterable(parts))
        place = {w: k for k, w in enumerate(dict.fromkeys(words))}
        raw = [w.encode() for w in place]
        which = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        per = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(per) - per
        if self.count:  # a word proved whole is one token, whichever it is; only the rest is merged
            sizes = np.ones(len(raw), np.int64)
            rest = [k for k, w in enumerate(raw) if w not in self.bpe.whole]
            sizes[rest] = [len(x) for x in self.bpe.merge_many([raw[k] for k in rest])]
            # a stretch of no ids stands for the count
            return self.pool.add(np.empty(0, np.int32), np.add.reduceat(sizes[which], first))
        ids, sizes = self.bpe.encode_words(raw)
        start = np.cumsum(sizes) - sizes
        return self.pool.add(gather(ids, start[which], sizes[which]), np.add.reduceat(sizes[which], first))
