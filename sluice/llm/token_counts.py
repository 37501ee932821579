"""Token counts of whole texts without building token lists (whole-token shortcut).

Offline, every string of the vocabulary is merged by the BPE's own rules; the ones that end as their own
single id are *whole*.  A pre-token that is whole counts 1 by one lookup, and only other pre-tokens are merged.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import ByteBPE, Encoder
from .common import map_texts

_ENCODERS: dict = {}


def vocabulary(df: DataFrame, path: str):
    """The tables of a vocabulary file, read and proved by the driver and broadcast; their size is the file's."""
    return df.sparkSession.sparkContext.broadcast(ByteBPE.from_json(Path(path).read_text(encoding="utf-8")))


def encoder(shared, count: bool = False) -> Encoder:
    """The encoder of this Python worker; it keeps what it has learnt from task to task of the same vocabulary."""
    known = _ENCODERS.get(count)
    if known is None or known.bpe is not shared.value:
        _ENCODERS.clear()
        _ENCODERS[count] = known = Encoder(shared.value, count)
    return known


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows and null ids come back as they are, one
    row each; other columns of ``docs`` play no part.  Strings of special tokens inside a text count as that
    one token, as the library has it by default.  No shuffle; a task holds one Arrow batch and its memory of
    chunks, both bounded.
    """
    shared = vocabulary(docs, vocab_path)

    def make():
        count = encoder(shared, count=True).encode

        def of(texts):
            n = count(texts)[1]
            return {"n_bytes": pc.fill_null(pc.binary_length(texts), 0).cast("int64"), "n_tokens": n, "over_limit": n > limit}

        return of

    return map_texts(docs, id_col, text_col, "n_bytes long, n_tokens long, over_limit boolean", make)
