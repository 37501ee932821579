"""BPE encoding and decoding of whole texts (speculate and verify, see `bpe`)."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import spelled
from .common import map_texts
from .token_counts import encoder, vocabulary


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row; null and empty texts give an empty array, repeated rows one row each."""
    shared = vocabulary(docs, vocab_path)

    def make():
        run = encoder(shared).encode

        def of(texts):
            ids, sizes = run(texts)
            return {"ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))}

        return of

    return map_texts(docs, id_col, text_col, "ids array<int>", make)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids); null ids give null, bytes that are no UTF-8 become U+FFFD."""
    shared = vocabulary(encoded, vocab_path)

    def make():
        bpe = shared.value
        return lambda lists: {"text": pa.array([None if x is None else bpe.decode(x) for x in lists.to_pylist()], pa.string())}

    return map_texts(encoded, id_col, ids_col, "text string", make)


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 (of the decoded text).

    Null and empty texts have no tokens and the hashes of the empty string.  Ids are decoded through the
    vocabulary's byte table, not taken from the text.  No shuffle; one row for each input row.
    """
    shared = vocabulary(docs, vocab_path)

    def make():
        bpe, run = shared.value, encoder(shared).encode
        digits = [b"%d," % i for i in range(bpe.size)]

        def of(texts):
            ids, sizes = run(texts)
            decimal = [sha256(x[:-1]).hexdigest() for x in spelled(digits, ids, sizes)]
            decoded = [sha256(x.encode()).hexdigest() for x in bpe.decode_many(ids, sizes)]
            return {"n_tokens": sizes, "ids_sha256": pa.array(decimal, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

        return of

    return map_texts(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
