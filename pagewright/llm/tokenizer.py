"""Encoding of a whole corpus with a public byte-level tokenizer.

The rank file is read from a local path (a parameter) once per Python worker.
Texts longer than ``PIECE`` characters are cut before a lone space between two
visible characters: the pre-splitting pattern always starts a new piece there,
so the ids of the parts joined are the ids of the whole.  Decoding works on raw
bytes, so the round trip is exact for any ids.

Defined cases: null text has null ids, empty text an empty list; all text is
ordinary text (no special tokens); lone surrogates can't occur in a table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import map_columns

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 50_000
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")


@lru_cache(4)
def encoding(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut at safe places, every part but the last at least ``size`` long."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def encode(text: str | None, path: str = RANKS) -> list[int] | None:
    if text is None:
        return None
    enc = encoding(path)
    return enc.encode_ordinary(text) if len(text) <= PIECE else [i for part in pieces(text) for i in enc.encode_ordinary(part)]


def decode(ids: list[int] | None, path: str = RANKS) -> str | None:
    """The text of the ids, from their raw bytes."""
    return None if ids is None else encoding(path).decode_bytes(list(ids)).decode("utf-8", errors="replace")


def with_ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """``(doc_id, ids)`` of every document."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "ids": [encode(t, path) for t in batch["text"]]}

    return map_columns(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], run, "doc_id long, ids array<int>")


def with_sizes(documents: DataFrame, columns: list[str], text_col: str = "text", path: str = RANKS) -> DataFrame:
    """The named columns of every document and its number of tokens (null text: 0)."""
    kept = documents.select(*columns, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text") + ", tokens long"

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {k: v for k, v in batch.items() if k != "_text"} | {"tokens": [len(encode(t, path) or ()) for t in batch["_text"]]}

    return map_columns(kept, kept.columns, run, schema)


def decoded(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """``(doc_id, text)`` back from ``(doc_id, ids)``."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "text": [decode(i, path) for i in batch["ids"]]}

    return map_columns(encoded, ["doc_id", "ids"], run, "doc_id long, text string")
