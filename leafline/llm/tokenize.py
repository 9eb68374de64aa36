"""Problem 8: token ids of a public byte-level BPE, by a local rank file.

Texts longer than SAFE are cut before single spaces between two other characters; the
pattern never joins across such a place, so the ids are those of the whole text. A stretch of white space or of one kind of
character that defeats the pattern engine is split with the same pattern by another engine.

Cases: null and empty text have the empty list; blank text is encoded as stored.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

FOLDER = os.environ.get("LEAFLINE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-split pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAFE = 100_000
_PLACE = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(4)
def encoding(folder: str = FOLDER, name: str = BYTE_BPE):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = SAFE) -> Iterator[str]:
    """Parts of about `size` characters whose ids, joined, are those of `text`."""
    start = 0
    while len(text) - start > size:
        m = _PLACE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str | None, folder: str = FOLDER, name: str = BYTE_BPE) -> list[int]:
    if not text:
        return []
    enc = encoding(folder, name)
    if len(text) <= SAFE:
        return _encode_part(enc, text)
    return [i for part in safe_parts(text) for i in _encode_part(enc, part)]


def _encode_part(enc, text: str) -> list[int]:
    try:
        return enc.encode_ordinary(text)
    except BaseException as fault:  # the pattern engine ends in a panic on extreme runs
        if isinstance(fault, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        import regex

        return [i for m in regex.finditer(PATTERN, text) for i in enc._encode_single_piece(m[0].encode())]


def decode(ids: list[int] | None, folder: str = FOLDER, name: str = BYTE_BPE) -> str:
    """The text of `ids`, joined as raw bytes before they are read as UTF-8."""
    enc = encoding(folder, name)
    return b"".join(map(enc.decode_single_token_bytes, ids or [])).decode("utf-8", "replace")


def ids_column(text: Column, folder: str = FOLDER, name: str = BYTE_BPE) -> Column:
    @arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([encode(t, folder, name) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def corpus_ids(documents: DataFrame, folder: str = FOLDER, name: str = BYTE_BPE) -> DataFrame:
    """(doc_id, ids) of every document."""
    return documents.select("doc_id", ids_column(F.col("text"), folder, name).alias("ids"))


def corpus_text(ids: DataFrame, folder: str = FOLDER, name: str = BYTE_BPE) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    @arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([decode(x, folder, name) for x in lists.to_pylist()], pa.string())

    return ids.select("doc_id", text("ids").alias("text"))
