"""Problem 3: cut oversized text into overlapping pieces at natural boundaries.

Every position is joined to its farthest legal successor: the piece that starts there ends at the
last sentence end within the limit, else the last clause mark, else the last space, else the last whole
character; the next piece starts up to `overlap` characters before that end, at a word if there is one.
The cuts of a text are what is reached from position 0; pointer doubling finds them in log2(pieces) vector
steps: the reached set takes in its images, then the successor table is squared.

Cases: null or empty text, or text within the limit, has one piece, itself (null: none). A character with more marks
than fit is the one case in which a cut inside it cannot be avoided. Rows delivered twice count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 600, 60
_SENTENCE = regex.compile(r"""(?:[.!?…]+["'”’»)\]]*(?=\s)|[。！？；]+[”’」』）]*|\n+)\s*""")
_CLAUSE = regex.compile(r"[,;:–—](?=\s)\s*|[，、：]+")
_SPACE = regex.compile(r"\s+")
_CLUSTER = regex.compile(r"\X")


def _last(ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The last of the sorted `ends` in (low, high], or -1."""
    if not len(ends):
        return np.full(len(low), -1, np.int64)
    i = np.searchsorted(ends, high, "right") - 1
    got = np.where(i >= 0, ends[np.maximum(i, 0)], -1)
    return np.where(got > low, got, -1)


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece of `text`, in order."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    whole = np.arange(n + 1) if text.isascii() else np.array([m.end() for m in _CLUSTER.finditer(text)], np.int64)
    fits = np.zeros(n + 1, bool)
    fits[whole] = True
    fits[[0, n]] = True
    kinds = []
    for pattern in (_SENTENCE, _CLAUSE, _SPACE):
        ends = np.array([m.end() for m in pattern.finditer(text)], np.int64)
        kinds.append(ends[fits[ends]] if len(ends) else ends)
    at = np.arange(n + 1, dtype=np.int64)
    low, high = at + overlap + 1, np.minimum(at + limit, n)
    end = np.full(n + 1, -1, np.int64)
    for ends in (*kinds, whole):
        end = np.where(end < 0, _last(ends, low, high), end)
    end = np.where(end < 0, high, end)
    end = np.where(at + limit >= n, n, end)
    # The next start: the first word start, else the first whole character, of the last `overlap` characters.
    words = kinds[2]
    after = np.maximum(end - overlap, 0)
    start = np.full(n + 1, -1, np.int64)
    for starts in (words, np.flatnonzero(fits)):
        if len(starts):
            i = np.minimum(np.searchsorted(starts, after, "left"), len(starts) - 1)
            ok = (start < 0) & (starts[i] >= after) & (starts[i] < end)
            start = np.where(ok, starts[i], start)
    start = np.where(start < 0, np.maximum(end - 1, at + 1), start)
    jump = np.where(end >= n, n, start)
    jump[n] = n
    reached = np.array([0], np.int64)
    while True:
        wider = np.union1d(reached, jump[reached])
        if len(wider) == len(reached):
            break
        reached, jump = wider, jump[jump]
    return [(int(s), int(end[s])) for s in reached if s < n]


def split_texts(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, piece, start, text): pieces of the rows longer than `limit`, numbered from 1."""
    long = chunks.select(F.col("id").alias("chunk_id"), "text").where(F.length("text") > limit).dropDuplicates(["chunk_id"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [
                (i, k, a, text[a:b])
                for i, text in zip(frame["chunk_id"], frame["text"])
                for k, (a, b) in enumerate(cut_points(text, limit, overlap), 1)
            ]
            yield pd.DataFrame(out, columns=["chunk_id", "piece", "start", "text"])

    return long.mapInPandas(cut, "chunk_id long, piece int, start int, text string")


def pieces_of_all(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, piece, start, text) of every row with text: those within the limit are one piece and stay on the JVM."""
    short = chunks.where(F.length("text") <= limit).select(
        F.col("id").alias("chunk_id"), F.lit(1).alias("piece"), F.lit(0).alias("start"), "text"
    ).dropDuplicates(["chunk_id"])
    return short.unionByName(split_texts(chunks, limit, overlap))


def oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id): the rows that come out in several pieces."""
    return split_texts(chunks, limit, overlap).where("piece = 2").select("chunk_id")


def rejoined(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, text, fits): the text of each oversized row put together from its pieces, and whether all pieces and overlaps are within their limits."""
    ordered = F.array_sort(F.collect_list(F.struct("piece", "start", "text")))
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("fits"))

    def step(made, p):
        over = F.length(made["text"]) - p["start"]
        fits = (F.length(p["text"]) <= limit) & ((p["piece"] == 1) | over.between(1, overlap))
        return F.struct(F.concat(made["text"], F.substring(p["text"], over + 1, F.length(p["text"]))).alias("text"), (made["fits"] & fits).alias("fits"))

    return split_texts(chunks, limit, overlap).groupBy("chunk_id").agg(F.aggregate(ordered, start, step).alias("made")).select("chunk_id", "made.text", "made.fits")
