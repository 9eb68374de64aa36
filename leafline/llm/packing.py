"""Problem 9: fill containers of fixed capacity with documents sized in tokens.

Only a histogram of sizes, at most `capacity` counts whatever the corpus, reaches the driver. There the plan is
made: patterns of few documents that fill a container exactly are enumerated, repeat counts are fitted
to the histogram by non-negative least squares and rounded down, and what is left is packed by best fit in
bulk. The plan says, for each size, which ranks of documents of that size go to which containers; every document finds
its rank in a distributed way (its place in its partition plus the partition's offset), so no group is gathered.

Only the list of patterns is bounded (PATTERNS kept of those that the most plentiful sizes make); whatever the patterns leave is packed by
the residual rule, so bounds cost room in containers and never a document.

Cases: null or empty text has no tokens and lies in no container; a text of more than `capacity` tokens is cut
into full pieces and a rest; ties in size are ranked by partition and place; an empty table gives no row.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from leafline.llm.tokenize import BYTE_BPE, FOLDER, encode
from leafline.session import shared_table

CAPACITY = 2048
PATTERNS = 256

Pattern = tuple[int, ...]


def enumerate_patterns(histogram: dict[int, int], capacity: int, most: int = PATTERNS) -> list[Pattern]:
    """Patterns of two to four sizes that fill a container exactly, the most plentiful first."""
    sizes = np.array(sorted(histogram), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    count[sizes] = [histogram[s] for s in sizes]
    found: dict[Pattern, int] = {}
    heavy = sizes[np.argsort(-count[sizes] * sizes, kind="stable")]
    for a in heavy.tolist():
        rest = capacity - a
        if 0 < rest <= capacity and count[rest]:
            p = tuple(sorted((a, rest), reverse=True))
            found[p] = int(min(count[a], count[rest]))
        partners = heavy[:48]
        for b in partners[partners < rest].tolist():
            left = rest - b
            if count[left]:
                p = tuple(sorted((a, b, left), reverse=True))
                found[p] = int(min(count[x] // k for x, k in Counter(p).items()))
            for c in heavy[:6].tolist():
                if 0 < left - c and count[left - c]:
                    p = tuple(sorted((a, b, c, left - c), reverse=True))
                    found[p] = int(min(count[x] // k for x, k in Counter(p).items()))
        if len(found) > 40 * most:
            break
    good = [p for p, n in found.items() if n > 0]
    good.sort(key=lambda p: (-found[p], p))
    return good[:most]


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that nearly minimises |a x - b|, by accelerated projected gradient steps."""
    if not a.shape[1]:
        return np.zeros(0)
    gram, target = a.T @ a, a.T @ b
    rate = 1.0 / max(float(np.abs(gram).sum(axis=1).max()), 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - rate * (gram @ y - target), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def pack_residuals(histogram: Counter[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit in bulk: the largest size is topped up with the largest that fit, as often as that can be repeated."""
    count = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        count[s] = n
    out: list[tuple[Pattern, int]] = []
    for big in range(capacity, 0, -1):
        while count[big] > 0:
            left, part, room = count.copy(), [], capacity
            s = big
            while room > 0 and s > 0:
                s = min(s, room)
                live = np.flatnonzero(left[1 : s + 1])
                if not len(live):
                    break
                s = int(live[-1]) + 1
                k = int(min(room // s, left[s]))
                part += [s] * k
                left[s] -= k
                room -= s * k
                s -= 1
            times = int(min(count[x] // k for x, k in Counter(part).items()))
            for x, k in Counter(part).items():
                count[x] -= k * times
            out.append((tuple(part), times))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """(pattern, times) that use up the histogram exactly."""
    left = Counter({s: n for s, n in histogram.items() if s > 0 and n > 0})
    if not left:
        return []
    assert max(left) <= capacity
    patterns = enumerate_patterns(left, capacity)
    chosen: list[tuple[Pattern, int]] = []
    if patterns:
        sizes = sorted(left)
        row = {s: i for i, s in enumerate(sizes)}
        a = np.zeros((len(sizes), len(patterns)))
        for j, p in enumerate(patterns):
            for s, k in Counter(p).items():
                a[row[s], j] = k
        fit = np.floor(nonnegative_least_squares(a, np.array([left[s] for s in sizes], float))).astype(int)
        for p, times in zip(patterns, fit.tolist()):
            times = min([times, *(left[s] // k for s, k in Counter(p).items())])
            if times > 0:
                chosen.append((p, times))
                for s, k in Counter(p).items():
                    left[s] -= k * times
    return chosen + pack_residuals(+left, capacity)


def _slots(made: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: first rank of each range, its first container, documents of that size a container."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    base = 0
    for p, times in made:
        for s, k in Counter(p).items():
            out[s].append((used[s], base, k))
            used[s] += k * times
        base += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in out.items()}  # type: ignore[misc]


_PIECES = "doc_id long, piece int, start_token long, n_tokens long, part int, place long"


def sized_pieces(documents: DataFrame, capacity: int = CAPACITY, folder: str = FOLDER, name: str = BYTE_BPE) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, part, place): each document with tokens, in pieces of at most `capacity`.

    `place` counts the pieces of one size within the partition `part`. Texts are encoded here and nowhere else: sizes, pieces and
    places leave one function over Arrow batches, so no filter can be pushed below a second call of the tokenizer.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            sizes = np.fromiter((len(encode(t, folder, name)) for t in batch.column("text").to_pylist()), np.int64, len(batch))
            each = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), each)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
            start = at * capacity
            held = np.minimum(capacity, sizes[owner] - start)
            place = np.empty(len(owner), np.int64)
            for i, n in enumerate(held.tolist()):
                place[i] = seen[n]
                seen[n] += 1
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array((at + 1).astype(np.int32)), pa.array(start), pa.array(held), pa.array(np.full(len(owner), part, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start_token", "n_tokens", "part", "place"])

    return documents.select("doc_id", "text").mapInArrow(pieces, _PIECES)


def pack(documents: DataFrame, capacity: int = CAPACITY, folder: str = FOLDER, name: str = BYTE_BPE) -> DataFrame:
    """(container_id, doc_id, piece, start_token, n_tokens)."""
    items = shared_table(sized_pieces(documents, capacity, folder, name), "pieces")  # ranks stay fixed when a task is run again
    counts = items.groupBy("part", "n_tokens").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "n_tokens", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    histogram = {r["n_tokens"]: r["c"] for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    slots = _slots(plan(histogram, capacity))

    @arrow_udf(LongType())
    def container(size: pa.Array, rank: pa.Array) -> pa.Array:
        sizes, ranks = size.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        out = np.zeros(len(sizes), np.int64)
        for s in np.unique(sizes):
            first, base, k = slots[int(s)]
            here = np.flatnonzero(sizes == s)
            i = np.searchsorted(first, ranks[here], "right") - 1
            out[here] = base[i] + (ranks[here] - first[i]) // k[i]
        return pa.array(out)

    ranked = items.join(offsets, ["part", "n_tokens"]).withColumn("rank", F.col("place") + F.col("offset"))
    return ranked.select(container("n_tokens", "rank").alias("container_id"), "doc_id", F.col("piece").cast("long").alias("piece"), "start_token", "n_tokens")


def split_documents(documents: DataFrame, capacity: int = CAPACITY, folder: str = FOLDER, name: str = BYTE_BPE) -> DataFrame:
    """(doc_id): documents that the packing had to lay into several containers, as they exceed one."""
    laid = pack(documents, capacity, folder, name).groupBy("doc_id").agg(F.min("container_id").alias("low"), F.max("container_id").alias("high"))
    return laid.where("low < high").select("doc_id")


def laid_whole(documents: DataFrame, capacity: int = CAPACITY, folder: str = FOLDER, name: str = BYTE_BPE) -> DataFrame:
    """(doc_id, whole, fits): whether the pieces of each document follow each other without a gap from its first token, all but the last of them
    full, and whether none of its containers is overfull."""
    items = pack(documents, capacity, folder, name)
    room = items.groupBy("container_id").agg((F.sum("n_tokens") <= capacity).alias("fits"))
    each = items.join(room, "container_id").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("piece").alias("last"), F.countDistinct("piece").alias("pieces"), F.bool_and(F.col("start_token") == (F.col("piece") - 1) * capacity).alias("placed"),
        F.count_if(F.col("n_tokens") < capacity).alias("short"), F.max(F.when(F.col("n_tokens") < capacity, F.col("piece"))).alias("short_one"), F.bool_and("fits").alias("fits"),
    )
    full = (F.col("short") == 0) | ((F.col("short") == 1) & (F.col("short_one") == F.col("last")))
    return each.select("doc_id", (F.col("placed") & full & (F.col("n") == F.col("last")) & (F.col("pieces") == F.col("n"))).alias("whole"), "fits")
