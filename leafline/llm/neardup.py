"""Problem 4: documents that share most of their three-word sequences.

1. Chunk texts are gathered in blocks of BLOCK ordinals, so no document, however large, is one group; sequences over
   block borders are made from the words before a block, looked up by a window over narrow rows.
2. A document gets the set of its hashed sequences and a fingerprint: the minimum hashes of the set, of which bands are keys and BITS bits each are
   the bits for Hamming distances. Minima of a document of several blocks are folded by position with a built-in aggregate.
3. Equal sets are one class from here on; only the smallest id represents it. Representatives meet in buckets of equal
   fingerprint bands (at the threshold itself 99.99 % meet, well above it all); buckets of more than HOT members are split by salts.
   Unlike documents that meet by chance grow as the square of the documents, so they part in the bucket, before anything is written:
   a meeting is none where more than APART of the SKETCH bits that go with every band differ (of pairs at the threshold one in a million).
4. Documents that met somebody get their pivot table: the Hamming distances of their bits to PIVOTS reference fingerprints. Pairs whose
   tables differ by more than TOLERANCE in any coordinate are discarded unseen; the survivors are verified on their whole sets.

For bits of documents at the threshold a coordinate differs with a standard deviation of sqrt(0.2 * bits); TOLERANCE is 5 of
these. (The triangle bound itself, the radius, would discard nothing at this similarity.)

Cases: null text adds no word; documents below LEAST_WORDS words, or absent from the documents table, take no part; chunk rows delivered
twice count once; ties in ordinal are ordered by id; empty tables give no row.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType

from leafline.session import cut_lineage, release, shared_table

SHARE, LEAST_WORDS, BLOCK = 0.6, 20, 4096
BAND, BANDS, BITS, PIVOTS = 4, 64, 4, 1024
HASHES = BAND * BANDS
TOLERANCE = int(5 * (0.2 * HASHES * BITS) ** 0.5)
# Bits of as many minima, whole longs. At the threshold a fifth of them differ; APART is 5 standard deviations more.
SKETCH = 192
APART = int(0.2 * SKETCH + 5 * (0.16 * SKETCH) ** 0.5)
# Members of a bucket from which it is split.
HOT = 1000
_WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20240229)
    odd = made.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, made.integers(0, 2**63, HASHES, dtype=np.uint64)


@functools.lru_cache(1)
def _references() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2, (PIVOTS, HASHES * BITS), dtype=np.int8).astype(np.float32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sequence(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(_mixed(_mixed(a) * _MIX + b) * _MIX + c)


def _minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minimum hashes (groups x HASHES) of runs of `values`; every run has a member."""
    odd, add = _functions()
    out = np.empty((len(starts), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(((values * odd[k] + add[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _blocks(chunks: DataFrame) -> DataFrame:
    """(document_id, block, text): chunk texts in order, joined by a space."""
    rows = chunks.select("document_id", F.floor(F.coalesce("ordinal", F.lit(0)) / BLOCK).cast("int").alias("block"), "ordinal", "id", "text").where(
        F.col("document_id").isNotNull() & F.col("text").isNotNull()
    )
    ordered = F.array_distinct(F.array_sort(F.collect_list(F.struct("ordinal", "id", "text"))))
    return rows.groupBy("document_id", "block").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


_BLOCK_SCHEMA = "document_id string, block int, words long, head array<long>, tail array<long>, shingles array<long>, bands array<int>, bits binary"
# A filter of this many bits tells which documents' sets are needed; a full one only lets more through.
FILTER_BITS = 1 << 26
FEW = 50_000


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    known: dict[str, int] = {}
    for batch in batches:
        heads, tails, counts, sets, minima = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            words = _WORD.findall(text.lower())
            if len(known) > 1_000_000:
                known.clear()
            for w in {*words}.difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            counts.append(len(h))
            heads.append(h[:2])
            tails.append(h[-2:])
            sets.append(np.unique(_sequence(h[:-2], h[1:-1], h[2:])) if len(h) > 2 else h[:0])
        bands, bits = _prints(_set_minima(sets))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("document_id"),
                batch.column("block"),
                pa.array(counts, pa.int64()),
                *(_lists(np.concatenate(x).view(np.int64), np.array([len(y) for y in x]), pa.int64()) for x in (heads, tails, sets)),
                bands,
                bits,
            ],
            ["document_id", "block", "words", "head", "tail", "shingles", "bands", "bits"],
        )


def _set_minima(sets: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(x) for x in sets])
    minima = np.full((len(sets), HASHES), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(sizes)
    if len(full):
        minima[full] = _minima(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])[full])
    return minima


def _block_minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        minima = _set_minima([np.asarray(x, np.int64).view(np.uint64) for x in batch.column("shingles").to_numpy(zero_copy_only=False)])
        yield _with_minima(batch, ["document_id", "block", "words", "head", "tail"], minima)


def _with_minima(batch: pa.RecordBatch, kept: list[str], minima: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
    # As long integers minima are ordered as they are unsigned.
    columns = [*(batch.column(c) for c in kept), _lists(minima.ravel().astype(np.int64), np.full(len(minima), HASHES), pa.int64()), *more]
    return pa.RecordBatch.from_arrays(columns, [*kept, "minima", *(["seam"] if more else [])])


def _seamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences over the border before each block, and the block's minima with theirs; `carry` holds the two words before it."""
    for batch in batches:
        seams = []
        for carry, head in zip(batch.column("carry").to_numpy(zero_copy_only=False), batch.column("head").to_numpy(zero_copy_only=False)):
            w = np.concatenate([np.asarray(x if x is not None else [], np.int64) for x in (carry, head)]).view(np.uint64)
            n = 0 if carry is None else len(carry)
            at = np.array([i for i in range(len(w) - 2) if i < n < i + 3], np.int64)
            seams.append(np.unique(_sequence(w[at], w[at + 1], w[at + 2])))
        minima = np.asarray(batch.column("minima").flatten()).reshape(-1, HASHES)
        minima = np.minimum(minima, _set_minima(seams).astype(np.int64))
        yield _with_minima(batch, ["document_id", "words"], minima, _lists(np.concatenate(seams).view(np.int64), np.array([len(x) for x in seams]), pa.int64()))


def _folded(seamed: DataFrame) -> DataFrame:
    """(document_id, words, minima): the least of each position over a document's blocks."""
    least = seamed.select("document_id", F.posexplode("minima").alias("at", "m")).groupBy("document_id", "at").agg(F.min("m").alias("m"))
    lists = least.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda x: x["m"]).alias("minima"))
    return seamed.groupBy("document_id").agg(F.sum("words").alias("words")).join(lists, "document_id")


def _prints(minima: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A hash of 32 bits for each band, and the bits of the minima, packed."""
    keys = np.zeros((len(minima), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BAND):
            keys = _mixed(keys * _MIX + minima[:, k::BAND].astype(np.uint64) + np.uint64(1))
    keys = (keys >> np.uint64(32)).astype(np.uint32)
    bits = np.concatenate([(minima >> np.uint32(k)) & np.uint32(1) for k in range(BITS)], 1).astype(np.uint8)
    return _lists(keys.ravel().view(np.int32), np.full(len(minima), BANDS), pa.int32()), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())


def _folded_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        minima = np.asarray(batch.column("minima").flatten()).astype(np.uint32).reshape(-1, HASHES)
        yield pa.RecordBatch.from_arrays([batch.column("document_id"), *_prints(minima)], ["document_id", "bands", "bits"])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pivot tables: Hamming distances of the bits to the reference fingerprints, less half the bits, a byte each (cut off only where they are over 127)."""
    pivots = _references()
    for batch in batches:
        packed = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(len(batch), -1)
        bits = np.unpackbits(packed, axis=1).astype(np.float32)
        far = bits.sum(1)[:, None] + pivots.sum(1)[None, :] - 2 * bits @ pivots.T - bits.shape[1] / 2
        table = np.clip(far, -127, 127).astype(np.int8)
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([x.tobytes() for x in table], pa.binary())], ["rep", "pivots"])


@arrow_udf(BooleanType())
def _within(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether no coordinate of two pivot tables differs by more than TOLERANCE."""
    x, y = (np.frombuffer(b"".join(t.to_pylist()), np.int8).reshape(len(t), -1).astype(np.int16) for t in (a, b))
    return pa.array(np.abs(x - y).max(1) <= TOLERANCE if len(x) else np.zeros(0, bool))


_PARTS = [f"s{i}" for i in range(SKETCH // 64)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first SKETCH bits, each of another minimum, as longs."""
    for batch in batches:
        packed = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(len(batch), -1)
        longs = np.ascontiguousarray(packed[:, : SKETCH // 8]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("bands"), *map(pa.array, longs.T)], ["rep", "bands", *_PARTS])


def _meetings(prints: DataFrame) -> DataFrame:
    """(a, b): representatives with an equal band and no more than APART differing sketch bits. Hot buckets are split: one side by a salt, the other repeated for each."""
    sketched = prints.select("rep", "bands", "bits").mapInArrow(_sketches, "rep long, bands array<int>, " + ", ".join(f"{s} long" for s in _PARTS))
    numbered = lambda df, *more: df.select("rep", *more, F.posexplode("bands").alias("band", "h")).select("rep", *more, (F.col("band").cast("long") * 2**32 + F.col("h")).alias("key"))
    bands = numbered(sketched, *_PARTS)
    counted = numbered(prints).groupBy("key")
    hot = cut_lineage(counted.agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    if hot.isEmpty():
        one, other, on = bands.alias("x"), bands.alias("y"), F.col("x.key") == F.col("y.key")
    else:
        marked = bands.join(hot if hot.limit(FEW + 1).count() > FEW else F.broadcast(hot), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        one = marked.select("rep", *_PARTS, "key", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("salt")).alias("x")
        other = marked.select("rep", *_PARTS, "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).alias("y")
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt"))
    differ = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in _PARTS), F.lit(0))
    return one.join(other, on & (F.col("x.rep") < F.col("y.rep")) & (differ <= APART)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def candidates(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that met in a bucket, and those of them that the pivot tables leave, from (rep, bands, bits)."""
    met = cut_lineage(_meetings(prints))
    release(prints.sparkSession)
    busy = cut_lineage(met.select(F.col("a").alias("rep")).union(met.select("b")).distinct())
    table = prints.select("rep", "bits").where(_bloom(busy, "rep")).mapInArrow(_tables, "rep long, pivots binary")
    near = met.join(table.select(F.col("rep").alias("a"), F.col("pivots").alias("pa")), "a").join(table.select(F.col("rep").alias("b"), F.col("pivots").alias("pb")), "b")
    near = cut_lineage(near.where(_within("pa", "pb")).select("a", "b"))
    del table
    release(prints.sparkSession)
    return met, near


def _only(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by document_id with ids that are broadcast only if they are counted to be few."""
    return df.join(F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids, "document_id", how)


def _bloom(ids: DataFrame, column: str):
    """A filter column for long ids: false only for those that are not in `ids`."""
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    cells = ids.groupBy(F.floor(bit / 64).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    shared = ids.sparkSession.sparkContext.broadcast(table)

    @arrow_udf(BooleanType())
    def within(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False).astype(np.uint64)
        return pa.array(((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool))

    return within(bit)


def class_pairs(chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, share) of class representatives that are similar enough, and membership (doc_id, rep).

    Both by documents.doc_id. A class holds the documents with the same set of sequences.
    """
    owners = documents.select(F.col("id").alias("document_id"), "doc_id").where("document_id is not null and doc_id is not null")
    blocks = shared_table(_blocks(chunks).mapInArrow(_sketched, _BLOCK_SCHEMA), "blocks")
    release(chunks.sparkSession)
    several = cut_lineage(blocks.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1").select("document_id"))
    parts = _only(blocks, several, "left_semi").where("words > 0")
    narrow = parts.select("document_id", "block", "words", "head", "tail", "shingles").mapInArrow(
        _block_minima, "document_id string, block int, words long, head array<long>, tail array<long>, minima array<long>"
    )
    # Every block here has a word, so the two before it hold the two words before it.
    order = Window.partitionBy("document_id").orderBy("block")
    empty = F.array().cast("array<long>")
    carried = F.concat(F.coalesce(F.lag("tail", 2).over(order), empty), F.coalesce(F.lag("tail", 1).over(order), empty))
    before = narrow.select("document_id", "words", "head", "minima", carried.alias("c")).select("document_id", "words", "head", "minima", F.slice("c", F.greatest(F.size("c") - 1, F.lit(1)), 2).alias("carry"))
    seamed = shared_table(before.mapInArrow(_seamed, "document_id string, words long, minima array<long>, seam array<long>"), "seams")
    folded = cut_lineage(_folded(seamed).where(F.col("words") >= LEAST_WORDS))
    single = _only(blocks, several, "left_anti").where(F.col("words") >= LEAST_WORDS)
    set_key = [F.xxhash64("shingles").alias("x"), F.xxhash64(F.lit(1), "shingles").alias("y"), F.size("shingles").alias("z")]
    own_key = [F.xxhash64("document_id").alias("x"), F.xxhash64(F.lit(1), "document_id").alias("y"), F.lit(-1).alias("z")]
    keyed = single.select("document_id", *set_key).unionAll(folded.select("document_id", *own_key)).join(owners, "document_id")
    firsts = keyed.groupBy("x", "y", "z").agg(F.min("doc_id").alias("rep"))
    members = cut_lineage(keyed.join(firsts, ["x", "y", "z"]).select("doc_id", "document_id", "rep"))
    chosen = members.where("doc_id = rep").select("document_id", "rep")
    prints = cut_lineage(
        single.select("document_id", "bands", "bits")
        .unionAll(folded.select("document_id", "minima").mapInArrow(_folded_prints, "document_id string, bands array<int>, bits binary"))
        .join(chosen, "document_id")
        .select("rep", "bands", "bits")
    )
    release(chunks.sparkSession)
    _, near = candidates(prints)
    wanted = chosen.join(near.select(F.col("a").alias("rep")).union(near.select("b")).distinct(), "rep", "left_semi")
    wanted = cut_lineage(wanted)
    sets = single.select("document_id", "shingles").where(_bloom(wanted, "document_id")).join(wanted, "document_id").select("rep", "shingles")
    large = _only(wanted, several, "left_semi")
    pairs = near.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    plain = pairs.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("share"))
    if large.isEmpty():
        return plain.where(F.col("share") >= SHARE), members.select("doc_id", "rep")
    # Pairs with a document of several blocks: their sets are compared row by row, spread over the cluster.
    in_large = large.select("rep").withColumn("large", F.lit(True))
    big = (
        near.join(in_large.toDF("a", "la"), "a", "left").join(in_large.toDF("b", "lb"), "b", "left").where("la or lb").select("a", "b")
    )
    rest = parts.select("document_id", "shingles").unionAll(seamed.select("document_id", F.col("seam").alias("shingles"))).join(large, "document_id").select("rep", "shingles")
    in_big = big.select(F.col("a").alias("rep")).union(big.select("b")).distinct()
    each = rest.unionByName(sets.join(in_big, "rep", "left_semi")).select("rep", F.explode("shingles").alias("s")).distinct()
    sizes = each.groupBy("rep").agg(F.count("*").alias("n"))
    common = (
        big.join(each.select(F.col("rep").alias("a"), "s"), "a").join(each.select(F.col("rep").alias("b"), "s"), ["b", "s"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    )
    spread = (
        common.join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a")
        .join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
        .select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("share"))
    )
    return plain.unionByName(spread).where(F.col("share") >= SHARE), members.select("doc_id", "rep")


def similar_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of similar documents, copies included."""
    pairs, members = class_pairs(chunks, documents)
    a, b = (members.select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("rep").alias(x)) for x in "ab")
    between = pairs.select("a", "b").join(a, "a").join(b, "b").select("doc_id_a", "doc_id_b")
    within = a.join(b, F.col("a") == F.col("b")).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    both = between.unionByName(within)
    return both.select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b")).distinct()


def similar_groups(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, group_id, links): documents joined through similar ones; group_id is the least doc_id.

    links counts the similar documents of each. Groups are found by least labels over class
    representatives with pointer jumping, a lineage cut a round; nothing is gathered.
    """
    found, members = class_pairs(chunks, documents)
    pairs = cut_lineage(found.select("a", "b"))
    edges = pairs.union(pairs.select("b", "a")).toDF("x", "y")
    labels = cut_lineage(members.select(F.col("rep").alias("x")).distinct().withColumn("label", F.col("x")))
    while True:
        low = edges.join(labels.toDF("y", "other"), "y").groupBy("x").agg(F.min("other").alias("low"))
        step = labels.join(low, "x", "left").select("x", F.least("label", "low").alias("new"), "label")
        jumped = step.join(step.select(F.col("x").alias("new"), F.col("new").alias("far")), "new").select("x", F.least("new", "far").alias("new"), "label")
        jumped = cut_lineage(jumped)
        labels = jumped.select("x", F.col("new").alias("label"))
        if jumped.where("new <> label").isEmpty():
            break
    size = members.groupBy("rep").agg(F.count("*").alias("n"))
    reach = edges.join(size.toDF("y", "n"), "y").groupBy("x").agg(F.sum("n").alias("linked"))
    per = labels.join(size.toDF("x", "n"), "x").join(reach, "x", "left").select("x", "label", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"))
    return members.join(per, members["rep"] == per["x"]).select("doc_id", F.col("label").alias("group_id"), "links")
