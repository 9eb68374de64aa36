"""Problem 2: the most similar vectors of every vector, by a robust-pruned directed graph in each shard.

Vectors of one model and dim are dealt to shards by the nearest of a set of centres, fitted on a bounded
sample; in each shard a graph is built (a scan of the shard proposes neighbours, relaxed distance pruning keeps
diverse edges) and beam searches answer the queries that were sent there; what the shard's own vectors ask, the scan has answered.
In the self-join every vector asks the ROUTES nearest shards and all whose centres are less than GAP farther (in cosine) than the nearest,
and what one finds of the other holds for both; in a search for the stated query set the queries ask all shards.
Shards above LARGEST are salted into sub-shards, each of which is asked. The candidates' cosines are computed from the
vectors, so no value is wrong; but where a neighbour is missed, the next one takes its place, which is a row too many among the k.

Equal vectors are one node that carries the k + 1 least chunk ids, enough for any top k; so a
group of copies, whatever its size, is no load on a shard. Ties in similarity go to the smaller chunk id.

Cases: only the row with the latest updated_at of a chunk counts; null, all-zero, infinite or NaN vectors and
those whose length is not dim take no part, nor do rows with a null model or dim; equal rows count once; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.session import cut_lineage, release, shared_table

K = 5
DEGREE, BUILD_BEAM, BEAM, WIDE_BEAM, ALPHA = 20, 28, 18, 80, 1.1
ROUTES, SHARD, LARGEST = 2, 3000, 20_000
GAP = 0.05
MOST_CENTRES, SAMPLE = 4096, 60_000
BATCH, BACK = 1024, 8


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities (queries x beam, best first; -1 where fewer were found) from `entry` (queries x some)."""
    m, n = len(q), len(x)
    ids = np.full((m, beam), -1, np.int32)
    sims = np.full((m, beam), -2.0, np.float32)
    first = entry.shape[1]
    start = np.einsum("bnd,bd->bn", x[entry], q)
    if first > beam:
        keep = np.argpartition(-start, beam - 1, axis=1)[:, :beam]
        entry, start, first = np.take_along_axis(entry, keep, 1), np.take_along_axis(start, keep, 1), beam
    ids[:, :first], sims[:, :first] = entry, start
    seen = np.zeros((m, n), bool)
    np.put_along_axis(seen, entry, True, 1)
    fresh = ids >= 0
    live = np.arange(m)
    while len(live):
        score = np.where(fresh[live], sims[live], -3)
        best = score.argmax(1)
        going = score[np.arange(len(live)), best] > -2
        live, best = live[going], best[going]
        if not len(live):
            break
        fresh[live, best] = False
        near = graph[ids[live, best]]
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        got = np.where(new, np.matmul(x[near], q[live][:, :, None])[:, :, 0], -2)
        improving = got.max(1) > sims[live].min(1)
        if improving.any():
            rows = live[improving]
            s = np.concatenate([sims[rows], got[improving]], 1)
            i = np.concatenate([ids[rows], near[improving]], 1)
            f = np.concatenate([fresh[rows], new[improving]], 1)
            top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
            each = np.arange(len(rows))[:, None]
            sims[rows], ids[rows], fresh[rows] = s[each, top], i[each, top], f[each, top]
    ids[sims <= -2] = -1
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node of `own`, up to `degree` of its candidates (-1: none), the next kept one the closest not yet covered."""
    c = np.where((cand == own[:, None]) | (cand < 0), own[:, None], cand)
    v = x[c]
    sim = np.matmul(v, x[own][:, :, None])[:, :, 0]
    sim[c == own[:, None]] = -4
    order = np.argsort(-sim, axis=1, kind="stable")
    rows = np.arange(len(own))
    each = rows[:, None]
    c, sim, v = c[each, order], sim[each, order], v[each, order]  # whole vectors are moved, not elements
    alive = sim > -3
    alive[:, 1:] &= c[:, 1:] != c[:, :-1]
    between, mine = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1)), 2 - 2 * sim
    out = np.repeat(own[:, None], degree, 1).astype(np.int32)  # an edge to itself stands for none
    for k in range(degree):
        pick = alive.argmax(1)
        on = alive[rows, pick]
        if not on.any():
            break
        out[on, k] = c[rows[on], pick[on]]
        alive &= ~(on[:, None] & (alpha * between[rows, pick] <= mine))
        alive[rows, pick] = False
    return out


def scan(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities (n x count, or n - 1 if fewer, best first) of the most similar others of each."""
    n = len(x)
    count = min(count, n - 1)
    ids, sims = np.zeros((n, count), np.int32), np.zeros((n, count), np.float32)
    for at in range(0, n, BATCH):
        s = x[at : at + BATCH] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -4
        near = np.argpartition(-s, count - 1, axis=1)[:, :count] if count else np.zeros((len(s), 0), np.int64)
        s = np.take_along_axis(s, near, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        ids[at : at + BATCH], sims[at : at + BATCH] = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
    return ids, sims


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1, near: np.ndarray | None = None) -> np.ndarray:
    """Out-edges (n x degree): robust pruning of the `beam` most similar (`near`, if they are known) and pruned reverse edges over a random graph."""
    n = len(x)
    if n <= degree + 1:
        return np.array([[(i + j) % n for j in range(1, degree + 1)] for i in range(n)], np.int32)
    made = np.random.default_rng(seed)
    graph = made.integers(0, n, (n, degree), dtype=np.int32)
    near = scan(x, beam)[0] if near is None else near
    order = made.permutation(n)
    for at in range(0, n, BATCH):
        own = order[at : at + BATCH]
        graph[own] = robust_prune(x, own, np.concatenate([near[own], graph[own]], 1), degree, alpha)
        # Reverse edges: every target takes the nodes that chose it, BACK at a time, and is pruned again with each lot; none is left out.
        source, target = np.repeat(own, degree), graph[own].ravel()
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, begin = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(begin, np.diff(np.append(begin, len(target))))
        many = np.diff(np.append(begin, len(target)))
        for first in range(0, int(many.max()), BACK):
            lot = np.flatnonzero(many > first)
            back = np.full((len(nodes), BACK), -1, np.int32)
            fits = (place >= first) & (place < first + BACK)
            back[np.searchsorted(nodes, target[fits]), place[fits] - first] = source[fits]
            for b in range(0, len(lot), BATCH):
                some = lot[b : b + BATCH]
                graph[nodes[some]] = robust_prune(x, nodes[some], np.concatenate([graph[nodes[some]], back[some]], 1), degree, alpha)
    return graph


def entries(n: int, m: int, count: int = 6) -> np.ndarray:
    """The same spread of entry nodes for each of m queries."""
    return np.repeat(np.unique(np.linspace(0, n - 1, min(n, count)).astype(np.int32))[None, :], m, 0)


def spherical_centres(x: np.ndarray, count: int, rounds: int = 4, seed: int = 3) -> np.ndarray:
    made = np.random.default_rng(seed)
    centres = x[made.choice(len(x), count, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1e-30)[:, None], centres).astype(np.float32)
    return centres


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(model, dim, chunk_id, vector): the current vector of each chunk, if it can be used."""
    newest = embeddings.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct("model", "dim", "vector"), F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp"))).alias("v"))
    v = newest.select("v.model", "v.dim", "chunk_id", "v.vector")
    finite = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return v.where(F.col("model").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") == F.col("dim")) & finite & F.exists("vector", lambda e: e != 0))


FEW = 50_000


def _nodes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, model, dim, vector), the copies (node, chunk_id) of nodes that have any, and (node, ids): their k + 1 least chunk ids.

    Vectors are shuffled once, for the current row; copies are found by narrow hashes, and what is no node is left out by its id.
    """
    key = ["model", "dim", "h", "h2"]
    hashed = shared_table(vectors.select("model", "dim", "chunk_id", "vector", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("h2")), "vectors")
    narrow = hashed.select(*key, "chunk_id")
    twins = cut_lineage(narrow.groupBy(key).agg(F.min("chunk_id").alias("node"), F.count("*").alias("n")).where("n > 1").drop("n"))
    members = narrow.join(_small(twins), key).select("node", "chunk_id")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("chunk_id"))
    least = members.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids"))
    rest = cut_lineage(members.where("chunk_id <> node").select("chunk_id"))
    nodes = hashed.join(_small(rest), "chunk_id", "left_anti")
    return nodes.select(F.col("chunk_id").alias("node"), "model", "dim", "vector"), members, least


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if counted to be few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(lists.flatten(), np.float64).reshape(-1, dim)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _centres(nodes: DataFrame) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """By (model, dim): centres and the number of sub-shards of each, from a sample of at most about SAMPLE vectors."""
    sizes = {(r["model"], r["dim"]): r["n"] for r in nodes.groupBy("model", "dim").agg(F.count("*").alias("n")).collect()}
    every = sum(sizes.values())
    share = min(1.0, SAMPLE / max(every, 1))
    draw = F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = nodes.where(draw | F.lit(share >= 1)).select("model", "dim", "vector").toArrow()
    out = {}
    for (model, dim), n in sizes.items():
        here = sample.filter(pa.compute.and_(pa.compute.equal(sample["model"], model), pa.compute.equal(sample["dim"], dim)))
        count = int(np.clip(n // SHARD, 1, min(MOST_CENTRES, max(1, len(here) // 8))))
        x = _unit(here["vector"].combine_chunks(), dim) if len(here) else np.zeros((1, dim), np.float32)
        centres = spherical_centres(x, count) if len(here) else x
        held = np.bincount((x @ centres.T).argmax(1), minlength=count) / len(x) * n
        out[model, dim] = centres, np.maximum(1, np.ceil(held / LARGEST)).astype(np.int64)
    return out


_DEALT = "model string, dim int, shard int, sub long, own boolean, ask boolean, node long, vector array<float>"


def _dealer(centres, routes: int | None):
    """Deals nodes to their shard, and as questions to the `routes` nearest shards and those within GAP (None: to all, where `asked`)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for (model, dim), (c, subs) in centres.value.items():
                here = table.filter(pa.compute.and_(pa.compute.equal(table["model"], model), pa.compute.equal(table["dim"], dim)))
                if not len(here):
                    continue
                x = _unit(here["vector"].combine_chunks(), dim)
                node = here["node"].to_numpy()
                asked = np.asarray(here["asked"])
                sims = x @ c.T
                home = sims.argmax(1)
                if routes is None or routes >= len(c):
                    near = np.ones(sims.shape, bool)
                else:
                    near = sims > sims.max(1, keepdims=True) - GAP
                    np.put_along_axis(near, np.argpartition(-sims, routes - 1, axis=1)[:, :routes], True, 1)
                near &= asked[:, None]
                near[np.arange(len(x)), home] = True
                at, shard = np.nonzero(near)
                wide = subs[shard]
                at, shard = np.repeat(at, wide), np.repeat(shard, wide)
                sub = np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
                own = (shard == home[at]) & (sub == (node[at] * 2654435761 >> 7) % subs[shard])
                keep = own | asked[at]
                at, shard, sub, own = at[keep], shard[keep], sub[keep], own[keep]
                for b in range(0, len(at), 20_000):
                    i = slice(b, b + 20_000)
                    offsets = pa.array(np.arange(len(at[i]) + 1, dtype=np.int32) * dim)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([model] * len(at[i]), pa.string()), pa.array(np.full(len(at[i]), dim, np.int32)), pa.array(shard[i].astype(np.int32)), pa.array(sub[i]),
                            pa.array(own[i]), pa.array(asked[at[i]]), pa.array(node[at[i]]), pa.ListArray.from_arrays(offsets, pa.array(x[at[i]].ravel())),
                        ],
                        ["model", "dim", "shard", "sub", "own", "ask", "node", "vector"],
                    )

    return deal


def _asker(k: int, beam: int, at_least: float):
    def ask(table: pa.Table) -> pa.Table:
        own = np.asarray(table["own"])
        asks = np.asarray(table["ask"])
        node = table["node"].to_numpy()
        vectors = table["vector"].combine_chunks()
        v = np.asarray(vectors.flatten()).reshape(len(node), -1)
        x, names = v[own], node[own]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(x):
            n = len(x)
            close, alike = scan(x, max(BUILD_BEAM, k))
            position = np.cumsum(own) - 1
            wide = max(beam, k + 1)
            graph = build_graph(x, near=close[:, :BUILD_BEAM]) if (asks & ~own).any() else None
            for mine in (True, False):
                rows = np.flatnonzero(asks & (own == mine))
                for b in range(0, len(rows), BATCH):
                    some = rows[b : b + BATCH]
                    ids, sims = (close[position[some]], alike[position[some]]) if mine else beam_search(x, graph, v[some], entries(n, len(some)), wide)
                    r, c = np.nonzero((ids >= 0) & (sims >= at_least - 1e-3) & (names[ids] != node[some][:, None]))
                    first = np.arange(len(r)) - np.searchsorted(r, r) < k
                    r, c = r[first], c[first]
                    a, z = v[some][r].astype(np.float64), x[ids[r, c]].astype(np.float64)
                    cos = (a * z).sum(1) / np.sqrt((a * a).sum(1) * (z * z).sum(1))
                    kept = cos >= at_least
                    out.append((node[some][r][kept], names[ids[r, c]][kept], cos[kept]))
        a, b, s = (np.concatenate(z) for z in zip(*out))
        return pa.table({"node": a, "other": b, "similarity": s})

    return ask


def neighbours(embeddings: DataFrame, k: int = K, queries: Column | None = None, routes: int | None = ROUTES, beam: int = BEAM, at_least: float = -2.0) -> DataFrame:
    """(chunk_id, rank, neighbour_id, similarity): the k most similar others of every usable vector, or of those `queries` selects by chunk_id.

    Only those whose cosine is `at_least` so much; the rank is the same as among all.
    """
    spark = embeddings.sparkSession
    nodes, members, least = _nodes(usable_vectors(embeddings), k)
    release(spark)
    if queries is None:
        asked = nodes.withColumn("asked", F.lit(True))
    else:
        few = members.where(queries).select("node").union(nodes.select("node", F.col("node").alias("chunk_id")).where(queries).select("node")).distinct()
        asked = nodes.join(few.withColumn("hit", F.lit(True)), "node", "left").withColumn("asked", F.col("hit").isNotNull())
    centres = spark.sparkContext.broadcast(_centres(nodes))
    dealt = asked.select("node", "model", "dim", "vector", "asked").mapInArrow(_dealer(centres, routes), _DEALT)
    met = dealt.groupBy("model", "dim", "shard", "sub").applyInArrow(_asker(k, beam, at_least), "node long, other long, similarity double")
    if queries is None:
        both = F.explode(F.array(F.struct("node", "other"), F.struct(F.col("other").alias("node"), F.col("node").alias("other"))))
        met = met.select(both.alias("p"), "similarity").select("p.node", "p.other", "similarity")
    # A pair that was found from both sides has one rank.
    rank = F.dense_rank().over(Window.partitionBy("node").orderBy(F.desc("similarity"), "other"))
    top = met.withColumn("r", rank).where(F.col("r") <= k).select("node", "other", "similarity").distinct()
    top = top.union(least.select("node", F.col("node").alias("other"), F.lit(1.0)))
    # Nodes become chunk ids; k + 1 a node are enough, as a chunk drops only itself.
    wide = top.join(least.toDF("other", "ids"), "other", "left").select("node", F.explode(F.coalesce("ids", F.array("other"))).alias("id"), "similarity")
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("similarity"), "id"))
    lists = wide.withColumn("r", best).where(F.col("r") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("r", "id", "similarity"))).alias("near"))
    whole = lists.join(members, "node", "left").withColumn("chunk_id", F.coalesce("chunk_id", "node"))
    if queries is not None:
        whole = whole.where(queries)
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("chunk_id")), 1, k)
    each = whole.select("chunk_id", F.posexplode(others).alias("at", "x"))
    return each.select("chunk_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.col("x.similarity").alias("similarity"))


def close_pairs(embeddings: DataFrame, least: float = 0.9, k: int = K) -> DataFrame:
    """(chunk_id_a, chunk_id_b), smaller first: one among the k most similar of the other, with a cosine of at least `least`."""
    near = neighbours(embeddings, k, at_least=least).where(F.col("similarity") >= least)
    return near.select(F.least("chunk_id", "neighbour_id").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_b")).distinct()


def query_neighbours(embeddings: DataFrame, k: int = K) -> DataFrame:
    """The k most similar of each chunk whose id is divisible by 100, asked of every shard with a wide beam."""
    return neighbours(embeddings, k, F.col("chunk_id") % 100 == 0, routes=None, beam=WIDE_BEAM)
