"""Vectors of chunks: normalising, 4-bit quantising, exact and quantised search, batches for an embedder, what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.operators.remote import class_of, halved

LEVELS = 15


def current(embeddings: DataFrame, vector: bool = True) -> DataFrame:
    """The latest row of each chunk. Without `vector` only narrow columns are read and shuffled."""
    names = ["document_id", "dim", "model", *(["vector"] if vector else [])]
    return embeddings.groupBy("chunk_id").agg(F.max_by(F.struct(*names), "updated_at").alias("v")).select("chunk_id", *(f"v.{n}" for n in names))


def usable(embeddings: DataFrame, model: str, dim: int) -> DataFrame:
    kept = current(embeddings).where((F.col("model") == model) & (F.col("dim") == dim) & (F.size("vector") == dim))
    return kept.where(~F.exists("vector", lambda x: F.isnan(x) | x.isNull()) & F.exists("vector", lambda x: x != 0))


def unit(vector: Column, dim: int, strict: bool = False) -> Column:
    """The first `dim` elements over their norm (1 for a zero vector); shorter vectors are null, or an error if strict."""
    cut = F.transform(F.slice(vector, 1, dim), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x * x))
    short = F.raise_error(F.lit("vector is shorter than asked for")) if strict else F.lit(None)
    checked = F.when(F.size(vector) < dim, short.cast("array<double>")).otherwise(cut)
    # The norm sits beside the vector in a one-element array: within the inner lambda it would be computed for each element.
    pair = F.array(F.struct(checked.alias("v"), F.when(norm == 0, F.lit(1.0)).otherwise(norm).alias("n")))
    return F.element_at(F.transform(pair, lambda p: F.transform(p["v"], lambda x: x / p["n"])), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _literal(query: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def ranges(units: DataFrame) -> DataFrame:
    """(d, low, high): the range of each dimension, trained over all vectors."""
    return units.select(F.posexplode("unit").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def train(units: DataFrame) -> tuple[list[float], list[float]]:
    """Ranges as two lists; as many rows as dimensions reach the driver."""
    found = sorted(ranges(units).collect())
    return [r["low"] for r in found], [r["high"] for r in found]


def codes(unit_vector: Column, low: list[float], high: list[float]) -> Column:
    def code(x: Column, edge: Column) -> Column:
        span = edge["high"] - edge["low"]
        at = F.when(span == 0, F.lit(0.0)).otherwise((x - edge["low"]) / span)
        return F.floor(F.lit(float(LEVELS)) * F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0))).cast("byte")

    return F.zip_with(unit_vector, F.arrays_zip(_literal(low).alias("low"), _literal(high).alias("high")), code)


def decoded(code: Column, low: list[float], high: list[float]) -> Column:
    edges = F.arrays_zip(_literal(low).alias("low"), _literal(high).alias("high"))
    return F.zip_with(code, edges, lambda c, e: e["low"] + (c.cast("double") + 0.5) / LEVELS * (e["high"] - e["low"]))


def build_index(embeddings: DataFrame, model: str, dim: int) -> tuple[DataFrame, list[float], list[float]]:
    """(chunk_id, document_id, codes) and the ranges the codes refer to."""
    units = usable(embeddings, model, dim).select("chunk_id", "document_id", unit(F.col("vector"), dim).alias("unit"))
    low, high = train(units)
    return units.select("chunk_id", "document_id", codes(F.col("unit"), low, high).alias("codes") if low else F.array().cast("array<tinyint>").alias("codes")), low, high


def candidates(offset: int, limit: int, configured: int = 5000) -> int:
    return min(configured, max(200, (offset + limit) * 20))


def search(index: DataFrame, low: list[float], high: list[float], query: list[float], top: int) -> DataFrame:
    """The `top` chunks by the product of the query with the decoded vectors, over all of them; filters come after."""
    score = dot(decoded(F.col("codes"), low, high), _literal(query))
    return index.select("chunk_id", "document_id", score.alias("match_score")).orderBy(F.desc("match_score"), "chunk_id").limit(top)


def exact(embeddings: DataFrame, model: str, dim: int, query: list[float], document_id: str | None = None) -> DataFrame:
    """Chunks by exact cosine, of one document if asked."""
    kept = embeddings if document_id is None else embeddings.where(F.col("document_id") == document_id)
    score = dot(unit(F.col("vector"), dim), _literal(query))
    return usable(kept, model, dim).select("chunk_id", "document_id", score.alias("match_score")).orderBy(F.desc("match_score"), "chunk_id")


def fuzzy_groups(found: DataFrame) -> DataFrame:
    """A row a document: number of hits and its best hit, best documents first."""
    best = F.max_by("chunk_id", F.struct("match_score", (-F.col("chunk_id")).alias("x")))
    return found.groupBy("document_id").agg(F.count("*").alias("match_count"), F.max("match_score").alias("match_score"), best.alias("match_id")).orderBy(F.desc("match_score"), "document_id")


def missing(chunks: DataFrame, embeddings: DataFrame, model: str, dim: int) -> DataFrame:
    """Chunks without a vector of this model and dim."""
    have = current(embeddings, False).where((F.col("model") == model) & (F.col("dim") == dim)).select(F.col("chunk_id").alias("id"))
    return chunks.dropDuplicates(["id"]).join(have, "id", "left_anti")


def eligible(documents: DataFrame, embeddings: DataFrame, model: str, dim: int, force: bool = False) -> DataFrame:
    """Documents with text whose vectors are not complete (all of them if forced)."""
    have = current(embeddings, False).where((F.col("model") == model) & (F.col("dim") == dim)).groupBy("document_id").agg(F.count("*").alias("embedded"))
    live = documents.where(~F.col("deleted") & (F.col("text_chars") > 0) & (F.col("chunk_count") > 0))
    counted = live.join(have, live["id"] == have["document_id"], "left").withColumn("embedded", F.coalesce("embedded", F.lit(0)))
    return (counted if force else counted.where(F.col("embedded") < F.col("chunk_count"))).select("id", "chunk_count", "embedded")


def pack_batches(sizes: list[int], most_items: int, most_tokens: int) -> list[int]:
    """The number of the batch of each input, in order: a batch closes before the input that would overfill it."""
    out, batch, items, tokens = [], 0, 0, 0
    for size in sizes:
        if items and (tokens + size > most_tokens or 0 < most_items <= items):
            batch, items, tokens = batch + 1, 0, 0
        out.append(batch)
        items, tokens = items + 1, tokens + size
    return out


def batches(chunks: DataFrame, most_items: int = 0, most_tokens: int = 30_000, block: int = 4096) -> DataFrame:
    """(document_id, part, id, ordinal, batch): greedy batches by estimated tokens, in parts of `block` ordinals of a document."""
    size = F.least(F.lit(most_tokens), F.greatest(F.lit(1), F.length(F.trim("text")) + 4))
    part = F.floor(F.coalesce("ordinal", F.lit(0)) / block).cast("int")
    rows = chunks.dropDuplicates(["id"]).select("document_id", part.alias("part"), "id", "ordinal", F.coalesce(size, F.lit(4)).alias("size"))
    gathered = rows.groupBy("document_id", "part").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "size"))).alias("rows"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [
                (doc, part, r["id"], r["ordinal"], b)
                for doc, part, rows in zip(frame["document_id"], frame["part"], frame["rows"])
                for r, b in zip(rows, pack_batches([r["size"] for r in rows], most_items, most_tokens))
            ]
            yield pd.DataFrame(out, columns=["document_id", "part", "id", "ordinal", "batch"])

    return gathered.mapInPandas(pack, "document_id string, part int, id long, ordinal int, batch int")


def embedded_or_errors(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, dim: int) -> DataFrame:
    """(chunk_id, document_id, dim, model, vector, error, kind) by a pluggable embedder, in Arrow batches.

    Errors that pass are waited out, lack of memory or time halves the request; what fails even so comes out with its error and the error's class.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [(t or "").strip() for t in frame["text"]]
            out, error, kind = [None] * len(texts), None, None
            try:
                out = halved(embedder, texts)
            except Exception as fault:
                error, kind = f"{type(fault).__name__}: {fault}", class_of(fault)
            yield pd.DataFrame({"chunk_id": frame["id"], "document_id": frame["document_id"], "vector": pd.Series(out, dtype=object), "error": error, "kind": kind})

    made = rows.select("id", "document_id", "text").mapInPandas(work, "chunk_id long, document_id string, vector array<float>, error string, kind string")
    return made.select("chunk_id", "document_id", F.lit(dim).alias("dim"), F.lit(model).alias("model"), F.when(F.col("error").isNull(), unit(F.col("vector"), dim, True)).cast("array<float>").alias("vector"), "error", "kind")


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, dim: int) -> DataFrame:
    """(chunk_id, document_id, dim, model, vector); an error that neither waiting nor smaller requests help ends the job."""
    made = embedded_or_errors(rows, embedder, model, dim)
    failed = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("array<float>"))
    return made.select("chunk_id", "document_id", "dim", "model", F.coalesce(failed, "vector").alias("vector"))


def save_index(embeddings: DataFrame, model: str, dim: int, folder: str) -> int:
    """Codes and ranges as Parquet below `folder`; the number of vectors. A search over what `open_index` returns trains nothing."""
    codes_, low, high = build_index(embeddings, model, dim)
    spark = embeddings.sparkSession
    codes_.write.mode("overwrite").parquet(f"{folder}/codes")
    rows = [(model, dim, d, a, b) for d, (a, b) in enumerate(zip(low, high))]
    spark.createDataFrame(rows, "model string, dim int, d int, low double, high double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranges")
    return spark.read.parquet(f"{folder}/codes").count()


def open_index(spark: SparkSession, folder: str) -> tuple[DataFrame, list[float], list[float]]:
    """What `search` takes, from `save_index`; as many rows as dimensions reach the driver."""
    edges = sorted((r["d"], r["low"], r["high"]) for r in spark.read.parquet(f"{folder}/ranges").collect())
    return spark.read.parquet(f"{folder}/codes"), [e[1] for e in edges], [e[2] for e in edges]


def upsert(state: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """State with the new vectors; a chunk keeps its first created_at."""
    added = new.withColumn("created_at", now).withColumn("updated_at", now).select(state.columns)
    first = F.min("created_at").over(Window.partitionBy("chunk_id"))
    last = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("updated_at")))
    return state.unionByName(added).withColumn("created_at", first).withColumn("_n", last).where("_n = 1").drop("_n")


def index_status(embeddings: DataFrame, meta: dict[str, str], model: str, dim: int) -> dict:
    """Whether the index can answer: it exists, is for this model and dim and not ahead of the vectors."""
    count = int(meta.get("vector_index_count") or 0)
    have = current(embeddings, False).where((F.col("model") == model) & (F.col("dim") == dim)).count()
    fits = meta.get("vector_index_model") == model and int(meta.get("vector_index_dim") or 0) == dim
    return {"available": bool(meta.get("vector_index_path")) and count > 0 and fits and have >= count, "dirty": meta.get("vector_index_dirty") == "1", "index_count": count, "embeddings": have}
