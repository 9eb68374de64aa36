"""Snapshots of a directory against the state: which documents are new, changed, oversize or gone.

transition(state, snapshot) -> documents, jobs to enqueue and events, as one full outer join; chunks of documents that
are gone or oversize are taken out by an anti join. A changed document keeps its chunks until it is indexed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

CARRIED = ["id", "path", "rel_path", "title", "ext", "size", "mtime", "sha256"]
MEBIBYTE = 1 << 20


def document_id(rel_path: Column) -> Column:
    return F.substring(F.sha1(F.lower(F.replace(rel_path, F.lit("\\"), F.lit("/")))), 1, 20)


def excluded(rel_path: Column, names: list[str], paths: list[str]) -> Column:
    """Any part of the path is one of `names`, or the path is within one of `paths`."""
    path = F.replace(rel_path, F.lit("\\"), F.lit("/"))
    test = F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(n) for n in names)).cast("array<string>"))
    for p in paths:
        p = p.replace("\\", "/").strip("/")
        test = test | (path == p) | path.startswith(p + "/")
    return test


def categories(rel_path_rows: DataFrame) -> DataFrame:
    """(path, label): every directory that holds documents, its parents too, and first the whole library."""
    parts = F.split("rel_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = rel_path_rows.where(F.size(parts) > 1).select(F.explode(prefixes).alias("path")).distinct().select("path", F.col("path").alias("label"))
    return found.unionByName(found.sparkSession.createDataFrame([("", "all")], "path string, label string")).orderBy("path")


def scan(spark: SparkSession, root: str, suffixes: list[str], names: list[str] = [], paths: list[str] = [], content: bool = False) -> DataFrame:  # noqa: B006
    """Files below `root`: path, rel_path, title, ext, size, mtime, id and, if asked, the fingerprint. Contents are read only for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rel = F.substring_index(path, base + "/", -1)
    out = files.select(
        path.alias("path"), rel.alias("rel_path"), F.element_at(F.split(rel, "/"), -1).alias("title"), F.lower(F.regexp_extract(rel, r"(\.[^./]+)$", 1)).alias("ext"), F.col("length").alias("size"),
        (F.unix_millis("modificationTime") / 1000).alias("mtime"), *([F.col("content")] if content else []),
    )
    kept = out.where(F.col("ext").isin(*suffixes) & ~excluded(F.col("rel_path"), names, paths)).withColumn("id", document_id(F.col("rel_path")))
    if not content:
        return kept.withColumn("sha256", F.lit(None).cast("string"))
    return kept.withColumn("sha256", fingerprint(F.col("size"), F.col("mtime"), F.col("content"))).drop("content")


@pandas_udf(StringType())
def _number_text(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield v.map(repr)


def fingerprint(size: Column, mtime: Column, content: Column) -> Column:
    """sha1 of size, time and the first mebibyte, and the last if there are more than two."""
    head = F.concat(F.encode(size.cast("string"), "utf-8"), F.encode(_number_text(mtime), "utf-8"), F.substring(content, 1, MEBIBYTE))
    return F.sha1(F.when(size > 2 * MEBIBYTE, F.concat(head, F.substring(content, -MEBIBYTE, MEBIBYTE))).otherwise(head))


def transition(state: DataFrame, snapshot: DataFrame, now: Column, most_bytes: int | None = None) -> dict[str, DataFrame]:
    """documents (with `change`: new, changed, same, oversize, deleted or gone), jobs, events and the ids whose chunks go."""
    new = snapshot.select(*(F.col(c).alias("n_" + c) for c in CARRIED)).withColumn("seen", F.lit(True))
    met = state.join(new, state["id"] == new["n_id"], "full_outer")
    seen, known = F.col("seen").isNotNull(), F.col("id").isNotNull()
    too_big = (F.col("n_size") > most_bytes) if most_bytes is not None else F.lit(False)
    differs = (F.col("size") != F.col("n_size")) | (F.col("mtime") != F.col("n_mtime")) | F.col("deleted")
    change = (
        F.when(~seen, F.when(F.col("deleted"), "gone").otherwise("deleted"))
        .when(too_big, F.when(known & ~differs & (F.col("status") == "error"), "same").otherwise("oversize"))
        .when(~known, "new")
        .when(differs, "changed")
        .otherwise("same")
    )
    moved = change.isin("new", "changed")
    status = F.when(change == "deleted", "deleted").when(change == "oversize", "error").when(moved, "queued").otherwise(F.col("status"))
    columns = {c: F.coalesce("n_" + c, c) for c in CARRIED}
    out = met.withColumn("change", change)
    # What was found out about the old contents is forgotten with them.
    fresh = {"error": F.lit(None).cast("string"), "publication_status": F.lit("pending"), "publication_info": F.lit(None).cast("string"), "citation": F.lit(None).cast("string"), "publication_checked_at": F.lit(None).cast("timestamp")}
    reset = [F.when(F.col("change").isin("new", "changed"), v).otherwise(F.col(c)).alias(c) for c, v in fresh.items() if c in state.columns]
    rest = [c for c in state.columns if c not in (*CARRIED, *fresh, "status", "deleted", "created_at", "updated_at", "chunk_count", "text_chars")]
    # Counts of a document whose chunks go are zero.
    emptied = F.col("change").isin("deleted", "oversize")
    documents = out.select(
        *(columns[c].alias(c) for c in CARRIED), status.alias("status"), (~seen).alias("deleted"), F.coalesce("created_at", now).alias("created_at"),
        F.when(seen | (F.col("change") == "deleted"), now).otherwise(F.col("updated_at")).alias("updated_at"),
        *(F.when(emptied, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).alias(c) for c in ("chunk_count", "text_chars") if c in state.columns), *reset, *rest, "change",
    )
    jobs = documents.where(F.col("change").isin("new", "changed")).select(F.col("id").alias("document_id"), F.lit("index").alias("type"), F.lit(100).alias("priority"), F.lit(None).cast("string").alias("message"))
    kinds = F.when(F.col("change") == "deleted", "delete").when(F.col("change") == "oversize", "error").otherwise("change")
    events = documents.where(~F.col("change").isin("same", "gone")).select(kinds.alias("type"), F.col("id").alias("document_id"), "path", F.col("change").alias("message"), now.alias("created_at"))
    return {"documents": documents, "jobs": jobs, "events": events, "drop_chunks": documents.where(F.col("change").isin("deleted", "oversize")).select(F.col("id").alias("document_id"))}


def without_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks or vectors of documents that stay."""
    return rows.join(gone.select("document_id"), "document_id", "left_anti")


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks with those of `new`'s documents in place of the old; blank lines are left out."""
    kept = new.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return without_documents(chunks, new.select("document_id").distinct()).unionByName(kept.select(chunks.columns))


def document_counts(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_count, text_chars, page_count) of extracted lines."""
    return chunks.dropDuplicates(["id"]).groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.sum(F.length("text")).alias("text_chars"), F.coalesce(F.max("page"), F.lit(0)).alias("page_count"))


def indexed(documents: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """Documents after indexing: counts, ready or empty, and the time."""
    c = counts.select(F.col("document_id").alias("id"), *(F.col(x).alias("c_" + x) for x in ("chunk_count", "text_chars", "page_count")))
    met = documents.join(c, "id", "left")
    hit = F.col("c_chunk_count").isNotNull()
    out = {x: F.when(hit, F.col("c_" + x)).otherwise(F.col(x)) for x in ("chunk_count", "text_chars", "page_count")}
    out |= {"status": F.when(hit, F.when(F.col("c_text_chars") > 0, "ready").otherwise("empty")).otherwise(F.col("status")), "indexed_at": F.when(hit, now).otherwise(F.col("indexed_at"))}
    return met.select(*(out.get(x, F.col(x)).alias(x) for x in documents.columns))


def put_values(meta: DataFrame, values: dict[str, str]) -> DataFrame:
    """A key/value table with some keys set."""
    new = meta.sparkSession.createDataFrame(list(values.items()), "key string, value string")
    return meta.join(new.select("key"), "key", "left_anti").unionByName(new)


def rewritten(documents: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Documents with the size and time of (id, size, mtime) files that the engine itself wrote anew, so that no scan takes them for changed."""
    new = files.select("id", F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"))
    hit = F.col("n_size").isNotNull()
    out = {"size": F.coalesce("n_size", "size"), "mtime": F.coalesce("n_mtime", "mtime"), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return documents.join(new, "id", "left").withColumns(out).drop("n_size", "n_mtime")


def cascade(chunks: DataFrame, embeddings: DataFrame, documents: DataFrame, meta: DataFrame, gone: DataFrame, now: Column) -> dict[str, DataFrame]:
    """All tables without what belongs to documents that go; their counts are zero and the vector index is marked as behind."""
    hit = gone.select(F.col("document_id").alias("id"), F.lit(True).alias("gone")).dropDuplicates(["id"])
    met = documents.join(hit, "id", "left")
    marked = met.withColumns({"chunk_count": F.when(F.col("gone"), 0).otherwise(F.col("chunk_count")), "updated_at": F.when(F.col("gone"), now).otherwise(F.col("updated_at"))}).drop("gone")
    return {"chunks": without_documents(chunks, gone), "embeddings": without_documents(embeddings, gone), "documents": marked, "meta": put_values(meta, {"vector_index_dirty": "1"})}
