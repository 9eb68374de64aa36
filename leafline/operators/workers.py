"""Workers over the job log: claims that two workers cannot share, index and vector jobs as plans over many documents, backfills and rebuilds.

A worker's round takes tables and returns the tables to store, a failing document being a row with its error; rounds run in `foreachBatch`
(`streaming.flows.work`) or in any loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import ingest, jobs, vectors

# Formats that a new version of the text extractor reads again, its message and priorities, documents between two rebuilds.
TEXT_FORMATS = (".txt", ".md", ".doc", ".docx", ".epub")
BACKFILL, VECTOR, REBUILD_EVERY = 80, 160, 100


def take(spark: SparkSession, folder: str, job_id: int, state: str) -> bool:
    """Whether the caller is the first to claim the job in this state of it: a file made only if it is not there, by the file system of `folder`."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/claims/{job_id}-{state}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.create(path, False).close()
        return True
    except Exception:
        if files.exists(path):
            return False
        raise


def claim_atomic(log: DataFrame, documents: DataFrame, folder: str, now: Column, ahead: int = 20) -> DataFrame | None:
    """The row to append for the best queued job that nobody else has claimed, or None."""
    spark = log.sparkSession
    queue = jobs.claim_order(jobs.latest(log), documents)
    for row in queue.select("id", F.unix_micros("updated_at").cast("string").alias("u")).limit(ahead).collect():
        if take(spark, folder, row["id"], row["u"]):
            mine = jobs.latest(log).where(F.col("id") == row["id"])
            return jobs.claim(mine, documents, now)
    return None


def cancelled(log: DataFrame) -> DataFrame:
    """(id): jobs that were cancelled."""
    return jobs.latest(log).where("status = 'cancelled'").select("id")


def failed_documents(documents: DataFrame, faults: DataFrame, now: Column) -> DataFrame:
    """Documents with those of (document_id, error) in error."""
    f = faults.select(F.col("document_id").alias("id"), F.col("error").alias("f_error")).dropDuplicates(["id"])
    met, hit = documents.join(f, "id", "left"), F.col("f_error").isNotNull()
    out = {"status": F.when(hit, "error").otherwise(F.col("status")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    out["error"] = F.when(hit, F.col("f_error")).otherwise(F.col("error") if "error" in documents.columns else F.lit(None).cast("string"))
    return met.withColumns(out).drop("f_error")


def index_round(documents: DataFrame, chunks: DataFrame, log: DataFrame, claimed: DataFrame, lines: DataFrame, now: Column) -> dict[str, DataFrame]:
    """documents, chunks, jobs to append and events after `lines` (document_id, page, line, ordinal, text, bbox, source, error) of claimed index jobs."""
    live = claimed.join(cancelled(log), "id", "left_anti")
    mine = live.select("document_id").distinct()
    faults = lines.where("error is not null").groupBy("document_id").agg(F.min("error").alias("error"))
    stopped = claimed.join(cancelled(log), "id", "left_semi").select("document_id", F.lit("cancelled").alias("error"))
    good = lines.where("error is null and text is not null").join(mine, "document_id", "left_semi").join(faults, "document_id", "left_anti")
    numbered = good.withColumn("id", F.abs(F.xxhash64("document_id", "ordinal", "line", "page", now.cast("string"))))
    done = mine.join(faults, "document_id", "left_anti")
    kept = ingest.without_documents(chunks, done).unionByName(numbered.select(chunks.columns))
    counts = done.join(ingest.document_counts(numbered), "document_id", "left").select("document_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("chunk_count", "text_chars", "page_count")))
    ready = ingest.indexed(documents, counts, now)
    new = {"status": F.when(F.col("error").isNull(), "done").otherwise("failed"), "message": F.when(F.col("error").isNull(), "Done").otherwise("Failed")}
    changes = live.select("id", "document_id").join(faults, "document_id", "left").select("id", new["status"].alias("status"), F.lit(1.0).alias("progress"), new["message"].alias("message"), "error")
    rows = jobs.update(jobs.latest(log), changes, now)
    wanted = counts.where("text_chars > 0").select("document_id", F.lit("vector").alias("type"), F.lit(VECTOR).alias("priority"), F.lit("Queued for fuzzy index").alias("message"))
    outcome = F.when(F.col("error").isNull(), "index").when(F.col("error") == "cancelled", "cancel").otherwise("error")
    told = mine.join(faults, "document_id", "left").unionByName(stopped)
    events = told.select(outcome.alias("type"), "document_id", F.coalesce("error", F.lit("indexed")).alias("message"), now.alias("created_at"))
    return {
        "documents": failed_documents(ready, faults.join(mine, "document_id", "left_semi").unionByName(stopped), now), "chunks": kept,
        "jobs": rows.unionByName(jobs.enqueue(jobs.latest(log), wanted, now)), "events": events,
    }


def vector_round(chunks: DataFrame, embeddings: DataFrame, documents: DataFrame, log: DataFrame, claimed: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, dim: int, now: Column) -> dict[str, DataFrame]:
    """embeddings and jobs to append after one round of claimed vector jobs. A failing batch leaves its vectors null: while the service is
    away (an error that passes) its jobs go back to the queue, else they fail."""
    live = claimed.join(cancelled(log), "id", "left_anti")
    asked = vectors.missing(chunks, embeddings, model, dim).join(live.select("document_id").distinct(), "document_id", "left_semi")
    made = vectors.embedded_or_errors(asked, embedder, model, dim)
    faults = made.where("error is not null").groupBy("document_id").agg(F.min_by(F.struct("kind", "error"), F.col("kind") == "passing").alias("f"))
    good = made.where("error is null").select("chunk_id", "document_id", "dim", "model", "vector")
    met = live.select("id", "document_id").join(faults, "document_id", "left")
    away = F.col("f.kind") == "passing"
    status = F.when(F.col("f").isNull(), "done").when(away, "queued").otherwise("failed")
    changes = met.select("id", status.alias("status"), F.when(away, 0.0).otherwise(1.0).alias("progress"), F.when(away, "Paused").otherwise(F.lit(None).cast("string")).alias("message"), F.col("f.error").alias("error"))
    return {"embeddings": vectors.upsert(embeddings, good, now), "jobs": jobs.update(jobs.latest(log), changes, now), "away": made.where("kind = 'passing'").limit(1)}


def rebuild_due(documents: DataFrame, embeddings: DataFrame, log: DataFrame, indexed: int, model: str, dim: int, own: int | None = None) -> DataFrame:
    """(embedded_documents, active_jobs, due): whether the index is to be made again, as REBUILD_EVERY documents are new or no other vector job is active."""
    whole = vectors.eligible(documents, embeddings, model, dim, True).agg(F.count_if(F.col("embedded") >= F.col("chunk_count")).alias("embedded_documents"))
    live = documents.where(~F.col("deleted")).select(F.col("id").alias("document_id"))
    busy = jobs.active(jobs.latest(log)).where(F.col("type") == "vector").join(live, "document_id", "left_semi")
    busy = busy if own is None else busy.where(F.col("id") != own)
    both = whole.withColumn("one", F.lit(1)).join(busy.agg(F.count("*").alias("active_jobs")).withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("due", (F.col("embedded_documents") - indexed >= REBUILD_EVERY) | (F.col("active_jobs") == 0))


def backfill(documents: DataFrame, log: DataFrame, now: Column, formats: tuple[str, ...] = TEXT_FORMATS) -> tuple[DataFrame, DataFrame]:
    """After a new version of the text extractor: documents of its formats queued, and jobs for those that have no active one."""
    hit = ~F.col("deleted") & F.col("ext").isin(*formats)
    wanted = documents.where(hit).select(F.col("id").alias("document_id"), F.lit("index").alias("type"), F.lit(BACKFILL).alias("priority"), F.lit("Queued for text decoder update").alias("message"))
    out = {"status": F.when(hit, "queued").otherwise(F.col("status")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    if "error" in documents.columns:
        out["error"] = F.when(~hit, F.col("error"))
    return documents.withColumns(out), jobs.enqueue(jobs.latest(log), wanted, now)
