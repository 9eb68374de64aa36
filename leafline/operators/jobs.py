"""Jobs and events: a log of job states, the current view, and transitions as plans.

A transition takes tables and returns changed tables; storage is versioned elsewhere. Jobs stay cancelled once they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("queued", "processing")
COLUMNS = ["id", "document_id", "type", "status", "priority", "progress", "message", "error", "created_at", "updated_at", "started_at", "finished_at"]


def latest(log: DataFrame) -> DataFrame:
    """The state of each job: its last update, but none after a cancellation except another one."""
    state = F.struct(*(c for c in COLUMNS if c != "id"))
    when = F.struct("updated_at", "status")
    cancelled = F.col("status") == "cancelled"
    last, stop = F.max_by(state, when).alias("last"), F.max_by(F.when(cancelled, state), F.when(cancelled, when)).alias("stop")
    v = log.groupBy("id").agg(last, stop).select("id", F.coalesce("stop", "last").alias("v"))
    return v.select("id", "v.*")


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE))


def enqueue(jobs: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """New queued jobs for (document_id, type, priority, message) without an active job of the type. Ids follow from document, type and time."""
    fresh = wanted.dropDuplicates(["document_id", "type"]).join(active(jobs).select("document_id", "type"), ["document_id", "type"], "left_anti")
    stamp = F.abs(F.xxhash64("document_id", "type", now.cast("string")))
    null = F.lit(None)
    return fresh.select(
        stamp.alias("id"), "document_id", "type", F.lit("queued").alias("status"), F.col("priority").cast("int").alias("priority"), F.lit(0.0).alias("progress"), "message",
        null.cast("string").alias("error"), now.alias("created_at"), now.alias("updated_at"), null.cast("timestamp").alias("started_at"), null.cast("timestamp").alias("finished_at"),
    )


def claim_order(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Queued jobs of live documents in the order in which they are claimed."""
    live = documents.where(~F.col("deleted")).select(F.col("id").alias("document_id"))
    return jobs.where("status = 'queued'").join(live, "document_id", "left_semi").orderBy("priority", "created_at", "id")


def claim(jobs: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """The head of the queue in its processing state: one row to append to the log."""
    head = claim_order(jobs, documents).limit(1)
    return head.withColumn("status", F.lit("processing")).withColumn("progress", F.greatest("progress", F.lit(0.01))).withColumn("updated_at", now).withColumn("started_at", F.coalesce("started_at", now)).select(*COLUMNS)


def update(jobs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Rows to append for (id, status, progress, message, error); nulls keep what was, cancelled jobs take only a cancellation."""
    new = changes.select("id", *(F.col(c).alias("new_" + c) for c in ("status", "progress", "message", "error")))
    met = jobs.join(new, "id").where((F.col("status") != "cancelled") | (F.col("new_status") == "cancelled"))
    ended = F.coalesce("new_status", "status").isin("done", "failed", "cancelled")
    out = {c: F.coalesce("new_" + c, c) for c in ("status", "progress", "message", "error")}
    return met.withColumn("finished_at", F.when(ended, now).otherwise(F.col("finished_at"))).withColumns(out).withColumn("updated_at", now).select(*COLUMNS)


def cancel(jobs: DataFrame, which: Column, reason: str | None, now: Column) -> DataFrame:
    """Active jobs of `which` as cancelled rows."""
    rows = active(jobs).where(which)
    return rows.withColumns({"status": F.lit("cancelled"), "progress": F.lit(1.0), "error": F.lit(reason).cast("string"), "updated_at": now, "finished_at": now}).select(*COLUMNS)


def documents_after_cancel(documents: DataFrame, jobs_before: DataFrame, cancelled: DataFrame) -> DataFrame:
    """(id): documents that fall to error, as an index job was cancelled and none is left active."""
    left = active(jobs_before).join(cancelled.select("id"), "id", "left_anti").select("document_id")
    hit = cancelled.where("type = 'index'").select("document_id").distinct().join(left, "document_id", "left_anti")
    return documents.join(hit, documents["id"] == hit["document_id"], "left_semi").select("id")


def restart(jobs: DataFrame, job_id: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """Cancelled rows for the active jobs of the same document and type, and the new queued job."""
    job = jobs.where(F.col("id") == job_id)
    same = jobs.join(F.broadcast(job.select("document_id", "type")), ["document_id", "type"], "left_semi")
    stopped = cancel(same, F.lit(True), "restarted", now)
    return stopped, enqueue(jobs.where(F.lit(False)), job.select("document_id", "type", "priority", "message"), now)


def pause_vectors(jobs: DataFrame, documents: DataFrame, reason: str, now: Column) -> DataFrame:
    """Processing vector jobs of live documents back to the queue."""
    live = documents.where(~F.col("deleted")).select(F.col("id").alias("document_id"))
    rows = jobs.where("type = 'vector' and status = 'processing'").join(live, "document_id", "left_semi")
    return rows.withColumns({"status": F.lit("queued"), "error": F.lit(reason), "started_at": F.lit(None).cast("timestamp"), "updated_at": now}).select(*COLUMNS)


def cancel_vectors(jobs: DataFrame, documents: DataFrame, reason: str, now: Column) -> DataFrame:
    live = documents.where(~F.col("deleted")).select(F.col("id").alias("document_id"))
    return cancel(jobs.join(live, "document_id", "left_semi"), F.col("type") == "vector", reason, now)


def recover(jobs: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """After a crash: jobs of deleted documents cancelled, processing ones queued again."""
    gone = documents.where("deleted").select(F.col("id").alias("document_id"))
    stopped = cancel(jobs.join(gone, "document_id", "left_semi"), F.lit(True), None, now)
    again = jobs.where("status = 'processing'").join(gone, "document_id", "left_anti")
    queued = again.withColumns({"status": F.lit("queued"), "progress": F.lit(0.0), "started_at": F.lit(None).cast("timestamp"), "updated_at": now}).select(*COLUMNS)
    return stopped.unionByName(queued)


def latest_of_document(jobs: DataFrame, kind: str | None = None) -> DataFrame:
    """The job with the greatest id of each document."""
    rows = jobs if kind is None else jobs.where(F.col("type") == kind)
    v = rows.groupBy("document_id").agg(F.max_by(F.struct("id", "type", "status", "updated_at"), "id").alias("v"))
    return v.select("document_id", "v.*")


def failed(documents: DataFrame) -> DataFrame:
    return documents.where(~F.col("deleted") & F.col("status").isin("error", "empty"))


def retry_candidates(documents: DataFrame, jobs: DataFrame, kind: str = "index") -> DataFrame:
    """Failed documents without an active job of the kind, last changed first."""
    busy = active(jobs).where(F.col("type") == kind).select(F.col("document_id").alias("id"))
    return failed(documents).join(busy, "id", "left_anti").orderBy(F.desc("updated_at"), "id")


def recent(jobs: DataFrame, documents: DataFrame, limit: int = 30) -> DataFrame:
    named = documents.where(~F.col("deleted")).select(F.col("id").alias("document_id"), "title", "rel_path")
    return jobs.join(named, "document_id").orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)
