"""Streams: snapshots in micro-batches, debounced change events, enqueues without repeats, and the state of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafline.operators import ingest


def poll_snapshots(ticks: DataFrame, snapshot: Callable[[], DataFrame], state: Callable[[], DataFrame], store: Callable[[dict[str, DataFrame], int], None], checkpoint: str, once: bool = False, most_bytes: int | None = None) -> StreamingQuery:
    """At each tick the directory is compared with the state and the outcome stored.

    A file stream re-emits neither changed nor deleted files, so each micro-batch takes a snapshot and its difference.
    """

    def step(_: DataFrame, batch: int) -> None:
        store(ingest.transition(state(), snapshot(), F.current_timestamp(), most_bytes), batch)

    writer = ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="20 seconds")).start()


def debounced(events: DataFrame, time: str = "ts", gap: str = "2 seconds", late: str = "10 seconds", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(start, end, events): bursts of changes, each closed by a quiet gap. Watermark only on streams."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    burst = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("events"))
    return burst.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events")


def enqueues(wanted: DataFrame, time: str = "ts", within: str = "1 hour") -> DataFrame:
    """Requests (document_id, type) without the repeats of the last hour."""
    return wanted.withWatermark(time, within).dropDuplicatesWithinWatermark(["document_id", "type"])


def job_states(log: DataFrame) -> DataFrame:
    """The state of each job from a stream of updates (update mode): the last one, cancelled for good."""
    state = F.struct("updated_at", "status", "progress", "error")
    cancelled = F.col("status") == "cancelled"
    v = log.groupBy("id").agg(F.max(state).alias("last"), F.max(F.when(cancelled, state)).alias("stop")).select("id", F.coalesce("stop", "last").alias("v"))
    return v.select("id", "v.*")


def token_rate(events: DataFrame, tokens: Column, time: str = "ts", late: str = "2 minutes") -> DataFrame:
    """Tokens of each sliding minute, moved by ten seconds."""
    return events.withWatermark(time, late).groupBy(F.window(time, "60 seconds", "10 seconds").alias("w")).agg(F.sum(tokens).alias("tokens"))
