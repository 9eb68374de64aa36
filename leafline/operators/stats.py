"""Counts of the library, its jobs and vectors, and the use of daily quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.operators import jobs as J
from leafline.operators import vectors as V


def library(documents: DataFrame) -> DataFrame:
    live = ~F.col("deleted")
    return documents.agg(
        F.count_if(live).alias("total"), F.count_if(live & (F.col("status") == "ready")).alias("ready"), F.count_if(live & F.col("status").isin(*J.ACTIVE)).alias("active"),
        F.count_if(live & (F.col("status") == "error")).alias("errors"), F.coalesce(F.sum(F.when(live, F.col("text_chars"))), F.lit(0)).alias("text_chars"),
    )


def job_counts(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    live = documents.where(~F.col("deleted")).select(F.col("id").alias("document_id"))
    kept = jobs.join(live, "document_id", "left_semi")
    return kept.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "processing").alias("processing"))


def running_job(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    live = documents.where(~F.col("deleted")).select(F.col("id").alias("document_id"))
    return J.active(jobs).join(live, "document_id", "left_semi").orderBy(F.desc(F.col("status") == "processing"), F.desc("updated_at"), F.desc("id")).limit(1)


def vectors(documents: DataFrame, jobs: DataFrame, embeddings: DataFrame, model: str, dim: int) -> DataFrame:
    """One row: documents and chunks with text, vectors, complete documents, vector jobs."""
    have = V.current(embeddings, False).where((F.col("model") == model) & (F.col("dim") == dim))
    per = have.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    live = documents.where(~F.col("deleted"))
    texts = live.where((F.col("text_chars") > 0) & (F.col("chunk_count") > 0)).join(per, "id", "left")
    a = texts.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.count_if(F.coalesce("n", F.lit(0)) >= F.col("chunk_count")).alias("embedded_documents"))
    b = have.agg(F.count("*").alias("embeddings"))
    # Failed counts only where it is the last vector job of its document.
    mine = jobs.where("type = 'vector'").join(live.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    last = mine.groupBy("document_id").agg(F.max_by("status", "id").alias("last"), F.count_if(F.col("status") == "queued").alias("q"), F.count_if(F.col("status") == "processing").alias("p"))
    c = last.agg(F.coalesce(F.sum("q"), F.lit(0)).alias("queued"), F.coalesce(F.sum("p"), F.lit(0)).alias("processing"), F.count_if(F.col("last") == "failed").alias("failed"))
    one = F.lit(1).alias("one")
    parts = [x.select(one, "*") for x in (a, b, c)]
    return parts[0].join(parts[1], "one").join(parts[2], "one").drop("one")


def quota_day(at: Column, zone: str = "Asia/Shanghai") -> Column:
    """The day of a quota, as text, in its zone."""
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd")


def day_bounds(day: Column, zone: str = "Asia/Shanghai") -> tuple[Column, Column]:
    """Start and end of a day of the zone, in UTC."""
    start = F.to_timestamp(day, "yyyy-MM-dd")
    return F.to_utc_timestamp(start, zone), F.to_utc_timestamp(start + F.expr("interval 1 day"), zone)


def valid_zone(zone: str | None) -> str:
    """The zone's name, or UTC if it is unknown."""
    from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

    try:
        ZoneInfo(zone or "Asia/Shanghai")
        return zone or "Asia/Shanghai"
    except (ZoneInfoNotFoundError, ValueError):
        return "UTC"


def indexed_pages(documents: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """(usage_date, indexed_pages) of PDF documents by the day on which they were indexed."""
    pdf = documents.where(~F.col("deleted") & (F.col("ext") == ".pdf") & F.col("indexed_at").isNotNull())
    return pdf.groupBy(quota_day(F.col("indexed_at"), zone).alias("usage_date")).agg(F.sum("page_count").alias("indexed_pages"))


def daily_usage(documents: DataFrame, usage: DataFrame, limit: int = 20_000, zone: str = "Asia/Shanghai") -> DataFrame:
    """Pages used a day, the greater of logged and indexed, where the figure is from, and what remains (null without a limit)."""
    logged = usage.groupBy("usage_date").agg(F.max_by("pages", "updated_at").alias("logged"))
    both = logged.join(indexed_pages(documents, zone), "usage_date", "full_outer")
    a, b = F.coalesce("logged", F.lit(0)), F.coalesce("indexed_pages", F.lit(0))
    used = F.greatest(a, b)
    left = F.greatest(F.lit(0), F.lit(limit) - used) if limit > 0 else F.lit(None).cast("bigint")
    return both.select("usage_date", used.alias("used_pages"), a.alias("logged_pages"), b.alias("indexed_pages"), F.when(F.col("logged").isNotNull() & (a >= b), "usage_log").otherwise("documents").alias("source"), left.alias("remaining_pages"))


def record_usage(usage: DataFrame, indexed: DataFrame, added: DataFrame, now: Column) -> DataFrame:
    """Usage with (usage_date, pages) added; the first entry of a day starts from the pages indexed on it."""
    more = added.groupBy("usage_date").agg(F.sum("pages").alias("more"))
    met = usage.select("usage_date", "pages", "updated_at").join(more, "usage_date", "full_outer").join(indexed, "usage_date", "left")
    base = F.coalesce("pages", "indexed_pages", F.lit(0))
    changed = F.col("more").isNotNull()
    return met.select("usage_date", F.when(changed, base + F.col("more")).otherwise(F.col("pages")).alias("pages"), F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"))


def rate_window(events: DataFrame, tokens: Column, seconds: int = 60) -> DataFrame:
    """Tokens of the last `seconds` at each event: each slot of so many seconds is one window over its own rows and those of the slot before,
    so rows are doubled and no pairs are made."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("event_id", micros.alias("at"), tokens.alias("tokens"), F.floor(micros / (seconds * 1_000_000)).alias("slot"))
    both = rows.select("event_id", "at", "tokens", "slot", F.lit(True).alias("own")).unionAll(rows.select("event_id", "at", "tokens", F.col("slot") + 1, F.lit(False)))
    span = Window.partitionBy("slot").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    return both.select("event_id", "own", F.sum("tokens").over(span).alias("window_tokens")).where("own").select("event_id", "window_tokens")


def progress(page: Column, total: Column, start: float = 0.05, span: float = 0.87, most: float = 0.97) -> Column:
    """How far a job is at a page of so many."""
    return F.when(page <= 0, F.lit(start)).otherwise(F.least(F.lit(start) + span * (page / F.greatest(total, F.lit(1))), F.lit(most)))
