"""One object over the tables of a library: the calls of the service, each a plan of the operators."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.functions.snippet import fuzzy_snippet, snippet_column
from leafline.operators import ingest, jobs, search, stats, vectors


class Unavailable(RuntimeError):
    """Semantic search cannot answer; the service's 503."""


class Unknown(KeyError):
    """No such row; the service's 404."""


# Secrets by their environment variable.
SECRETS = ("OCR_API_TOKEN", "LANGUAGE_MODEL_API_KEY", "EMBEDDING_API_KEY")


def secret(name: str, path: str | None = None) -> str | None:
    """The environment's value, else that of a JSON file."""
    if value := os.environ.get(name):
        return value
    if path and os.path.exists(path):
        with open(path) as file:
            return json.load(file).get(name) or None
    return None


def write_secrets(path: str, values: dict[str, str | None]) -> None:
    kept = {}
    if os.path.exists(path):
        with open(path) as file:
            kept = json.load(file)
    kept |= {k: v for k, v in values.items() if v}
    with open(path, "w") as file:
        json.dump(kept, file)
    os.chmod(path, 0o600)


def within(path: str, roots: list[str]) -> bool:
    """Whether a path lies in one of the folders, links followed."""
    real = os.path.realpath(path)
    return any(os.path.commonpath([real, os.path.realpath(r)]) == os.path.realpath(r) for r in roots)


def tier(memory_gb: float, gpu: bool) -> dict[str, int]:
    """Largest input in MB by the machine's memory."""
    most = 256 if memory_gb < 8 else 512 if memory_gb < 16 else 768 if memory_gb < 32 else 1024
    return {"max_file_mb": min(1024, most * 2) if gpu and memory_gb >= 8 else most}


@dataclass
class Library:
    documents: DataFrame
    chunks: DataFrame
    embeddings: DataFrame | None = None
    job_log: DataFrame | None = None
    events: DataFrame | None = None
    usage: DataFrame | None = None
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    model: str = ""
    dim: int = 0
    quota: int = 20_000
    zone: str = "Asia/Shanghai"
    _index: tuple | None = None
    _memo: dict = field(default_factory=dict)

    def health(self) -> dict:
        return {"ok": True}

    def _jobs(self) -> DataFrame:
        if self.job_log is None:
            raise Unknown("jobs")
        return jobs.latest(self.job_log)

    def stats(self, seconds: float = 10.0) -> dict:
        """Counts, kept for ten seconds."""
        at, got = self._memo.get("stats", (0.0, None))
        if got is None or time.monotonic() - at > seconds:
            got = {"documents": stats.library(self.documents).first().asDict()}
            if self.job_log is not None:
                got["jobs"] = stats.job_counts(self._jobs(), self.documents).first().asDict()
                latest = stats.running_job(self._jobs(), self.documents).first()
                got["latest_job"] = latest.asDict() if latest else None
            if self.embeddings is not None and self.job_log is not None:
                got["vectors"] = stats.vectors(self.documents, self._jobs(), self.embeddings, self.model, self.dim).first().asDict()
            if self.usage is not None:
                today = stats.quota_day(F.current_timestamp(), stats.valid_zone(self.zone))
                row = stats.daily_usage(self.documents, self.usage, self.quota, stats.valid_zone(self.zone)).where(F.col("usage_date") == today).first()
                got["quota"] = row.asDict() if row else {"used_pages": 0, "remaining_pages": self.quota or None}
            self._memo["stats"] = (time.monotonic(), got)
        return got

    def _query_vector(self, query: str) -> list[float]:
        if self.embedder is None or self.embeddings is None:
            raise Unavailable("no embedder or vectors are configured")
        v = list(map(float, self.embedder([query.strip()])[0]))[: self.dim]
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        return [x / norm for x in v]

    def build_index(self) -> int:
        codes, low, high = vectors.build_index(self.embeddings, self.model, self.dim)
        self._index = codes, low, high
        return codes.count()

    def _fuzzy(self, query: str, scope: str | None, top: int) -> DataFrame:
        if self._index is None:
            raise Unavailable("the vector index is not built")
        found = vectors.search(*self._index, self._query_vector(query), top)
        owners = search.live_documents(self.documents, scope)  # after the top k, so fewer may come out
        rows = found.join(search.live_chunks(self.chunks).select(F.col("id").alias("chunk_id"), "page", "ordinal", "line", "text"), "chunk_id").dropDuplicates(["chunk_id"]).join(owners, "document_id")
        return rows.withColumn("source", F.format_string("fuzzy %.3f", "match_score"))

    def search(self, q: str, scope: str | None = None, mode: str = "basic", limit: int = 50, offset: int = 0) -> dict:
        limit, offset = max(1, min(limit, 500)), max(0, offset)
        if T.mode_name(mode) == "fuzzy":
            rows = self._fuzzy(q, scope, offset + limit + 1).orderBy(F.desc("match_score"), "chunk_id")
            out = search.envelope(rows, limit, offset)
            for r in out["results"]:
                r["snippet"] = fuzzy_snippet(r["text"])
            return out
        p = search.plan(self.chunks, self.documents, q, mode, scope)
        return self._page(search.hits(p), p.variants, limit, offset, "results")

    def _page(self, rows: DataFrame, variants: list[str], limit: int, offset: int, key: str) -> dict:
        page = search.page_of(rows, limit, offset).withColumn("snippet", snippet_column(F.col("text"), variants))
        found = [r.asDict(recursive=True) for r in page.collect()]  # at most limit + 1 rows
        more, found = len(found) > limit, found[:limit]
        return {key: found, "count": offset + len(found) + more, "returned_count": len(found), "offset": offset, "limit": limit, "has_more": more, "next_offset": offset + len(found) if more else None}

    def search_groups(self, q: str, scope: str | None = None, mode: str = "basic", limit: int = 50, offset: int = 0) -> dict:
        limit, offset = max(1, min(limit, 500)), max(0, offset)
        if T.mode_name(mode) == "fuzzy":
            rows = self._fuzzy(q, scope, vectors.candidates(offset, limit))
            best = vectors.fuzzy_groups(rows.select("document_id", "chunk_id", "match_score"))
            first = rows.select(F.col("chunk_id").alias("match_id"), "page", "ordinal", "line", "text", "source", "rel_path", "title")
            out = search.envelope(best.join(first, "match_id").orderBy(F.desc("match_score"), "document_id"), limit, offset, "groups")
            for r in out["groups"]:
                r["snippet"] = fuzzy_snippet(r["text"])
            return out
        p = search.plan(self.chunks, self.documents, q, mode, scope)
        return self._page(search.groups(p), p.variants, limit, offset, "groups")

    def search_document(self, document_id: str, q: str, mode: str = "basic", limit: int = 100, offset: int = 0) -> dict:
        self.document(document_id)
        if T.mode_name(mode) == "fuzzy":
            rows = vectors.exact(self.embeddings, self.model, self.dim, self._query_vector(q), document_id)
            text = search.live_chunks(self.chunks).select(F.col("id").alias("chunk_id"), "page", "ordinal", "line", "text")
            return search.envelope(rows.join(text, "chunk_id").dropDuplicates(["chunk_id"]).orderBy(F.desc("match_score"), "chunk_id"), limit, offset)
        p = search.plan(self.chunks, self.documents, q, mode, None, document_id)
        return self._page(search.hits(p), p.variants, limit, offset, "results")

    def document(self, document_id: str) -> dict:
        row = self.documents.where((F.col("id") == document_id) & ~F.col("deleted")).first()
        if row is None:
            raise Unknown(document_id)
        return row.asDict(recursive=True)

    def text_context(self, document_id: str, match_id: int | None = None, radius: int = 8) -> list[dict]:
        self.document(document_id)
        return [r.asDict(recursive=True) for r in search.text_context(self.chunks, document_id, match_id, radius).collect()]

    def categories(self) -> DataFrame:
        return ingest.categories(self.documents.where(~F.col("deleted")))

    def recent_documents(self, limit: int = 200) -> DataFrame:
        return self.documents.where(~F.col("deleted")).orderBy(F.desc("updated_at"), "id").limit(max(1, min(limit, 1000)))

    def failed_documents(self, limit: int = 30) -> dict:
        rows = jobs.failed(self.documents)
        total = rows.count()
        found = [r.asDict(recursive=True) for r in rows.orderBy(F.desc("updated_at"), "id").limit(limit).collect()]
        return {"documents": found, "total": total, "has_more": total > len(found)}

    def retry_failed(self, limit: int = 1000) -> DataFrame:
        """The jobs to append."""
        some = jobs.retry_candidates(self.documents, self._jobs()).limit(limit)
        wanted = some.select(F.col("id").alias("document_id"), F.lit("index").alias("type"), F.lit(90).alias("priority"), F.lit("retry").alias("message"))
        return jobs.enqueue(self._jobs(), wanted, F.current_timestamp())

    def rebuild_vectors(self, force: bool = False, limit: int = 10_000) -> DataFrame:
        some = vectors.eligible(self.documents, self.embeddings, self.model, self.dim, force).orderBy("id").limit(limit)
        wanted = some.select(F.col("id").alias("document_id"), F.lit("vector").alias("type"), F.lit(160).alias("priority"), F.lit(None).cast("string").alias("message"))
        return jobs.enqueue(self._jobs(), wanted, F.current_timestamp())

    def cancel_vectors(self) -> DataFrame:
        return jobs.cancel_vectors(self._jobs(), self.documents, "cancelled", F.current_timestamp())

    def recent_jobs(self, limit: int = 30) -> DataFrame:
        return jobs.recent(self._jobs(), self.documents, limit)

    def cancel_job(self, job_id: int) -> DataFrame:
        if self._jobs().where(F.col("id") == job_id).isEmpty():
            raise Unknown(str(job_id))
        return jobs.cancel(self._jobs(), F.col("id") == job_id, "cancelled", F.current_timestamp())

    def restart_job(self, job_id: int) -> tuple[DataFrame, DataFrame]:
        if self._jobs().where(F.col("id") == job_id).isEmpty():
            raise Unknown(str(job_id))
        return jobs.restart(self._jobs(), job_id, F.current_timestamp())

    def recent_events(self, limit: int = 30) -> DataFrame:
        if self.events is None:
            raise Unknown("events")
        return self.events.orderBy(F.desc("created_at")).limit(limit)
