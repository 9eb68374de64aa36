"""Recognition of scanned pages by a service: pages in batches, each submitted, polled and fetched by an injected client.

A batch is one row and one task's work; its outcome is a row too, so what is done is a table: a later run asks only for batches without a result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.operators.remote import RemoteError, retried
from leafline.sources.extract import parse_ocr

PAGES = 100
_DONE = "document_id string, batch int, first_page int, job string, value string, error string"


class Client(Protocol):
    """What a recogniser must offer; calls raise RemoteError."""

    def submit(self, document_id: str, first_page: int, last_page: int) -> str: ...

    def poll(self, job: str) -> tuple[str, str]:
        """(state, address or message): pending, running, done or failed."""

    def fetch(self, address: str) -> str: ...


def batches(documents: DataFrame, pages: int = PAGES) -> DataFrame:
    """(document_id, batch, first_page, last_page) of documents with pages (id, page_count)."""
    count = F.ceil(F.col("page_count") / pages).cast("int")
    rows = documents.where("id is not null and page_count > 0").select(F.col("id").alias("document_id"), "page_count", F.explode(F.sequence(F.lit(0), count - 1)).alias("batch"))
    return rows.select("document_id", "batch", (F.col("batch") * pages + 1).alias("first_page"), F.least((F.col("batch") + 1) * pages, F.col("page_count")).cast("int").alias("last_page"))


def pending(asked: DataFrame, done: DataFrame) -> DataFrame:
    """Batches without a result yet: where an interrupted run goes on."""
    return asked.join(done.where("value is not null").select("document_id", "batch"), ["document_id", "batch"], "left_anti")


def _result(client: Client, job: str, wait: float, most: float, sleep: Callable[[float], None]) -> str:
    end = time.monotonic() + most
    while time.monotonic() <= end:
        state, told = retried(lambda: client.poll(job), sleep=sleep)
        if state == "done":
            if not told:
                raise RemoteError(f"{job} is done without a result")
            return retried(lambda: client.fetch(told), sleep=sleep)
        if state == "failed":
            raise RemoteError(told or "recognition failed")
        if state not in ("pending", "running", ""):
            raise RemoteError(f"unknown state {state!r}")
        sleep(wait)
    raise RemoteError(f"{job} timed out")


def recognise(asked: DataFrame, client: Client, jobs: DataFrame | None = None, wait: float = 5.0, most: float = 7200.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(document_id, batch, first_page, job, value, error): the service's lines of each batch, or the error of a batch that failed.

    `jobs` (document_id, batch, job) are batches submitted before: they are polled, not submitted again.
    """
    known = asked.withColumn("job", F.lit(None).cast("string")) if jobs is None else asked.join(jobs.select("document_id", "batch", "job"), ["document_id", "batch"], "left")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                job, value, error = r["job"], None, None
                try:
                    job = job or retried(lambda r=r: client.submit(r["document_id"], r["first_page"], r["last_page"]), sleep=sleep)
                    value = _result(client, job, wait, most, sleep)
                except Exception as fault:
                    error = f"{type(fault).__name__}: {fault}"
                out.append((r["document_id"], r["batch"], r["first_page"], job, value, error))
            yield pd.DataFrame(out, columns=["document_id", "batch", "first_page", "job", "value", "error"])

    return known.select("document_id", "batch", "first_page", "last_page", "job").mapInPandas(work, _DONE)


def recognised_lines(results: DataFrame) -> DataFrame:
    """(document_id, page, seq, item, text, score, bbox): lines of all batches, with pages counted within the document."""
    line = F.posexplode(F.split("value", "\n")).alias("seq", "value")
    rows = results.where("value is not null").select("document_id", "batch", "first_page", line)
    keyed = rows.select(F.concat_ws("\x1f", "document_id", F.col("first_page").cast("string")).alias("document_id"), F.col("seq").cast("int").alias("seq"), "value")
    parts = F.split("document_id", "\x1f")
    read = parse_ocr(keyed)
    return read.select(parts[0].alias("document_id"), (F.col("page") + parts[1].cast("int") - 1).alias("page"), "seq", "item", "text", "score", "bbox")
