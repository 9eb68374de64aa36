"""Publication details of documents: first and last pages to a language model, its reply to a citation, saved with the document."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.operators.remote import retried

FIELDS = ("author_or_editor", "title", "publisher", "publication_time", "citation")
_INFO = "has_publication_info boolean, " + ", ".join(f"{f} string" for f in FIELDS) + ", evidence string"
_FOUND = "document_id string, status string, info string, error string"


def payloads(chunks: DataFrame, most: int = 24_000) -> DataFrame:
    """(document_id, payload): what is asked about; empty where a document has no text on its first and last pages."""
    pages = T.page_window(chunks.dropDuplicates(["id"]))
    blank = (F.trim("first_text") == "") & (F.trim("last_text") == "")
    return pages.select("document_id", F.when(blank, F.lit("")).otherwise(T.payload(F.col("first_text"), F.col("last_text"), most)).alias("payload"))


def ask(asked: DataFrame, model: Callable[[str], str] | None) -> DataFrame:
    """(document_id, status, info, error) by a model that answers a text with a reply that holds a JSON object.

    Without a model the status is missing_key, without text no_info; a failing call or reply is a row with its error.
    """
    if model is None:
        none = F.lit(None).cast("string")
        return asked.select("document_id", F.lit("missing_key").alias("status"), none.alias("info"), none.alias("error"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text in zip(frame["document_id"], frame["payload"]):
                if not (text or "").strip():
                    out.append((doc, "no_info", json.dumps({"has_publication_info": False}), None))
                    continue
                try:
                    info = T.json_object(retried(lambda t=text: model(t)))
                    out.append((doc, "ready" if info.get("has_publication_info") else "no_info", json.dumps(info, ensure_ascii=False), None))
                except Exception as fault:
                    out.append((doc, "error", None, f"{type(fault).__name__}: {fault}"))
            yield pd.DataFrame(out, columns=["document_id", "status", "info", "error"])

    return asked.select("document_id", "payload").mapInPandas(work, _FOUND)


def cited(found: DataFrame) -> DataFrame:
    """With a `citation` made from the reply where there is something to cite."""
    info = F.from_json("info", _INFO)
    return found.withColumn("citation", F.when(F.col("status") == "ready", T.citation(info)))


def saved(documents: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Documents with publication_status, publication_info (JSON; an error is merged into it), citation and the time of the check."""
    kept = F.when(F.col("error").isNull(), F.col("info")).otherwise(
        F.to_json(F.map_concat(F.coalesce(F.from_json("info", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("error"), F.col("error"))))
    )
    new = found.select(F.col("document_id").alias("id"), F.col("status").alias("p_status"), kept.alias("p_info"), F.col("citation").alias("p_citation"))
    hit = F.col("p_status").isNotNull()
    changes = {"publication_status": "p_status", "publication_info": "p_info", "citation": "p_citation"}
    met = documents.join(new, "id", "left")
    out = {name: F.when(hit, F.col(c)).otherwise(F.col(name) if name in documents.columns else F.lit(None).cast("string")) for name, c in changes.items()}
    out["publication_checked_at"] = F.when(hit, now).otherwise(F.col("publication_checked_at") if "publication_checked_at" in documents.columns else F.lit(None).cast("timestamp"))
    out["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return met.withColumns(out).drop("p_status", "p_info", "p_citation")


def published(chunks: DataFrame, documents: DataFrame, model: Callable[[str], str] | None, now: Column, most: int = 24_000) -> DataFrame:
    """The whole way: pages, payload, reply, citation, documents."""
    return saved(documents, cited(ask(payloads(chunks, most), model)), now)
