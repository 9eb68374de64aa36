"""Problem 6: lines that one source repeats in many of its documents.

A line's key is its letters alone in lower case; keys of fewer than 10 letters do not count. Documents
are counted once per key before the join with their source, so the hot document and copies shrink map-side, and
the few frequent keys are joined back to the rows (AQE broadcasts them only if their measured size allows).

Cases: null source or text: never frequent; rows delivered twice count once; empty tables give no row;
documents unknown to the documents table have no source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS, LEAST_DOCUMENTS, LEAST_SHARE = 10, 4, 0.05
BLOCK = 4096


def line_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", "")


def _keyed(chunks: DataFrame) -> DataFrame:
    keyed = chunks.select("id", "document_id", "ordinal", "text", line_key(F.col("text")).alias("key"))
    return keyed.where(F.length("key") >= LETTERS).withColumn("kh", F.xxhash64("key"))


def frequent_lines(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, key_hash, key_check, documents, share): lines found in enough documents of their source."""
    owners = documents.where(F.col("source").isNotNull()).select(F.col("id").alias("document_id"), "source")
    base = owners.groupBy("source").agg(F.count("*").alias("base"))
    once = _keyed(chunks).select("document_id", F.col("kh").alias("key_hash"), F.xxhash64(F.lit(3), "key").alias("key_check")).distinct()
    counts = once.join(owners, "document_id").groupBy("source", "key_hash", "key_check").agg(F.count("*").alias("documents"))
    share = (F.col("documents") / F.col("base")).alias("share")
    return (
        counts.where(F.col("documents") >= LEAST_DOCUMENTS)
        .join(base, "source")
        .where(F.col("documents") >= LEAST_SHARE * F.col("base"))
        .select("source", "key_hash", "key_check", "documents", share)
    )


def frequent_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id): every chunk row whose line is frequent in its source."""
    often = frequent_lines(chunks, documents).select("source", "key_hash", "key_check")
    rows = _keyed(chunks).select("id", "document_id", F.col("kh").alias("key_hash"), F.xxhash64(F.lit(3), "key").alias("key_check"))
    owners = documents.where(F.col("source").isNotNull()).select(F.col("id").alias("document_id"), "source")
    keys = often.select("key_hash", "key_check").distinct()
    likely = rows.join(keys, ["key_hash", "key_check"], "left_semi")
    met = likely.join(owners, "document_id").join(often, ["source", "key_hash", "key_check"], "left_semi")
    return met.select(F.col("id").alias("chunk_id")).distinct()


def cleaned_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, part, text): every document without its frequent lines.

    Parts are blocks of BLOCK ordinals, so a document of any size is rebuilt in bounded groups.
    """
    bad = frequent_rows(chunks, documents)
    kept = chunks.select("id", "document_id", "ordinal", "text").where(F.col("text").isNotNull()).join(bad, F.col("id") == F.col("chunk_id"), "left_anti")
    lines = kept.withColumn("part", F.floor(F.coalesce(F.col("ordinal"), F.lit(0)) / BLOCK).cast("int"))
    # Rows delivered twice are equal, so they drop out of the gathered block and the texts are shuffled once.
    ordered = F.array_distinct(F.array_sort(F.collect_list(F.struct("ordinal", "id", "text"))))
    return lines.groupBy("document_id", "part").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
