"""Keyword search over chunks: basic, line and document modes, hits and groups, ranks and pages.

A query is planned on the driver: terms, variants, whether phrases are long enough for the trigram rule, and which term ranks. The
plan is one scan of the chunks with a predicate, joined with live documents, and where groups are asked for one
aggregation by document (partial first), so no window and no second shuffle.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.functions.snippet import snippet_column

HIT = ["match_id", "document_id", "page", "ordinal", "line", "text", "source", "rel_path", "title", "ext", "status", "searchable_pdf"]


def live_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk rows with what searches need. Rows delivered twice are dropped by `once`, after the filters, so only hits are shuffled."""
    return chunks.select("id", "document_id", "page", "ordinal", "line", "text", "source").withColumn("lowered", F.lower("text"))


def once(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["id"])


def live_documents(documents: DataFrame, scope: str | None = None, document_id: str | None = None) -> DataFrame:
    """Documents that aren't deleted, within a path (ASCII case folded, % and _ as wildcards) or by id."""
    kept = documents.where(~F.col("deleted"))
    if document_id:
        kept = kept.where(F.col("id") == document_id)
    path = T.scope_path(scope)
    if path:
        kept = kept.where(T.ascii_fold(F.col("rel_path")).like(path.lower().replace("\\", "\\\\") + "/%"))
    return kept.select(F.col("id").alias("document_id"), "rel_path", "title", "ext", "status", "searchable_pdf", "updated_at")


def phrase_count(lowered: Column, phrase: str) -> Column:
    """Occurrences of a phrase, overlapping ones too."""
    return F.regexp_count(lowered, F.lit("(?=" + re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", phrase) + ")"))


def bm25(chunks: DataFrame, variants: list[str]) -> Column:
    """Score by the whole corpus's statistics, less is better: one row of counts is read, the rest is arithmetic."""
    phrases = [v.lower() for v in dict.fromkeys(variants)]
    size = F.greatest(F.length("text") - 2, F.lit(0))
    narrow = once(chunks.select("id", size.alias("size"), *(F.col("lowered").contains(p).alias(f"has{i}") for i, p in enumerate(phrases))))
    row = narrow.agg(F.count("*").alias("n_docs"), F.sum("size").alias("total"), *(F.count_if(F.col(f"has{i}")).alias(f"hit{i}") for i in range(len(phrases)))).first()
    n, mean = row["n_docs"], max((row["total"] or 0) / max(row["n_docs"], 1), 1e-9)
    score = F.lit(0.0)
    for i, p in enumerate(phrases):
        hit = row[f"hit{i}"]
        idf = max(log((n - hit + 0.5) / (hit + 0.5)), 1e-6)
        tf = phrase_count(F.col("lowered"), p).cast("double")
        score = score + F.lit(idf) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    return -score


def _long(term: list[str]) -> bool:
    return bool(term) and min(map(len, term)) >= T.TRIGRAM


@dataclass
class Plan:
    """The rows of a query, with `rank` (null on the LIKE path), and the variants to mark."""

    rows: DataFrame
    ranked: bool
    variants: list[str]
    single: bool


def plan(chunks: DataFrame, documents: DataFrame, query: str, mode: str = "basic", scope: str | None = None, document_id: str | None = None) -> Plan:
    base = live_chunks(chunks)
    owners = live_documents(documents, scope, document_id)
    mode = T.mode_name(mode)
    none = F.lit(None).cast("double")
    if mode == "basic":
        found = T.variants(query)
        ranked = bool(found) and len(found[0]) >= T.TRIGRAM
        test = T.phrase_any(F.col("lowered"), found) if ranked else T.like_any(F.col("text"), found)
        rank = bm25(base, found) if ranked else none
        hits = once(base.where(test)).withColumn("rank", rank).join(owners, "document_id")
        return Plan(hits, ranked, found, bool(document_id))
    terms = [T.variants(t) for t in T.query_terms(query)]
    flat = list(dict.fromkeys(v for t in terms for v in t))
    if not terms:
        return Plan(base.where(F.lit(False)).withColumn("rank", none).join(owners, "document_id"), False, [], bool(document_id))
    if mode != "document":
        every = functools.reduce(lambda a, b: a & b, [T.like_any(F.col("text"), t) for t in terms])
        long = [t for t in terms if _long(t)]
        if not long:
            return Plan(once(base.where(every)).withColumn("rank", none).join(owners, "document_id"), False, flat, bool(document_id))
        lead = max(long, key=lambda t: max(map(len, t)))  # the first of the longest; it alone ranks
        hits = once(base.where(T.phrase_any(F.col("lowered"), lead) & every)).withColumn("rank", bm25(base, lead))
        return Plan(hits.join(owners, "document_id"), True, flat, bool(document_id))
    # Document mode: one flag a term, or-ed within each document in a single aggregation.
    ranked = all(map(_long, terms))
    tests = [T.phrase_any(F.col("lowered"), t) if _long(t) else T.like_any(F.col("text"), t) for t in terms]
    either = functools.reduce(lambda a, b: a | b, tests)
    flagged = base.where(either)
    whole = flagged.groupBy("document_id").agg(*(F.bool_or(t).alias(f"t{i}") for i, t in enumerate(tests)))
    held = whole.where(functools.reduce(lambda a, b: a & b, [F.col(f"t{i}") for i in range(len(tests))])).select("document_id")
    shown = T.phrase_any(F.col("lowered"), flat) if ranked else functools.reduce(lambda a, b: a | b, [T.like_any(F.col("text"), t) for t in terms])
    rank = bm25(base, flat) if ranked else none
    hits = once(base.where(shown)).withColumn("rank", rank).join(held, "document_id", "left_semi").join(owners, "document_id")
    return Plan(hits, ranked, flat, bool(document_id))



def _place() -> list[Column]:
    return [F.coalesce("page", F.lit(0)), F.col("ordinal"), F.col("match_id")]


def hits(p: Plan) -> DataFrame:
    """All hits in order: by position in one document, else by rank, else by the document's last change."""
    rows = p.rows.withColumnRenamed("id", "match_id")
    order = _place() if p.single else [F.asc("rank"), *_place()] if p.ranked else [F.desc("updated_at"), *_place()]
    return rows.orderBy(*order).select(*HIT, "rank", "updated_at")


def groups(p: Plan) -> DataFrame:
    """A row a document: number of hits, best rank, and the first hit by position."""
    rows = p.rows.withColumnRenamed("id", "match_id")
    first = F.min_by(F.struct("match_id", "page", "ordinal", "line", "text", "source"), F.struct(F.coalesce("page", F.lit(0)).alias("p"), "ordinal", "match_id"))
    kept = ["document_id", "rel_path", "title", "ext", "status", "searchable_pdf", "updated_at"]
    grouped = rows.groupBy(*kept).agg(F.count("*").alias("match_count"), F.min("rank").alias("best_rank"), first.alias("first"))
    order = [F.desc("match_count"), *([F.asc("best_rank")] if p.ranked else []), F.desc("updated_at"), F.asc("document_id")]
    return grouped.orderBy(*order).select("first.*", *kept, "match_count", "best_rank")


def page_of(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page and a row more, which tells whether there is another."""
    return df.offset(offset).limit(limit + 1)


def with_snippets(df: DataFrame, variants: list[str]) -> DataFrame:
    return df.withColumn("snippet", snippet_column(F.col("text"), variants))


def envelope(df: DataFrame, limit: int, offset: int, key: str = "results") -> dict:
    """A page as the service returns it. At most limit + 1 rows are read."""
    rows = [r.asDict(recursive=True) for r in page_of(df, limit, offset).collect()]
    more, rows = len(rows) > limit, rows[:limit]
    return {key: rows, "count": offset + len(rows) + more, "returned_count": len(rows), "offset": offset, "limit": limit, "has_more": more, "next_offset": offset + len(rows) if more else None}


def text_context(chunks: DataFrame, document_id: str, match_id: int | None = None, radius: int = 8) -> DataFrame:
    """Chunks around a match by ordinal, or the first 300 of the document."""
    rows = once(live_chunks(chunks).where(F.col("document_id") == document_id)).drop("lowered")
    if match_id is None:
        return rows.orderBy("page", "ordinal", "id").limit(300)
    centre = rows.where(F.col("id") == match_id).select(F.col("document_id"), F.col("ordinal").alias("centre"))
    near = rows.join(F.broadcast(centre), "document_id").where(F.col("ordinal").between(F.greatest(F.col("centre") - radius, F.lit(0)), F.col("centre") + radius))
    return near.drop("centre").orderBy("page", "ordinal", "id")


def page_chunks(chunks: DataFrame, document_id: str, page: int) -> DataFrame:
    return once(live_chunks(chunks).drop("lowered").where((F.col("document_id") == document_id) & (F.col("page") == page))).orderBy("ordinal", "id")


def append_page(shown: DataFrame, page: DataFrame, key: str = "match_id") -> DataFrame:
    """Rows shown so far and those of a further page that are not among them."""
    return shown.unionByName(page.join(shown.select(key), key, "left_anti").select(shown.columns))
