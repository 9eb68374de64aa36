"""Queries of the text operators: name -> (spark, folder of the tables) -> DataFrame, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import boilerplate, encodings, lookalike, neardup, packing, scans, split, subjects, tokenize, vectorgraph
from leafline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(function: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, folder: function(*(table(spark, folder, n) for n in names))


def _ids_text(documents: DataFrame) -> DataFrame:
    return tokenize.corpus_text(tokenize.corpus_ids(documents))


def _piece_sizes(chunks: DataFrame) -> DataFrame:
    return split.split_texts(chunks).groupBy("chunk_id").agg(F.count("*").alias("pieces"), F.max(F.length("text")).alias("longest"))


def _fill(documents: DataFrame) -> DataFrame:
    held = packing.pack(documents).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return held.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on(lookalike.lookalike_pairs, "chunks"),
        "p1_lines": _on(lookalike.canonical_lines, "chunks"),
        "p2_found": _on(vectorgraph.close_pairs, "chunk_embeddings"),
        "p2_neighbours": _on(vectorgraph.query_neighbours, "chunk_embeddings"),
        "p3_found": _on(split.oversized, "chunks"),
        "p3_pieces": _on(split.pieces_of_all, "chunks"),
        "p3_piece_sizes": _on(_piece_sizes, "chunks"),
        "p3_rejoined": _on(split.rejoined, "chunks"),
        "p4_found": _on(neardup.similar_documents, "chunks", "documents"),
        "p4_groups": _on(neardup.similar_groups, "chunks", "documents"),
        "p5_found": _on(scans.scan_defects, "chunks", "documents"),
        "p5_paragraphs": _on(scans.scan_paragraphs, "chunks", "documents"),
        "p6_found": _on(boilerplate.frequent_rows, "chunks", "documents"),
        "p6_documents": _on(boilerplate.cleaned_documents, "chunks", "documents"),
        "p7_found": _on(encodings.damaged_rows, "chunks"),
        "p7_restored": _on(encodings.restored_rows, "chunks"),
        "p8_ids": _on(tokenize.corpus_ids, "documents"),
        "p8_text": _on(_ids_text, "documents"),
        "p9_found": _on(packing.split_documents, "documents"),
        "p9_containers": _on(packing.pack, "documents"),
        "p9_fill": _on(_fill, "documents"),
        "p9_laid": _on(packing.laid_whole, "documents"),
        "p10_found": _on(subjects.document_subjects, "documents", "subject_labels", "subjects"),
        "p10_composition": _on(subjects.corpus_composition, "documents", "subject_labels", "subjects"),
    }


# Problem 4 by its definition: every pair of documents with a common sequence, and their exact share.
_SHARES = r"""
  c AS (SELECT DISTINCT id, document_id, ordinal, text FROM chunks WHERE text IS NOT NULL),
  t AS (SELECT d.doc_id, lower(string_agg(c.text, ' ' ORDER BY c.ordinal, c.id)) AS s FROM c JOIN documents d ON d.id = c.document_id GROUP BY d.doc_id),
  w AS (SELECT doc_id, regexp_extract_all(regexp_replace(s, '([\x{3400}-\x{9FFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS w FROM t),
  e AS (SELECT DISTINCT doc_id, hash(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
  n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
  m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
  p AS (SELECT a AS doc_id_a, b AS doc_id_b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.6 * (x.n + y.n - k))"""


# Problem 6 by its definition.
_FREQUENT = r"""
  lines AS (
              SELECT c.id, c.document_id, d.source, regexp_replace(lower(c.text), '[^\p{L}]+', '', 'g') AS k
              FROM chunks c JOIN documents d ON d.id = c.document_id WHERE d.source IS NOT NULL),
            base AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
            often AS (
              SELECT l.source, l.k FROM lines l JOIN base b ON b.source = l.source WHERE length(l.k) >= 10
              GROUP BY l.source, l.k, b.n HAVING count(DISTINCT l.document_id) >= 4 AND count(DISTINCT l.document_id) >= 0.05 * b.n),
  bad AS (SELECT DISTINCT l.id AS chunk_id FROM lines l JOIN often o ON o.source = l.source AND o.k = l.k)"""


def oracle_sql() -> dict[str, str]:
    """What SQL expresses without repeating the operator: definitions where they are short, else invariants and round trips."""
    return {
        "p4_found": f"WITH {_SHARES} SELECT doc_id_a, doc_id_b FROM p",
        "p4_groups": f"""
            WITH RECURSIVE {_SHARES},
              l AS (SELECT doc_id_a AS x, doc_id_b AS y FROM p UNION ALL SELECT doc_id_b, doc_id_a FROM p),
              r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
            SELECT x AS doc_id, min(y) AS group_id, (SELECT count(*) FROM l WHERE l.x = r.x) AS links FROM r GROUP BY x""",
        "p3_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(text) > 600",
        "p6_found": f"WITH {_FREQUENT} SELECT chunk_id FROM bad",
        # Every text with a token is laid whole and no container is overfull: an invariant of the packing.
        "p9_laid": "SELECT doc_id, true AS whole, true AS fits FROM documents WHERE length(text) > 0",
        # Pieces put together again are the text, and none is too long.
        "p3_rejoined": "SELECT DISTINCT id AS chunk_id, text, true AS fits FROM chunks WHERE length(text) > 600",
        "p6_documents": rf"""WITH {_FREQUENT}
            SELECT document_id, CAST(floor(coalesce(ordinal, 0) / 4096) AS INTEGER) AS part, string_agg(text, chr(10) ORDER BY ordinal, id) AS text
            FROM (SELECT DISTINCT id, document_id, ordinal, text FROM chunks) WHERE text IS NOT NULL AND id NOT IN (SELECT chunk_id FROM bad) GROUP BY ALL""",
        "p8_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
