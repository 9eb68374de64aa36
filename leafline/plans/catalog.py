"""Queries of the search engine: name -> (spark, folder of the tables) -> DataFrame, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions import geometry as G
from leafline.functions import text as T
from leafline.operators import ingest, jobs, publication, remote, search, stats, vectors, workers
from leafline.session import table
from leafline.sources import extract, ocr
from leafline.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
MODEL, DIM = "lumen-small", 64
NOW = "2026-01-01 00:00:00"

# SQL ------------------------------------------------------------------------------------------------------------------------
CH = "ch AS (SELECT DISTINCT ON (id) id, document_id, page, ordinal, line, text, source, lower(text) AS lt FROM chunks)"
DOCS = "d AS (SELECT id AS document_id, rel_path, title, ext, status, updated_at FROM documents WHERE NOT deleted)"
JOBS = """lj AS (
  SELECT id, CASE WHEN stop IS NULL THEN last ELSE stop END AS v FROM (
    SELECT id, arg_max(s, k) AS last, arg_max(s, k) FILTER (WHERE status = 'cancelled') AS stop FROM (
      SELECT id, status, struct_pack(u := updated_at, st := status) AS k, struct_pack(document_id := document_id, type := type, status := status, priority := priority,
        created_at := created_at, updated_at := updated_at) AS s FROM jobs) GROUP BY id)),
  j AS (SELECT id, v.document_id AS document_id, v.type AS type, v.status AS status, v.priority AS priority, v.created_at AS created_at, v.updated_at AS updated_at FROM lj)"""
EMB = """e AS (SELECT chunk_id, v.document_id AS document_id, v.dim AS dim, v.model AS model, v.vector AS vector FROM (
  SELECT chunk_id, arg_max(struct_pack(document_id := document_id, dim := dim, model := model, vector := vector), updated_at) AS v FROM chunk_embeddings GROUP BY chunk_id))"""
USE = f"""u AS (SELECT chunk_id, document_id, list_transform(vector, lambda x: x::DOUBLE) AS v FROM e WHERE model = '{MODEL}' AND dim = {DIM} AND len(vector) = {DIM}
    AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0)))"""
UNIT = "n AS (SELECT chunk_id, document_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS x FROM u)"
WS = r"[\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rank(phrase: str) -> str:
    p = _quoted(phrase.lower())
    tf = f"len(list_filter(range(1, length(lt) + 1), lambda i: substr(lt, i, length({p})) = {p}))"
    return f"""st AS (SELECT count(*) AS nn, sum(greatest(length(text) - 2, 0)) / count(*) AS av, count(*) FILTER (WHERE contains(lt, {p})) AS nh FROM ch),
      r AS (SELECT ch.*, -(greatest(ln((nn - nh + 0.5) / (nh + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(length(text) - 2, 0) / av))) AS rank
        FROM (SELECT *, {tf}::DOUBLE AS tf FROM ch WHERE contains(lt, {p})) ch, st)"""


def _like(col: str, *terms: str) -> str:
    fold = f"translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return " AND ".join(f"{fold} LIKE {_quoted('%' + t.lower() + '%')}" for t in terms)


HITS = "SELECT r.id AS match_id, r.document_id, r.page, r.ordinal, {rank} AS score FROM r JOIN d USING (document_id)"


def _groups(ranked: bool, tail: str = "") -> str:
    best = "round(min(rank), 6)" if ranked else "CAST(NULL AS DOUBLE)"
    return f"""SELECT document_id, count(*) AS match_count, {best} AS score,
      arg_min(r.id, struct_pack(p := coalesce(page, 0), o := ordinal, i := r.id)) AS match_id FROM r JOIN d USING (document_id) GROUP BY document_id, updated_at {tail}"""


# Plans ----------------------------------------------------------------------------------------------------------------------
PHRASE, SHORT, WILD, LINE, DOCUMENT, MIXED = "well-known", "né", "ø_", "emperor treaty", "plaintiff tribunal", "treaty né"


def _plan(query: str, mode: str = "basic", **kw):
    return lambda s, d: search.plan(table(s, d, "chunks"), table(s, d, "documents"), query, mode, **kw)


def _hits(query: str, mode: str = "basic", **kw) -> Query:
    make = _plan(query, mode, **kw)
    return lambda s, d: search.hits(make(s, d)).select("match_id", "document_id", "page", "ordinal", F.round("rank", 6).alias("score"))


def _grouped(query: str, mode: str = "basic", limit: int | None = None, offset: int = 0, **kw) -> Query:
    make = _plan(query, mode, **kw)

    def run(s: SparkSession, d: str) -> DataFrame:
        g = search.groups(make(s, d))
        g = g if limit is None else search.page_of(g, limit, offset)
        return g.select("document_id", "match_count", F.round("best_rank", 6).alias("score"), "match_id")

    return run


def _chunk_lines(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("ordinal", "x"))
    return rows.select("doc_id", "ordinal", F.col("x.line").alias("line"), F.col("x.text").alias("text"))


def _text_stats(s: SparkSession, d: str) -> DataFrame:
    return ingest.document_counts(table(s, d, "chunks"))


def _jobs(s: SparkSession, d: str) -> DataFrame:
    return jobs.latest(table(s, d, "jobs"))


def _query_vector(s: SparkSession, d: str) -> list[float]:
    """The unit vector of the usable chunk with the least id: the query of the vector searches."""
    units = vectors.usable(table(s, d, "chunk_embeddings"), MODEL, DIM).orderBy("chunk_id").limit(1)
    return list(units.select(vectors.unit(F.col("vector"), DIM).alias("u")).first()["u"])


def _exact(s: SparkSession, d: str) -> DataFrame:
    return vectors.exact(table(s, d, "chunk_embeddings"), MODEL, DIM, _query_vector(s, d))


def _scored(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", "document_id", F.round("match_score", 5).alias("score"))


def _four_bit(s: SparkSession, d: str) -> DataFrame:
    return vectors.search(*vectors.build_index(table(s, d, "chunk_embeddings"), MODEL, DIM), _query_vector(s, d), 50)


def _units(s: SparkSession, d: str) -> DataFrame:
    return vectors.usable(table(s, d, "chunk_embeddings"), MODEL, DIM).select("chunk_id", vectors.unit(F.col("vector"), DIM).alias("unit"))


def _codes(s: SparkSession, d: str) -> DataFrame:
    index, _, _ = vectors.build_index(table(s, d, "chunk_embeddings"), MODEL, DIM)
    total = F.aggregate("codes", F.lit(0), lambda a, x: a + x.cast("int")).cast("bigint")
    return index.select("chunk_id", total.alias("code_sum"), F.array_max("codes").cast("bigint").alias("code_max"))


def _snapshot(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents as state, and a later snapshot: without status deleted ones, every third file touched by its size's rule."""
    state = table(s, d, "documents")
    snap = state.where("status <> 'empty'").select("id", "path", "rel_path", "title", "ext", F.when(F.col("ext") == ".md", F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime", "sha256")
    return state, snap


def _transition(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return ingest.transition(*_snapshot(s, d), F.lit(NOW).cast("timestamp"), 100_000_000)


def _ocr_rows(s: SparkSession, d: str) -> DataFrame:
    """The scanned rows written as the rows of a recogniser's result, and read again."""
    rows = table(s, d, "chunks").dropDuplicates(["id"]).where("source = 'ocr' and bbox is not null")
    result = F.struct(F.array(F.struct(F.struct(F.array("text").alias("rec_texts"), F.array("bbox").alias("rec_polys"), "page").alias("prunedResult"))).alias("ocrResults"))
    return rows.select("document_id", F.col("id").cast("int").alias("seq"), F.to_json(F.struct(result.alias("result"))).alias("value"))


def _html(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "documents").where("text is not null")
    body = F.concat(F.lit("<html><head><style>p{}</style></head><body><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"),
                    F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))
    return pages.select("doc_id", extract.html_text_column(body).alias("text"))


def _rects(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks").dropDuplicates(["id"]).where("bbox is not null")
    x, y = G.extent(F.col("bbox"))
    r = G.page_rect(F.col("bbox"), F.lit(1000.0), F.lit(1400.0), 500.0, 700.0)
    return rows.select("id", x.alias("max_x"), y.alias("max_y"), r.alias("r")).select("id", "max_x", "max_y", *(F.round(f"r.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


def _resolutions(s: SparkSession, d: str) -> DataFrame:
    """Resolution and progress of pages whose sides, in points, are made from the documents' sizes."""
    width, height = (F.col("size") % 3000 + 300).cast("double"), (F.col("size") % 4100 + 400).cast("double")
    dpi = G.page_dpi(width, height, F.col("page_count"))
    done = F.round(stats.progress(F.col("page_count") / 2, F.col("page_count")), 6)
    return table(s, d, "documents").where("page_count > 0").select("doc_id", dpi.alias("dpi"), done.alias("progress"))


def _citations(s: SparkSession, d: str) -> DataFrame:
    info = F.struct(F.col("source").alias("author_or_editor"), "title", F.col("lang").alias("publisher"), F.date_format("created_at", "yyyy").alias("publication_time"), F.lit(None).cast("string").alias("citation"))
    return table(s, d, "documents").select("doc_id", T.citation(info).alias("citation"))


def _on(function: Callable[..., DataFrame], *names: str) -> Query:
    return lambda s, d: function(*(table(s, d, n) for n in names))


def queries() -> dict[str, Query]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "chunk_lines": _chunk_lines,
        "doc_text_stats": _text_stats,
        "normalize_text": lambda s, d: table(s, d, "chunks").dropDuplicates(["id"]).select("id", T.normalized(F.col("text")).alias("text")),
        "search_basic_fts": _hits(PHRASE),
        "search_basic_like": _hits(SHORT),
        "search_wildcard_like": _hits(WILD),
        "search_groups_basic": _grouped(PHRASE),
        "search_groups_like": _grouped(SHORT),
        "search_groups_page2": _grouped(PHRASE, limit=10, offset=10),
        "search_line_mode": _hits(LINE, "line"),
        "search_line_groups": _grouped(LINE, "line"),
        "search_document_mode": _hits(DOCUMENT, "document"),
        "search_document_groups": _grouped(DOCUMENT, "document"),
        "search_document_like_mix": _hits(MIXED, "document"),
        "search_scoped": _hits(PHRASE, scope="Alder-Depot"),
        "snippets": lambda s, d: (lambda p: search.with_snippets(search.page_of(search.hits(p), 50), p.variants).select("match_id", "snippet"))(_plan(PHRASE)(s, d)),
        "text_context_radius": lambda s, d: (lambda p: search.text_context(table(s, d, "chunks"), *p).select("id", "ordinal", "text"))(
            tuple(table(s, d, "chunks").groupBy("document_id").agg(F.min_by("id", F.struct("ordinal", "id")).alias("i")).orderBy("document_id").limit(1).first())
        ),
        "vec_topk_exact": lambda s, d: _scored(_exact(s, d).limit(20)),
        "vec_all_exact": lambda s, d: _scored(_exact(s, d)),
        "vec_groups": lambda s, d: vectors.fuzzy_groups(_exact(s, d)).select("document_id", "match_count", F.round("match_score", 5).alias("score")),
        "vec_l2_normalize": lambda s, d: _units(s, d).select("chunk_id", F.posexplode("unit").alias("d", "x")).select("chunk_id", F.col("d").cast("bigint").alias("d"), F.round("x", 6).alias("x")),
        "vec_ranges_4bit": lambda s, d: vectors.ranges(_units(s, d)).select(F.col("d").cast("bigint").alias("d"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high")),
        "vec_quantize_4bit": _codes,
        "vec_topk_4bit": lambda s, d: _scored(_four_bit(s, d)),
        "vec_topk_scoped_postfilter": lambda s, d: _scored(_four_bit(s, d).join(search.live_documents(docs(s, d), "alder-depot").select("document_id"), "document_id", "left_semi")),
        "embed_missing": lambda s, d: vectors.missing(table(s, d, "chunks"), table(s, d, "chunk_embeddings"), MODEL, DIM).select("id", "document_id"),
        "embed_eligible_docs": lambda s, d: vectors.eligible(docs(s, d), table(s, d, "chunk_embeddings"), MODEL, DIM),
        "embed_batch_packing": _on(vectors.batches, "chunks"),
        "vector_stats": lambda s, d: stats.vectors(docs(s, d), _jobs(s, d), table(s, d, "chunk_embeddings"), MODEL, DIM),
        "library_stats": _on(stats.library, "documents"),
        "job_stats": lambda s, d: stats.job_counts(_jobs(s, d), docs(s, d)),
        "running_job": lambda s, d: stats.running_job(_jobs(s, d), docs(s, d)).select("id", "document_id", "status"),
        "job_states": lambda s, d: _jobs(s, d).select("id", "document_id", "type", "status", "updated_at"),
        "latest_job": lambda s, d: jobs.latest_of_document(_jobs(s, d)),
        "claim_order": lambda s, d: jobs.claim_order(_jobs(s, d), docs(s, d)).select("id", "document_id", "priority", "created_at"),
        "enqueue_dedupe": lambda s, d: jobs.enqueue(_jobs(s, d), docs(s, d).select(F.col("id").alias("document_id"), F.lit("index").alias("type"), F.lit(100).alias("priority"), F.lit(None).cast("string").alias("message")), F.lit(NOW).cast("timestamp")).select("document_id", "type", "status", "priority"),
        "recover_jobs": lambda s, d: jobs.recover(_jobs(s, d), docs(s, d), F.lit(NOW).cast("timestamp")).select("id", "status"),
        "cancel_vector_jobs": lambda s, d: jobs.cancel_vectors(_jobs(s, d), docs(s, d), "stop", F.lit(NOW).cast("timestamp")).select("id", "status", "progress", "error"),
        "failed_docs": lambda s, d: jobs.failed(docs(s, d)).select("id", "status", "updated_at"),
        "retry_candidates": lambda s, d: jobs.retry_candidates(docs(s, d), _jobs(s, d)).select("id", "status"),
        "recent_jobs": lambda s, d: jobs.recent(_jobs(s, d), docs(s, d)).select("id", "document_id", "status", "updated_at"),
        "recent_events": lambda s, d: table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "event_type", "ts"),
        "snapshot_diff": lambda s, d: _transition(s, d)["documents"].select("id", "change", "status", "size", "deleted"),
        "snapshot_events": lambda s, d: _transition(s, d)["events"].groupBy("type").agg(F.count("*").alias("n")),
        "soft_delete": lambda s, d: ingest.without_documents(table(s, d, "chunks").dropDuplicates(["id"]), _transition(s, d)["drop_chunks"]).groupBy("document_id").agg(F.count("*").alias("n")),
        "categories": _on(ingest.categories, "documents"),
        "path_exclusion": lambda s, d: docs(s, d).where(~ingest.excluded(F.col("rel_path"), ["old", "misc"], ["register", "alder-depot/a"])).select("id", "rel_path"),
        "doc_id_sha1": lambda s, d: docs(s, d).select("id", ingest.document_id(F.col("rel_path")).alias("made")),
        "extractor_route": lambda s, d: docs(s, d).select("id", extract.route(F.col("ext"), F.col("rel_path"), ["alder-depot"]).alias("route")),
        "quota_daily_usage": lambda s, d: stats.daily_usage(docs(s, d), table(s, d, "ocr_usage_daily")),
        "rate_window_60s": lambda s, d: stats.rate_window(table(s, d, "events"), F.col("user_id")),
        "debounce_sessions": lambda s, d: flows.debounced(table(s, d, "events"), gap="30 seconds", keys=["event_type"]),
        "html_to_text": _html,
        "ocr_jsonl_parse": lambda s, d: extract.parse_ocr(_ocr_rows(s, d)).select("document_id", F.col("seq").cast("bigint").alias("id"), F.col("page").cast("bigint").alias("page"), "text"),
        "bbox_to_rect": _rects,
        "citation_format": _citations,
        "publication_window": lambda s, d: T.page_window(table(s, d, "chunks").dropDuplicates(["id"])),
        "text_backfill": lambda s, d: workers.backfill(docs(s, d), table(s, d, "jobs"), F.lit(NOW).cast("timestamp"))[1].select("document_id", "type", "status", F.col("priority").cast("bigint").alias("priority")),
        "index_rebuild_due": lambda s, d: workers.rebuild_due(docs(s, d), table(s, d, "chunk_embeddings"), table(s, d, "jobs"), 0, MODEL, DIM),
        "ocr_batches": lambda s, d: ocr.batches(docs(s, d)),
        "error_classes": lambda s, d: table(s, d, "jobs").select(remote.error_class(F.col("error"), F.lit(None).cast("int")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
        "page_resolution": _resolutions,
        "payloads": lambda s, d: publication.payloads(table(s, d, "chunks")).select("document_id", F.length("payload").alias("size"), F.md5("payload").alias("sum")),
    }


def oracle_sql() -> dict[str, str]:
    line = LINE.split()
    doc = DOCUMENT.split()
    flagged = f"f AS (SELECT document_id FROM ch GROUP BY document_id HAVING bool_or(contains(lt, '{doc[0]}')) AND bool_or(contains(lt, '{doc[1]}')))"
    both = _rank(doc[0]).replace("st AS", "st1 AS").replace("r AS", "r1 AS").replace(", st)", ", st1)") + ", " + _rank(doc[1]).replace("st AS", "st2 AS").replace("r AS", "r2 AS").replace(", st)", ", st2)")
    doc_rows = f"WITH {CH}, {DOCS}, {flagged}, {both}, r AS (SELECT ch.*, coalesce(r1.rank, 0) + coalesce(r2.rank, 0) AS rank FROM ch LEFT JOIN r1 USING (id) LEFT JOIN r2 USING (id) WHERE (r1.id IS NOT NULL OR r2.id IS NOT NULL) AND ch.document_id IN (SELECT document_id FROM f)) "
    q = "q AS (SELECT x AS qx FROM n ORDER BY chunk_id LIMIT 1)"
    vec = f"WITH {EMB}, {USE}, {UNIT}, {q}, s AS (SELECT chunk_id, document_id, list_inner_product(x, qx) AS sc FROM n, q) "
    edges = "g AS (SELECT d, min(v) AS lo, max(v) AS hi FROM (SELECT unnest(range(64)) AS d, unnest(x) AS v FROM n) GROUP BY d)"
    code = "c AS (SELECT chunk_id, document_id, d, lo, hi, CASE WHEN hi = lo THEN 0 ELSE floor(15.0 * least(greatest((v - lo) / (hi - lo), 0), 1)) END AS k FROM (SELECT chunk_id, document_id, unnest(range(64)) AS d, unnest(x) AS v FROM n) JOIN g USING (d))"
    four = f"WITH {EMB}, {USE}, {UNIT}, {q}, {edges}, {code}, qq AS (SELECT unnest(range(64)) AS d, unnest(qx) AS qv FROM q), s AS (SELECT chunk_id, document_id, sum(qv * (lo + (k + 0.5) / 15 * (hi - lo))) AS sc FROM c JOIN qq USING (d) GROUP BY chunk_id, document_id ORDER BY sc DESC, chunk_id LIMIT 50) "
    scored = "SELECT chunk_id, document_id, round(sc, 5) AS score FROM s"
    change = """t AS (SELECT s.*, CASE WHEN status = 'empty' THEN CASE WHEN deleted THEN 'gone' ELSE 'deleted' END
        WHEN nsize > 100000000 THEN CASE WHEN NOT (nsize <> size OR deleted) AND status = 'error' THEN 'same' ELSE 'oversize' END
        WHEN nsize <> size OR deleted THEN 'changed' ELSE 'same' END AS change
        FROM (SELECT *, CASE WHEN ext = '.md' THEN size + 1 ELSE size END AS nsize FROM documents) s)"""
    window = """pg AS (SELECT DISTINCT ON (id) * FROM chunks), mx AS (SELECT document_id, max(page) AS pages FROM pg WHERE page IS NOT NULL GROUP BY document_id),
      ln AS (SELECT pg.document_id, page, ordinal, id, '[p.' || page || '] ' || text AS t, pages FROM pg JOIN mx USING (document_id) WHERE page <= 5 OR page > pages - 5),
      pw AS (SELECT document_id, coalesce(string_agg(t, chr(10) ORDER BY page, ordinal, id) FILTER (WHERE page <= 5), '') AS first_text,
        coalesce(string_agg(t, chr(10) ORDER BY page, ordinal, id) FILTER (WHERE page > pages - 5), '') AS last_text FROM ln GROUP BY document_id)"""
    sides, area = "(size % 3000 + 300)", "((size % 3000 + 300) * (size % 4100 + 400))"
    lowered = f"greatest(96, least(asked, floor(sqrt(40000000.0 / {area}) * 72)))"
    return {
        "chunk_lines": rf"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS ordinal, CAST(line AS INTEGER) AS line, t AS text FROM (
            SELECT doc_id, line, trim(regexp_replace(replace(p, chr(0), ' '), '{WS}', ' ', 'g')) AS t FROM (
              SELECT doc_id, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS line FROM (
                SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{0085}}\x{{2028}}\x{{2029}}]') AS l FROM documents))) WHERE t <> ''""",
        "doc_text_stats": "SELECT document_id, count(*) AS chunk_count, CAST(sum(length(text)) AS BIGINT) AS text_chars, coalesce(max(page), 0) AS page_count FROM (SELECT DISTINCT ON (id) * FROM chunks) GROUP BY document_id",
        "normalize_text": rf"SELECT DISTINCT ON (id) id, trim(regexp_replace(replace(coalesce(text, ''), chr(0), ' '), '{WS}', ' ', 'g')) AS text FROM chunks",
        "search_basic_fts": f"WITH {CH}, {DOCS}, {_rank(PHRASE)} " + HITS.format(rank="round(rank, 6)"),
        "search_basic_like": f"WITH {CH}, {DOCS}, r AS (SELECT * FROM ch WHERE {_like('text', SHORT)}) " + HITS.format(rank="CAST(NULL AS DOUBLE)"),
        "search_wildcard_like": f"WITH {CH}, {DOCS}, r AS (SELECT * FROM ch WHERE {_like('text', WILD)}) " + HITS.format(rank="CAST(NULL AS DOUBLE)"),
        "search_groups_basic": f"WITH {CH}, {DOCS}, {_rank(PHRASE)} " + _groups(True),
        "search_groups_like": f"WITH {CH}, {DOCS}, r AS (SELECT * FROM ch WHERE {_like('text', SHORT)}) " + _groups(False),
        "search_groups_page2": f"WITH {CH}, {DOCS}, {_rank(PHRASE)} " + _groups(True, "ORDER BY match_count DESC, min(rank), updated_at DESC, document_id LIMIT 11 OFFSET 10"),
        "search_line_mode": f"WITH {CH}, {DOCS}, {_rank(line[0])}, x AS (SELECT * FROM r WHERE {_like('text', *line)}) " + HITS.format(rank="round(rank, 6)").replace("FROM r", "FROM x AS r"),
        "search_line_groups": f"WITH {CH}, {DOCS}, {_rank(line[0])}, x AS (SELECT * FROM r WHERE {_like('text', *line)}) " + _groups(True).replace("FROM r", "FROM x AS r"),
        "search_document_mode": doc_rows + HITS.format(rank="round(rank, 6)"),
        "search_document_groups": doc_rows + _groups(True),
        "search_document_like_mix": f"WITH {CH}, {DOCS}, f AS (SELECT document_id FROM ch GROUP BY document_id HAVING bool_or(contains(lt, 'treaty')) AND bool_or({_like('text', SHORT)})), r AS (SELECT * FROM ch WHERE ({_like('text', 'treaty')} OR {_like('text', SHORT)}) AND document_id IN (SELECT document_id FROM f)) " + HITS.format(rank="CAST(NULL AS DOUBLE)"),
        "search_scoped": f"WITH {CH}, {DOCS}, {_rank(PHRASE)} " + HITS.format(rank="round(rank, 6)") + " WHERE lower(rel_path) LIKE 'alder-depot/%'",
        "text_context_radius": f"WITH {CH}, m AS (SELECT document_id, ordinal AS o FROM ch ORDER BY document_id, ordinal, id LIMIT 1) SELECT ch.id, ch.ordinal, ch.text FROM ch JOIN m USING (document_id) WHERE ch.ordinal BETWEEN greatest(o - 8, 0) AND o + 8",
        "vec_topk_exact": vec + scored + " ORDER BY sc DESC, chunk_id LIMIT 20",
        "vec_all_exact": vec + scored,
        "vec_groups": vec + "SELECT document_id, count(*) AS match_count, round(max(sc), 5) AS score FROM s GROUP BY document_id",
        "vec_l2_normalize": f"WITH {EMB}, {USE}, {UNIT} SELECT chunk_id, unnest(range(64)) AS d, round(unnest(x), 6) AS x FROM n",
        "vec_ranges_4bit": f"WITH {EMB}, {USE}, {UNIT}, {edges} SELECT d, round(lo, 6) AS low, round(hi, 6) AS high FROM g",
        "vec_quantize_4bit": f"WITH {EMB}, {USE}, {UNIT}, {edges}, {code} SELECT chunk_id, CAST(sum(k) AS BIGINT) AS code_sum, CAST(max(k) AS BIGINT) AS code_max FROM c GROUP BY chunk_id",
        "vec_topk_4bit": four + scored,
        "vec_topk_scoped_postfilter": four + scored + " WHERE document_id IN (SELECT id FROM documents WHERE NOT deleted AND lower(rel_path) LIKE 'alder-depot/%')",
        "embed_missing": f"WITH {EMB} SELECT DISTINCT id, document_id FROM chunks WHERE id NOT IN (SELECT chunk_id FROM e WHERE model = '{MODEL}' AND dim = {DIM})",
        "embed_eligible_docs": f"WITH {EMB}, h AS (SELECT document_id, count(*) AS n FROM e WHERE model = '{MODEL}' AND dim = {DIM} GROUP BY document_id) SELECT id, chunk_count, coalesce(n, 0) AS embedded FROM documents LEFT JOIN h ON h.document_id = id WHERE NOT deleted AND text_chars > 0 AND chunk_count > 0 AND coalesce(n, 0) < chunk_count",
        "vector_stats": f"""WITH {EMB}, {JOBS}, h AS (SELECT document_id, count(*) AS n FROM e WHERE model = '{MODEL}' AND dim = {DIM} GROUP BY document_id),
            t AS (SELECT count(*) AS documents, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks, count(*) FILTER (WHERE coalesce(n, 0) >= chunk_count) AS embedded_documents
              FROM documents LEFT JOIN h ON h.document_id = id WHERE NOT deleted AND text_chars > 0 AND chunk_count > 0),
            m AS (SELECT j.* FROM j JOIN documents x ON x.id = j.document_id WHERE NOT x.deleted AND j.type = 'vector'),
            l AS (SELECT document_id, arg_max(status, id) AS last FROM m GROUP BY document_id)
            SELECT t.*, (SELECT count(*) FROM e WHERE model = '{MODEL}' AND dim = {DIM}) AS embeddings, (SELECT count(*) FROM m WHERE status = 'queued') AS queued,
              (SELECT count(*) FROM m WHERE status = 'processing') AS processing, (SELECT count(*) FROM l WHERE last = 'failed') AS failed FROM t""",
        "library_stats": "SELECT count(*) FILTER (WHERE NOT deleted) AS total, count(*) FILTER (WHERE NOT deleted AND status = 'ready') AS ready, count(*) FILTER (WHERE NOT deleted AND status IN ('queued', 'processing')) AS active, count(*) FILTER (WHERE NOT deleted AND status = 'error') AS errors, CAST(coalesce(sum(text_chars) FILTER (WHERE NOT deleted), 0) AS BIGINT) AS text_chars FROM documents",
        "job_stats": f"WITH {JOBS} SELECT count(*) FILTER (WHERE j.status = 'queued') AS queued, count(*) FILTER (WHERE j.status = 'processing') AS processing FROM j JOIN documents x ON x.id = j.document_id WHERE NOT x.deleted",
        "running_job": f"WITH {JOBS} SELECT j.id, j.document_id, j.status FROM j JOIN documents x ON x.id = j.document_id WHERE NOT x.deleted AND j.status IN ('queued', 'processing') ORDER BY (j.status = 'processing') DESC, j.updated_at DESC, j.id DESC LIMIT 1",
        "job_states": f"WITH {JOBS} SELECT id, document_id, type, status, updated_at FROM j",
        "latest_job": f"WITH {JOBS} SELECT document_id, max(id) AS id, arg_max(type, id) AS type, arg_max(status, id) AS status, arg_max(updated_at, id) AS updated_at FROM j GROUP BY document_id",
        "claim_order": f"WITH {JOBS} SELECT j.id, j.document_id, j.priority, j.created_at FROM j JOIN documents x ON x.id = j.document_id WHERE NOT x.deleted AND j.status = 'queued'",
        "enqueue_dedupe": f"WITH {JOBS} SELECT id AS document_id, 'index' AS type, 'queued' AS status, CAST(100 AS INTEGER) AS priority FROM documents WHERE id NOT IN (SELECT document_id FROM j WHERE type = 'index' AND status IN ('queued', 'processing') AND document_id IS NOT NULL)",
        "recover_jobs": f"WITH {JOBS} SELECT j.id, CASE WHEN x.deleted THEN 'cancelled' ELSE 'queued' END AS status FROM j LEFT JOIN documents x ON x.id = j.document_id WHERE (x.deleted AND j.status IN ('queued', 'processing')) OR (NOT coalesce(x.deleted, false) AND j.status = 'processing')",
        "cancel_vector_jobs": f"WITH {JOBS} SELECT j.id, 'cancelled' AS status, CAST(1.0 AS DOUBLE) AS progress, 'stop' AS error FROM j JOIN documents x ON x.id = j.document_id WHERE NOT x.deleted AND j.type = 'vector' AND j.status IN ('queued', 'processing')",
        "failed_docs": "SELECT id, status, updated_at FROM documents WHERE NOT deleted AND status IN ('error', 'empty')",
        "retry_candidates": f"WITH {JOBS} SELECT id, status FROM documents WHERE NOT deleted AND status IN ('error', 'empty') AND id NOT IN (SELECT document_id FROM j WHERE type = 'index' AND status IN ('queued', 'processing') AND document_id IS NOT NULL)",
        "recent_jobs": f"WITH {JOBS} SELECT j.id, j.document_id, j.status, j.updated_at FROM j JOIN documents x ON x.id = j.document_id WHERE NOT x.deleted ORDER BY j.updated_at DESC, j.id DESC LIMIT 30",
        "recent_events": "SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 30",
        "snapshot_diff": f"WITH {change} SELECT id, change, CASE change WHEN 'deleted' THEN 'deleted' WHEN 'oversize' THEN 'error' WHEN 'changed' THEN 'queued' ELSE status END AS status, CASE WHEN status = 'empty' THEN size ELSE nsize END AS size, status = 'empty' AS deleted FROM t",
        "snapshot_events": f"WITH {change} SELECT CASE change WHEN 'deleted' THEN 'delete' WHEN 'oversize' THEN 'error' ELSE 'change' END AS type, count(*) AS n FROM t WHERE change NOT IN ('same', 'gone') GROUP BY 1",
        "soft_delete": f"WITH {change} SELECT document_id, count(DISTINCT id) AS n FROM chunks WHERE document_id NOT IN (SELECT id FROM t WHERE change IN ('deleted', 'oversize')) GROUP BY document_id",
        "categories": "SELECT DISTINCT p AS path, p AS label FROM (SELECT unnest(list_transform(range(1, len(a)), lambda n: array_to_string(a[1:n], '/'))) AS p FROM (SELECT string_split(rel_path, '/') AS a FROM documents)) UNION ALL SELECT '', 'all'",
        "path_exclusion": "SELECT id, rel_path FROM documents WHERE NOT (list_has_any(string_split(rel_path, '/'), ['old', 'misc']) OR rel_path IN ('register', 'alder-depot/a') OR starts_with(rel_path, 'register/') OR starts_with(rel_path, 'alder-depot/a/'))",
        "doc_id_sha1": "SELECT id, substr(sha1(lower(replace(rel_path, chr(92), '/'))), 1, 20) AS made FROM documents",
        "extractor_route": "SELECT id, CASE WHEN ext = '.pdf' THEN CASE WHEN starts_with(rel_path, 'alder-depot/') THEN 'pdf-text' ELSE 'ocr' END WHEN ext = '.caj' THEN 'caj' WHEN ext IN ('.txt', '.md') THEN 'text' WHEN ext IN ('.epub', '.docx', '.doc') THEN substr(ext, 2) ELSE 'none' END AS route FROM documents",
        "quota_daily_usage": """WITH l AS (SELECT usage_date, arg_max(pages, updated_at) AS p FROM ocr_usage_daily GROUP BY usage_date),
            i AS (SELECT strftime(indexed_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS usage_date, CAST(sum(page_count) AS BIGINT) AS n FROM documents WHERE NOT deleted AND ext = '.pdf' AND indexed_at IS NOT NULL GROUP BY 1)
            SELECT usage_date, greatest(coalesce(p, 0), coalesce(n, 0)) AS used_pages, coalesce(p, 0) AS logged_pages, coalesce(n, 0) AS indexed_pages,
              CASE WHEN p IS NOT NULL AND p >= coalesce(n, 0) THEN 'usage_log' ELSE 'documents' END AS source, greatest(0, 20000 - greatest(coalesce(p, 0), coalesce(n, 0))) AS remaining_pages FROM l FULL JOIN i USING (usage_date)""",
        "rate_window_60s": "SELECT event_id, CAST(sum(user_id) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS window_tokens FROM events",
        "debounce_sessions": """SELECT min(ts) AS start, max(ts) + INTERVAL 30 SECONDS AS "end", event_type, count(*) AS events FROM (
            SELECT *, sum(b) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM (
              SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) < INTERVAL 30 SECONDS THEN 0 ELSE 1 END AS b FROM events)) GROUP BY event_type, g""",
        "ocr_jsonl_parse": "SELECT DISTINCT document_id, id, CAST(page AS BIGINT) AS page, text FROM chunks WHERE source = 'ocr' AND bbox IS NOT NULL AND text <> ''",
        "bbox_to_rect": """SELECT id, mx AS max_x, my AS max_y, round(nx / iw * 500, 6) AS x0, round(ny / ih * 700, 6) AS y0, round(mx / iw * 500, 6) AS x1, round(my / ih * 700, 6) AS y1 FROM (
            SELECT *, greatest(1000.0, mx) AS iw, greatest(1400.0, my) AS ih FROM (
              SELECT DISTINCT ON (id) id, list_max(list_transform(bbox, lambda p: p[1])) AS mx, list_max(list_transform(bbox, lambda p: p[2])) AS my,
                list_min(list_transform(bbox, lambda p: p[1])) AS nx, list_min(list_transform(bbox, lambda p: p[2])) AS ny FROM chunks WHERE bbox IS NOT NULL))""",
        "citation_format": rf"""SELECT doc_id, CASE WHEN t <> '' THEN concat_ws('，', concat(coalesce(a, ''), '《', t, '》'), p, strftime(created_at, '%Y')) END AS citation FROM (
            SELECT doc_id, created_at, trim(regexp_replace(coalesce(title, ''), '{WS}', ' ', 'g')) AS t, nullif(trim(regexp_replace(source, '{WS}', ' ', 'g')), '') AS a, nullif(trim(regexp_replace(lang, '{WS}', ' ', 'g')), '') AS p FROM documents)""",
        "snippets": f"""WITH {CH}, {DOCS}, {_rank(PHRASE)}, h AS (SELECT r.id, r.text, instr(r.lt, '{PHRASE}') - 1 AS pos FROM r JOIN d USING (document_id) ORDER BY rank, coalesce(r.page, 0), r.ordinal, r.id LIMIT 51)
            SELECT id AS match_id, CASE WHEN pos > 18 THEN '…' ELSE '' END || regexp_replace(substr(text, greatest(pos - 18, 0) + 1, pos + {len(PHRASE) + 90} - greatest(pos - 18, 0)), '(?i)({PHRASE})', '<mark>\\1</mark>', 'g')
              || CASE WHEN pos + {len(PHRASE) + 90} < length(text) THEN '…' ELSE '' END AS snippet FROM h""",
        "publication_window": f"WITH {window} SELECT * FROM pw",
        "payloads": f"""WITH {window}, p AS (SELECT document_id, CASE WHEN trim(first_text) = '' AND trim(last_text) = '' THEN '' ELSE
              '--- FIRST FIVE PAGES ---' || chr(10) || trim(first_text) || chr(10) || chr(10) || '--- LAST FIVE PAGES ---' || chr(10) || trim(last_text) END AS w,
              substr('--- FIRST FIVE PAGES ---' || chr(10) || left(trim(first_text), 12000) || chr(10) || chr(10) || '--- LAST FIVE PAGES ---' || chr(10) || right(trim(last_text), 12000), 1, 24000) AS c FROM pw)
            SELECT document_id, CAST(length(t) AS INTEGER) AS size, md5(t) AS sum FROM (SELECT document_id, CASE WHEN length(w) <= 24000 THEN w ELSE c END AS t FROM p)""",
        "html_to_text": """SELECT doc_id, CASE WHEN coalesce(title, '') <> '' THEN title || chr(10) ELSE '' END
            || array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: x || chr(10)), '') AS text FROM documents WHERE text IS NOT NULL""",
        "embed_batch_packing": """WITH g AS (SELECT document_id, CAST(floor(coalesce(ordinal, 0) / 4096) AS INTEGER) AS part, list(struct_pack(o := ordinal, i := id,
                n := coalesce(least(30000, greatest(1, length(trim(text, ' ')) + 4)), 4)) ORDER BY ordinal, id) AS l FROM (SELECT DISTINCT ON (id) * FROM chunks) GROUP BY ALL),
              f AS (SELECT document_id, part, l, list_reduce(list_transform(l, lambda x: struct_pack(b := CAST(0 AS BIGINT), t := CAST(x.n AS BIGINT), o := CAST([0] AS BIGINT[]))),
                lambda a, x: struct_pack(b := a.b + CASE WHEN a.t + x.t > 30000 THEN 1 ELSE 0 END, t := CASE WHEN a.t + x.t > 30000 THEN x.t ELSE a.t + x.t END,
                  o := list_append(a.o, a.b + CASE WHEN a.t + x.t > 30000 THEN 1 ELSE 0 END))).o AS o FROM g)
            SELECT document_id, part, unnest(l).i AS id, unnest(l).o AS ordinal, CAST(unnest(o) AS INTEGER) AS batch FROM f""",
        "text_backfill": f"""WITH {JOBS} SELECT id AS document_id, 'index' AS type, 'queued' AS status, CAST(80 AS BIGINT) AS priority FROM documents WHERE NOT deleted AND ext IN ('.txt', '.md', '.doc', '.docx', '.epub')
            AND id NOT IN (SELECT document_id FROM j WHERE type = 'index' AND status IN ('queued', 'processing') AND document_id IS NOT NULL)""",
        "index_rebuild_due": f"""WITH {EMB}, {JOBS}, h AS (SELECT document_id, count(*) AS n FROM e WHERE model = '{MODEL}' AND dim = {DIM} GROUP BY document_id),
            a AS (SELECT count(*) FILTER (WHERE coalesce(n, 0) >= chunk_count) AS embedded_documents FROM documents LEFT JOIN h ON h.document_id = id WHERE NOT deleted AND text_chars > 0 AND chunk_count > 0),
            b AS (SELECT count(*) AS active_jobs FROM j JOIN documents x ON x.id = j.document_id WHERE NOT x.deleted AND j.type = 'vector' AND j.status IN ('queued', 'processing'))
            SELECT embedded_documents, active_jobs, embedded_documents >= 100 OR active_jobs = 0 AS due FROM a, b""",
        "ocr_batches": """SELECT id AS document_id, CAST(b AS INTEGER) AS batch, CAST(b * 100 + 1 AS INTEGER) AS first_page, CAST(least((b + 1) * 100, page_count) AS INTEGER) AS last_page
            FROM (SELECT id, page_count, unnest(range(CAST(ceil(page_count / 100.0) AS INTEGER))) AS b FROM documents WHERE page_count > 0)""",
        "error_classes": """SELECT CASE WHEN regexp_matches(m, '(?s)out of memory|cuda oom|cuda.*memory|memory.*cuda') THEN 'memory' WHEN regexp_matches(m, 'timeout|timed out|http 408|http 504') THEN 'time' ELSE 'final' END AS kind,
            count(*) AS n FROM (SELECT lower(coalesce(error, '')) AS m FROM jobs) GROUP BY 1""",
        "page_resolution": f"""SELECT doc_id, CAST(CASE WHEN ceil({sides} * asked / 72.0 * ((size % 4100 + 400) * asked / 72.0)) <= 40000000 THEN asked
              WHEN ceil({sides} * {lowered} / 72.0 * ((size % 4100 + 400) * {lowered} / 72.0)) <= 40000000 THEN {lowered} END AS INTEGER) AS dpi, 0.485 AS progress
            FROM (SELECT *, CASE WHEN page_count >= 300 THEN 160 ELSE 220 END AS asked FROM documents WHERE page_count > 0)""",
    }
