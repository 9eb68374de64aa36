import datetime as dt
import json
import zlib

import pytest
from pyspark.sql import functions as F

from leafline.functions import geometry as G
from leafline.functions import text as T
from leafline.operators import ingest, jobs, publication, remote, search, stats, vectors, workers
from leafline.sources import extract, ocr, pdf

T0 = dt.datetime(2024, 1, 1)
JOB = "id long, document_id string, type string, status string, priority int, progress double, message string, error string, created_at timestamp, updated_at timestamp, started_at timestamp, finished_at timestamp"
DOC = "id string, status string, deleted boolean, chunk_count int, text_chars long, page_count int, ext string, updated_at timestamp, indexed_at timestamp, error string"
CHUNK = "id long, document_id string, page int, ordinal int, line int, text string, source string"
EMB = "chunk_id long, document_id string, dim int, model string, vector array<float>, created_at timestamp, updated_at timestamp"


def now():
    return F.lit(T0 + dt.timedelta(hours=1))


def job(i, doc, status, kind="index", priority=100):
    return (i, doc, kind, status, priority, 0.0, None, None, T0, T0, None, None)


def documents(spark, *rows):
    return spark.createDataFrame([(i, s, False, n, n * 10, 1, ext, T0, None, None) for i, s, n, ext in rows], DOC)


def made_pdf(pages):
    """A file with a deflated content stream a page and a font whose codes are mapped in the second page."""
    cmap = b"1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))
    out = [b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Kids [" + kids + b"] >> endobj", b"3 0 obj << /Type /Font >> endobj"]
    out += [b"4 0 obj << /Type /Font /ToUnicode 5 0 R >> endobj", b"5 0 obj << /Length 1 >> stream\n" + cmap + b"\nendstream endobj"]
    for k, content in enumerate(pages):
        out.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj" % (10 + 2 * k, 11 + 2 * k))
        out.append(b"%d 0 obj << /Filter /FlateDecode >> stream\n" % (11 + 2 * k) + zlib.compress(content) + b"\nendstream endobj")
    return b"\n".join(out)


def test_pdf_text(spark):
    raw = made_pdf([rb"BT /F1 12 Tf 1 0 0 1 50 700 Tm (First \(line\)) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET", b"BT /F2 12 Tf <000100020003> Tj ET"])
    assert [p.split("\n") for p in map(str.strip, pdf.pdf_pages(raw))] == [["First (line)", "second line"], ["中ab"]]
    files = spark.createDataFrame([("p", ".pdf", bytearray(raw)), ("q", ".pdf", bytearray(b"no")), ("d", ".caj", bytearray(b"x"))], "id string, ext string, content binary")
    rows = extract.extract(files).collect()
    assert [(r["page"], r["line"], r["ordinal"], r["text"], r["source"]) for r in rows if r["document_id"] == "p"] == [(1, 2, 0, "First (line)", "pdf-text"), (1, 3, 1, "second line", "pdf-text"), (2, 1, 2, "中ab", "pdf-text")]
    assert all(r["error"] for r in rows if r["document_id"] != "p")


def test_programs_are_tried_in_turn(monkeypatch):
    monkeypatch.setitem(extract.PROGRAMS, ".doc", [["not-there-at-all", "{file}"], ["false"], ["cat", "{file}"]])
    assert extract.by_program(".doc")("Zeile eins\nzwei".encode()) == ["Zeile eins", "zwei"]
    monkeypatch.setitem(extract.PROGRAMS, ".doc", [["false"]])
    with pytest.raises(RuntimeError, match="false"):
        extract.by_program(".doc")(b"x")


def recogniser():
    """A client of its own, so that it travels by value: polled twice before it is done; the document `bad` fails, `busy` is unavailable once."""

    class Recogniser:

        def __init__(self):
            self.seen = {}

        def submit(self, document_id, first_page, last_page):
            n = self.seen["s" + document_id] = self.seen.get("s" + document_id, 0) + 1
            if document_id == "busy" and n == 1:
                raise remote.RemoteError("try later", 503)
            return f"{document_id}:{first_page}"

        def poll(self, job):
            n = self.seen[job] = self.seen.get(job, 0) + 1
            if job.startswith("bad"):
                return "failed", "unreadable"
            return ("running", "") if n < 3 else ("done", job)

        def fetch(self, address):
            doc, first = address.split(":")
            page = {"ocrResults": [{"prunedResult": {"rec_texts": [f"{doc} from {first}"], "rec_polys": [[10, 20, 110, 40]]}}]}
            return "\n".join([json.dumps({"result": page})] * 2)

    return Recogniser()


def test_recognition_in_batches(spark):
    docs = spark.createDataFrame([("a", 150), ("bad", 3), ("busy", 2), ("none", None)], "id string, page_count int")
    asked = ocr.batches(docs)
    assert {(r["document_id"], r["batch"], r["first_page"], r["last_page"]) for r in asked.collect()} == {("a", 0, 1, 100), ("a", 1, 101, 150), ("bad", 0, 1, 3), ("busy", 0, 1, 2)}
    quiet = lambda s: None
    done = spark.createDataFrame(ocr.recognise(asked, recogniser(), wait=0, sleep=quiet).collect())
    assert {r["document_id"]: r["error"] for r in done.where("error is not null").collect()} == {"bad": "RemoteError: unreadable"}
    assert [r["document_id"] for r in ocr.pending(asked, done).collect()] == ["bad"]
    lines = {(r["document_id"], r["page"]): r["text"] for r in ocr.recognised_lines(done).collect()}
    assert lines[("a", 101)] == "a from 101" and lines[("a", 2)] == "a from 1" and ("bad", 1) not in lines
    again = spark.createDataFrame([("bad", 0, "a:7")], "document_id string, batch int, job string")
    assert ocr.recognise(ocr.pending(asked, done), recogniser(), again, 0, sleep=quiet).first()["error"] is None


def test_remote_errors():
    calls, slept = [], []

    def call(items):
        calls.append(len(items))
        if len(items) > 2:
            raise RuntimeError("CUDA error: no more memory")
        return items

    assert remote.halved(call, [1, 2, 3, 4, 5]) == [1, 2, 3, 4, 5] and calls == [5, 3, 2, 1, 2]
    with pytest.raises(remote.RemoteError):
        remote.retried(lambda: (_ for _ in ()).throw(remote.RemoteError("gone", 503)), 3, 1.0, slept.append)
    assert slept == [1.0, 2.0]
    assert remote.halved(call, []) == [] and remote.class_of(ValueError("wrong")) == "final"


def test_error_classes_of_rows(spark):
    rows = [("Read timed out", None, "time"), ("CUDA OOM", 500, "memory"), ("x", 524, "passing"), ("x", 404, "final"), (None, None, "final"), ("HTTP 504", 504, "time")]
    df = spark.createDataFrame(rows, "m string, s int, want string")
    assert df.where(remote.error_class(F.col("m"), F.col("s")) != F.col("want")).count() == 0


def test_publication(spark):
    chunks = spark.createDataFrame([(1, "a", 1, 0, 1, "Imprint of Alder", "ocr"), (2, "b", 1, 0, 1, "no imprint", "ocr"), (3, "c", 1, 0, 1, "broken", "ocr"), (4, "d", None, 0, 1, "no pages", "text")], CHUNK)
    docs = documents(spark, ("a", "ready", 1, ".pdf"), ("b", "ready", 1, ".pdf"), ("c", "ready", 1, ".pdf"), ("d", "ready", 1, ".txt"))

    def model(text):
        if "broken" in text:
            return "no object here"
        if "no imprint" in text:
            return '```json\n{"has_publication_info": false}\n```'
        return 'Here: {"has_publication_info": true, "title": "Alder", "author_or_editor": "M. Vane", "publisher": "Hill", "publication_time": "1990", "citation": null} as asked'

    got = {r["id"]: r for r in publication.published(chunks, docs, model, now()).collect()}
    assert (got["a"]["publication_status"], got["a"]["citation"]) == ("ready", "M. Vane《Alder》，Hill，1990")
    assert got["b"]["publication_status"] == "no_info" and got["b"]["citation"] is None
    assert got["c"]["publication_status"] == "error" and "no JSON object" in json.loads(got["c"]["publication_info"])["error"]
    assert got["d"]["publication_status"] is None and got["d"]["updated_at"] == T0
    assert {r["status"] for r in publication.ask(publication.payloads(chunks), None).collect()} == {"missing_key"}


def test_claims_are_taken_once(spark, tmp_path):
    log = spark.createDataFrame([job(1, "a", "queued", priority=90), job(2, "b", "queued")], JOB)
    docs = documents(spark, ("a", "queued", 0, ".txt"), ("b", "queued", 0, ".txt"))
    got = [workers.claim_atomic(log, docs, str(tmp_path), now()) for _ in range(3)]
    assert [g.first()["id"] for g in got[:2]] == [1, 2] and got[2] is None


def test_index_round(spark):
    log = spark.createDataFrame([job(1, "a", "processing"), job(2, "b", "processing"), job(3, "c", "cancelled"), job(4, "e", "processing")], JOB)
    docs = documents(spark, ("a", "queued", 1, ".txt"), ("b", "queued", 0, ".txt"), ("c", "queued", 0, ".txt"), ("e", "queued", 1, ".txt"))
    chunks = spark.createDataFrame([(1, "a", None, 0, 1, "old", "text"), (2, "e", None, 0, 1, "old", "text"), (3, "z", None, 0, 1, "stays", "text")], CHUNK)
    files = spark.createDataFrame([("a", ".txt", bytearray(b"new line\n\nand more")), ("b", ".nil", bytearray(b"x")), ("c", ".txt", bytearray(b"late")), ("e", ".txt", bytearray(b"\n"))], "id string, ext string, content binary")
    out = workers.index_round(docs, chunks, log, log.where("type = 'index'"), extract.extract(files), now())
    assert {r["id"]: r["status"] for r in out["documents"].collect()} == {"a": "ready", "b": "error", "c": "error", "e": "empty"}
    assert {(r["document_id"], r["text"]) for r in out["chunks"].collect()} == {("a", "new line"), ("a", "and more"), ("z", "stays")}
    assert {(r["document_id"], r["type"], r["status"]) for r in out["jobs"].collect()} == {("a", "index", "done"), ("b", "index", "failed"), ("e", "index", "done"), ("a", "vector", "queued")}
    assert {(r["document_id"], r["type"]) for r in out["events"].collect()} == {("a", "index"), ("b", "error"), ("c", "cancel"), ("e", "index")}


def test_vector_round_and_rebuild(spark):
    log = spark.createDataFrame([job(1, "a", "processing", "vector")], JOB)
    docs = documents(spark, ("a", "ready", 2, ".txt"))
    chunks = spark.createDataFrame([(1, "a", None, 0, 1, "one", "text"), (2, "a", None, 1, 2, "two", "text")], CHUNK)
    none = spark.createDataFrame([], EMB)
    out = workers.vector_round(chunks, none, docs, log, log, lambda texts: [[3.0, 4.0] for _ in texts], "m", 2, now())
    vectors_now = spark.createDataFrame(out["embeddings"].collect(), EMB)
    assert vectors_now.count() == 2 and out["jobs"].first()["status"] == "done" and out["away"].isEmpty()
    due = workers.rebuild_due(docs, vectors_now, log, 0, "m", 2).first()
    assert (due["embedded_documents"], due["active_jobs"], due["due"]) == (1, 1, False)
    assert workers.rebuild_due(docs, vectors_now, log, 0, "m", 2, own=1).first()["due"]

    def away(texts):
        raise ConnectionError("refused")

    gone = workers.vector_round(chunks, none, docs, log, log, away, "m", 2, now())
    row = gone["jobs"].first()
    assert row["status"] == "queued" and row["message"] == "Paused" and not gone["away"].isEmpty() and gone["embeddings"].count() == 0


def test_backfill(spark):
    log = spark.createDataFrame([job(1, "a", "queued")], JOB)
    docs, new = workers.backfill(documents(spark, ("a", "ready", 1, ".txt"), ("b", "ready", 1, ".md"), ("c", "ready", 1, ".pdf")), log, now())
    assert {r["id"]: r["status"] for r in docs.collect()} == {"a": "queued", "b": "queued", "c": "ready"}
    assert [(r["document_id"], r["priority"]) for r in new.collect()] == [("b", 80)]


def test_stored_index(spark, tmp_path):
    rows = [(i, "d", 4, "m", [float(i), 1.0, 0.5, -1.0], T0, T0) for i in range(1, 9)]
    emb = spark.createDataFrame(rows, EMB)
    assert vectors.save_index(emb, "m", 4, str(tmp_path)) == 8
    query = [0.9, 0.1, 0.1, -0.4]
    stored = vectors.search(*vectors.open_index(spark, str(tmp_path)), query, 3).collect()
    assert stored == vectors.search(*vectors.build_index(emb, "m", 4), query, 3).collect()
    meta = {"vector_index_path": "x", "vector_index_count": "8", "vector_index_model": "m", "vector_index_dim": "4", "vector_index_dirty": "0"}
    assert vectors.index_status(emb, meta, "m", 4) == {"available": True, "dirty": False, "index_count": 8, "embeddings": 8}
    assert not vectors.index_status(emb, meta | {"vector_index_count": "9"}, "m", 4)["available"]


def test_no_vector_is_read_for_ids(spark):
    emb = spark.createDataFrame([(1, "d", 2, "m", [1.0, 2.0], T0, T0)], EMB)
    chunks = spark.createDataFrame([(1, "d", None, 0, 1, "t", "text"), (2, "d", None, 1, 2, "t", "text")], CHUNK)
    missing = vectors.missing(chunks, emb, "m", 2)
    plan = missing._jdf.queryExecution().optimizedPlan().toString()
    assert [r["id"] for r in missing.collect()] == [2]
    # Only the leaf, which is a list of rows here, still has the column.
    assert not any("vector" in line for line in plan.splitlines() if "LogicalRDD" not in line and "LocalRelation" not in line)


def test_cascade_rewrite_and_replace(spark):
    chunks = spark.createDataFrame([(1, "a", 1, 0, 1, "x", "text"), (2, "b", 1, 0, 1, "y", "text")], CHUNK)
    emb = spark.createDataFrame([(1, "a", 2, "m", [1.0, 2.0], T0, T0)], EMB)
    meta = spark.createDataFrame([("vector_index_dirty", "0"), ("other", "1")], "key string, value string")
    docs = documents(spark, ("a", "ready", 1, ".txt"), ("b", "ready", 1, ".txt"))
    out = ingest.cascade(chunks, emb, docs, meta, spark.createDataFrame([("a",)], "document_id string"), now())
    assert out["chunks"].count() == 1 and out["embeddings"].count() == 0
    assert {r["id"]: r["chunk_count"] for r in out["documents"].collect()} == {"a": 0, "b": 1}
    assert {r["key"]: r["value"] for r in out["meta"].collect()} == {"vector_index_dirty": "1", "other": "1"}
    new = spark.createDataFrame([(9, "a", 1, 0, 1, "new", "text"), (10, "a", 1, 1, 2, "  ", "text")], CHUNK)
    assert {r["text"] for r in ingest.replace_chunks(chunks, new).collect()} == {"new", "y"}
    assert [r["id"] for r in search.page_chunks(chunks, "a", 1).collect()] == [1]
    state = spark.createDataFrame([("a", 5, 1.0, T0), ("b", 6, 1.0, T0)], "id string, size long, mtime double, updated_at timestamp")
    files = spark.createDataFrame([("a", 7, 2.0)], "id string, size long, mtime double")
    assert {(r["id"], r["size"]) for r in ingest.rewritten(state, files, now()).collect()} == {("a", 7), ("b", 6)}


def test_highlight_resolution_progress_and_pages(spark):
    one = spark.range(1)
    rect = F.struct(F.lit(10.0).alias("x0"), F.lit(1.0).alias("y0"), F.lit(110.0).alias("x1"), F.lit(9.0).alias("y1"))
    none, null = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    pick = lambda line, exact, by: [tuple(r) for r in one.select(G.highlight(line, F.lit("some words"), "words", exact, by).alias("h")).first()["h"]]
    assert pick(rect, F.array(rect), none)[0][0] > 10.0 and pick(null, F.array(rect), none) == [(10.0, 1.0, 110.0, 9.0)]
    assert pick(null, none, F.array(rect)) == [(10.0, 1.0, 110.0, 9.0)] and pick(null, none, none) == []
    dpi = one.select(G.page_dpi(F.lit(612.0), F.lit(792.0), F.lit(10)).alias("a"), G.page_dpi(F.lit(612.0), F.lit(792.0), F.lit(400)).alias("b"), G.page_dpi(F.lit(3000.0), F.lit(4000.0), F.lit(1)).alias("c"), G.page_dpi(F.lit(9e4), F.lit(9e4), F.lit(1)).alias("d")).first()
    assert (dpi["a"], dpi["b"], dpi["d"]) == (220, 160, None) and 96 <= dpi["c"] < 220
    p = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (3, 0)], "n int, t int").select(F.round(stats.progress(F.col("n"), F.col("t")), 3)).collect()
    assert [r[0] for r in p] == [0.05, 0.485, 0.92, 0.97]
    shown = spark.createDataFrame([(1, "a"), (2, "b")], "match_id long, text string")
    assert sorted(r["match_id"] for r in search.append_page(shown, spark.createDataFrame([(2, "b"), (3, "c")], "match_id long, text string")).collect()) == [1, 2, 3]


def test_text_helpers(spark):
    row = spark.range(1).select(T.payload(F.lit("a" * 3000), F.lit("b" * 3000), 2000).alias("p"), T.preview_terms(F.lit("x" * 100)).alias("t")).first()
    assert len(row["p"]) == 2000 and row["p"].startswith("--- FIRST") and row["t"] == ["x" * 100, "x" * 80]
    assert T.index_text(" a  b ").split("\n")[0] == "a b"
    with pytest.raises(ValueError):
        T.json_object("nothing")


def test_jobs_of_cancelled_documents(spark):
    log = spark.createDataFrame([job(1, "a", "processing"), job(2, "b", "queued"), job(3, "b", "queued")], JOB)
    stopped = jobs.cancel(log, F.col("id").isin(1, 2), "stop", now())
    assert [r["id"] for r in jobs.documents_after_cancel(documents(spark, ("a", "queued", 0, ".txt"), ("b", "queued", 0, ".txt")), log, stopped).collect()] == ["a"]


def test_shared_files_are_deleted(spark):
    import os

    from leafline import session

    kept = session._made.pop(spark.sparkContext.applicationId, [])
    df = session.shared_table(spark.range(3), "probe")
    (path,) = session._made[spark.sparkContext.applicationId]
    assert df.count() == 3 and os.path.exists(path)
    session.clean(spark)
    assert not os.path.exists(path)
    session._made[spark.sparkContext.applicationId] = kept
