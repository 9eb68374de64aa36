import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from leafline import engine
from leafline.functions import geometry as G
from leafline.functions import text as T
from leafline.operators import ingest, jobs, stats, vectors
from leafline.sources import extract

T0 = dt.datetime(2024, 1, 1)
JOB = "id long, document_id string, type string, status string, priority int, progress double, message string, error string, created_at timestamp, updated_at timestamp, started_at timestamp, finished_at timestamp"


def job(i, doc, status, minute=0, kind="index", priority=100):
    at = T0 + dt.timedelta(minutes=minute)
    return (i, doc, kind, status, priority, 0.0, None, None, T0, at, None, None)


def documents(spark, rows):
    return spark.createDataFrame([(i, s, False, 1, 10, ".txt", T0) for i, s in rows], "id string, status string, deleted boolean, chunk_count int, text_chars long, ext string, updated_at timestamp")


def test_cancelled_stays(spark):
    log = spark.createDataFrame([job(1, "d", "queued"), job(1, "d", "cancelled", 1), job(1, "d", "done", 2), job(2, "d", "done", 3)], JOB)
    assert {r["id"]: r["status"] for r in jobs.latest(log).collect()} == {1: "cancelled", 2: "done"}


def test_enqueue_skips_active(spark):
    now = F.lit(T0)
    log = spark.createDataFrame([job(1, "d", "processing")], JOB)
    wanted = spark.createDataFrame([("d", "index", 90, None), ("e", "index", 90, None), ("e", "index", 90, None)], "document_id string, type string, priority int, message string")
    assert [r["document_id"] for r in jobs.enqueue(log, wanted, now).collect()] == ["e"]


def test_claim_restart_pause_recover(spark):
    now = F.lit(T0 + dt.timedelta(hours=1))
    log = spark.createDataFrame([job(1, "d", "queued", priority=160), job(2, "e", "queued", priority=90), job(3, "d", "processing", kind="vector")], JOB)
    docs = documents(spark, [("d", "ready"), ("e", "queued")])
    assert jobs.claim(log, docs, now).first()["id"] == 2
    stopped, new = jobs.restart(log, 1, now)
    assert [r["id"] for r in stopped.collect()] == [1] and new.first()["status"] == "queued" and new.first()["priority"] == 160
    assert jobs.pause_vectors(log, docs, "offline", now).first()["status"] == "queued"
    assert {(r["id"], r["status"]) for r in jobs.recover(log, docs, now).collect()} == {(3, "queued")}
    changes = spark.createDataFrame([(1, "done", 1.0, None, None)], "id long, status string, progress double, message string, error string")
    assert jobs.update(log, changes, now).first()["finished_at"] is not None


def test_retry_needs_no_active_job(spark):
    docs = documents(spark, [("a", "error"), ("b", "error"), ("c", "ready")])
    log = spark.createDataFrame([job(1, "b", "queued")], JOB)
    assert [r["id"] for r in jobs.retry_candidates(docs, log).collect()] == ["a"]


def test_snapshot_transition(spark):
    cols = "id string, path string, rel_path string, title string, ext string, size long, mtime double, sha256 string"
    row = lambda i, size: (i, i, i, i, ".txt", size, 1.0, None)
    state = spark.createDataFrame([(*row(i, 1), "ready", False, T0, T0, 3, 30) for i in "abde"], cols + ", status string, deleted boolean, created_at timestamp, updated_at timestamp, chunk_count int, text_chars long")
    snap = spark.createDataFrame([row("a", 1), row("b", 2), row("c", 1), row("e", 999)], cols)
    out = ingest.transition(state, snap, F.lit(T0), 100)
    got = {r["id"]: (r["change"], r["status"], r["deleted"], r["chunk_count"]) for r in out["documents"].collect()}
    assert got == {"a": ("same", "ready", False, 3), "b": ("changed", "queued", False, 3), "c": ("new", "queued", False, 0), "d": ("deleted", "deleted", True, 0), "e": ("oversize", "error", False, 0)}
    assert {r["document_id"] for r in out["jobs"].collect()} == {"b", "c"}
    assert {r["document_id"] for r in out["drop_chunks"].collect()} == {"d", "e"}


def test_scan_reads_a_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("one")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "b.txt").write_text("two")
    got = ingest.scan(spark, str(tmp_path), [".txt"], ["skip"], content=True).collect()
    assert [r["rel_path"] for r in got] == ["x/a.txt"] and len(got[0]["sha256"]) == 40


def test_quota(spark):
    docs = spark.createDataFrame([(".pdf", 12, False, dt.datetime(2024, 1, 1, 17))], "ext string, page_count int, deleted boolean, indexed_at timestamp")
    usage = spark.createDataFrame([], "usage_date string, pages long, updated_at timestamp")
    r = stats.daily_usage(docs, usage).first()
    assert (r["usage_date"], r["used_pages"], r["source"]) == ("2024-01-02", 12, "documents")
    added = spark.createDataFrame([("2024-01-02", 3), ("2024-01-02", 2)], "usage_date string, pages long")
    after = stats.record_usage(usage, stats.indexed_pages(docs), added, F.lit(T0))
    r = stats.daily_usage(docs, after).first()
    assert (r["used_pages"], r["source"], r["remaining_pages"]) == (17, "usage_log", 19983)
    assert stats.valid_zone("No/Where") == "UTC"


def test_batches():
    size = lambda t: len(t) + 4
    assert vectors.pack_batches([size("a" * 4)] * 3 + [16], 3, 18) == [0, 0, 1, 2]
    assert vectors.pack_batches([10] * 10, 0, 100) == [0] * 10
    assert vectors.pack_batches([8] * 3, 0, 18) == [0, 0, 1]
    assert vectors.pack_batches([], 0, 10) == []


def test_quantised_search_finds_itself(spark):
    one = lambda i: [1.0 if j == i else 0.0 for j in range(8)]
    rows = [(i, "d", 8, "m", one(i), T0) for i in range(2)] + [(9, "d", 8, "m", None, T0), (10, "d", 8, "m", [0.0] * 8, T0), (11, "d", 8, "m", [float("nan")] * 8, T0)]
    e = spark.createDataFrame(rows, "chunk_id long, document_id string, dim int, model string, vector array<float>, updated_at timestamp")
    index, low, high = vectors.build_index(e, "m", 8)
    top = vectors.search(index, low, high, one(0), 5).first()
    assert index.count() == 2 and top["chunk_id"] == 0 and top["match_score"] > 0.5


def test_missing_vectors(spark):
    c = spark.createDataFrame([(1, "d", "first"), (2, "d", "second line")], "id long, document_id string, text string")
    e = spark.createDataFrame([(1, "d", 8, "m", [1.0], T0)], "chunk_id long, document_id string, dim int, model string, vector array<float>, updated_at timestamp")
    assert [r["text"] for r in vectors.missing(c, e, "m", 8).collect()] == ["second line"]


def test_extractors(spark):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="x"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></c>')
        z.writestr("OEBPS/content.opf", '<p><manifest><item id="a" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></p>')
        z.writestr("OEBPS/c.xhtml", "<html><body><h1>Head</h1><p>One &amp; two</p><script>no</script></body></html>")
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    files = spark.createDataFrame([("e", ".epub", book.getvalue()), ("w", ".docx", word.getvalue()), ("t", ".txt", "Größe\n\nzwei".encode()), ("x", ".docx", b"no zip"), ("p", ".pdf", b"")], "id string, ext string, content binary")
    rows = extract.extract(files).orderBy("document_id", "ordinal").collect()
    assert [r["text"] for r in rows if r["document_id"] == "e"] == ["Head", "One & two"]
    assert [r["text"] for r in rows if r["document_id"] == "w"] == ["Para", "a | b"]
    assert [(r["line"], r["ordinal"]) for r in rows if r["document_id"] == "t"] == [(1, 0), (3, 1)]
    assert all(r["error"] for r in rows if r["document_id"] in "xp")
    assert extract.decode("中文内容测试".encode("gb18030")) == "中文内容测试"


def test_ocr_rows_and_geometry(spark):
    value = json.dumps({"result": {"ocrResults": [{"prunedResult": {"rec_texts": ["alpha beta gamma", ""], "rec_polys": [[15, 30, 150, 60], [0, 0, 1, 1]]}}]}})
    rows = spark.createDataFrame([("d", 0, value), ("d", 1, "")], "document_id string, seq int, value string")
    r = extract.parse_ocr(rows).collect()
    assert [(x["text"], x["page"], x["bbox"][2]) for x in r] == [("alpha beta gamma", 1, [150.0, 60.0])]
    df = extract.parse_ocr(rows).withColumn("line", G.page_rect(F.col("bbox"), F.lit(200.0), F.lit(100.0), 200.0, 100.0))
    q = df.select("line", G.query_rect(F.col("line"), F.col("text"), "beta").alias("q")).first()
    assert q["line"]["x0"] < q["q"]["x0"] < q["q"]["x1"] < q["line"]["x1"]
    w, h = G.page_size(F.lit(1191.0), F.lit(1156.0), F.lit(595.28), F.lit(852.06))
    size = spark.range(1).select(w.alias("w"), h.alias("h")).first()
    assert size["w"] == 1191.0 and abs(size["h"] - 1191 / (595.28 / 852.06)) < 1e-6


def test_citations(spark):
    cols = "author_or_editor string, title string, publisher string, publication_time string, citation string"
    df = spark.createDataFrame([("A", "T", "P", " ", None), (None, "T", None, None, None), ("A", None, "P", "1", None), (None, None, None, None, "given")], cols)
    assert [r[0] for r in df.select(T.citation(F.struct("*"))).collect()] == ["A《T》，P", "《T》", None, "given"]
    assert T.json_object('```json\n{"a": 1}\n```') == {"a": 1}


def test_secrets_and_guards(tmp_path, monkeypatch):
    path = str(tmp_path / "c.json")
    engine.write_secrets(path, {"LANGUAGE_MODEL_API_KEY": "file", "X": None})
    assert engine.secret("LANGUAGE_MODEL_API_KEY", path) == "file"
    monkeypatch.setenv("LANGUAGE_MODEL_API_KEY", "env")
    assert engine.secret("LANGUAGE_MODEL_API_KEY", path) == "env"
    assert engine.within(str(tmp_path / "a"), [str(tmp_path)]) and not engine.within("/etc/passwd", [str(tmp_path)])


def test_unknown_document(spark):
    lib = engine.Library(spark.createDataFrame([], "id string, deleted boolean"), spark.createDataFrame([], "id long, text string"))
    with pytest.raises(engine.Unknown):
        lib.document("no")
