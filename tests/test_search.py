import sqlite3

import pytest
from pyspark.sql import functions as F

from leafline.functions import snippet as S
from leafline.functions import text as T
from leafline.operators import search

DOCS = "id string, rel_path string, title string, ext string, status string, searchable_pdf string, updated_at timestamp, deleted boolean"
CHUNKS = "id long, document_id string, page int, ordinal int, line int, text string, source string"


def library(spark, docs, chunks=None):
    import datetime as dt

    rows, n = [], 0
    for doc, texts in docs.items():
        for i, t in enumerate(texts):
            n += 1
            rows.append((n, doc, None, i, i + 1, t, "text"))
    d = [(k, f"a/{k}.txt", k, ".txt", "ready", None, dt.datetime(2024, 1, 1 + i), False) for i, k in enumerate(docs)]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(d, DOCS)


def found(spark, docs, query, mode="basic", **kw):
    c, d = library(spark, docs)
    return [(r["document_id"], r["ordinal"]) for r in search.hits(search.plan(c, d, query, mode, **kw)).collect()]


def test_two_characters_take_the_like_path(spark):
    assert found(spark, {"doc1": ["郑海藏有诗"]}, "海藏") == [("doc1", 0)]
    assert S.snippet("郑海藏有诗", ["海藏"]) == "郑<mark>海藏</mark>有诗"


def test_snippet_is_centred():
    out = S.snippet("前" * 140 + "海藏" + "后" * 140, ["海藏"])
    assert out.startswith("…") and out.endswith("…") and "<mark>海藏</mark>" in out and len(out) < 282
    assert S.snippet("x" * 200, ["zz"]) == "x" * 108 + "…"
    assert S.snippet(None, ["a"]) == ""
    assert S.marked("ananan", ["anan", "an"]) == "<mark>anan</mark><mark>an</mark>"


def test_pages(spark):
    c, d = library(spark, {f"d{i}": [f"海藏 result {i}"] for i in range(3)})
    first = search.envelope(search.hits(search.plan(c, d, "海藏")), 2, 0)
    second = search.envelope(search.hits(search.plan(c, d, "海藏")), 2, 2)
    assert (len(first["results"]), first["has_more"], first["next_offset"]) == (2, True, 2)
    assert (len(second["results"]), second["has_more"], second["next_offset"]) == (1, False, None)


def test_groups_by_matches(spark):
    c, d = library(spark, {"letters": ["郑孝胥 one"], "diary": ["郑孝胥 a", "none", "郑孝胥 b"]})
    g = search.groups(search.plan(c, d, "郑孝胥")).collect()
    assert [(r["document_id"], r["match_count"], r["ordinal"]) for r in g] == [("diary", 2, 0), ("letters", 1, 0)]


def test_one_document_in_order_of_position(spark):
    docs = {"d": ["alpha first", "alpha alpha alpha alpha second", "alpha third"], "e": ["alpha"]}
    assert found(spark, docs, "alpha", document_id="d") == [("d", 0), ("d", 1), ("d", 2)]


def test_line_and_document_modes(spark):
    docs = {"same-line": ["郑孝胥 and 袁世凯", "郑孝胥"], "same-file": ["郑孝胥", "袁世凯"], "missing": ["郑孝胥"]}
    assert found(spark, docs, "郑孝胥 袁世凯", "line") == [("same-line", 0)]
    assert {x for x, _ in found(spark, docs, "郑孝胥 袁世凯", "document")} == {"same-line", "same-file"}
    assert found(spark, docs, "", "document") == []


def test_terms_scope_and_modes():
    assert T.query_terms('alpha "be ta",gamma；delta') == ["alpha", "be ta", "gamma", "delta"]
    assert T.query_terms('a"b c"d') == ["ab cd"]
    assert T.scope_path("\\a/./../b/") == "a/b"
    assert [T.mode_name(x) for x in (None, "FILE", "semantic", "what", "same_chunk")] == ["basic", "document", "fuzzy", "basic", "line"]


def test_like_wildcards_and_backslash(spark):
    c, d = library(spark, {"d": ["a_b", "axb", "a\\b", "AXB", "É"]})
    rows = c.where(T.like_any(F.col("text"), ["a_b"])).count(), c.where(T.like_any(F.col("text"), ["a\\b"])).count(), c.where(T.like_any(F.col("text"), ["é"])).count()
    assert rows == (4, 1, 0)


@pytest.mark.parametrize("phrase", ["anan", "the cat", "café"])
def test_bm25_agrees_with_fts5(spark, phrase):
    texts = ["banananan", "the cat sat on the cat", "Café au lait", "nothing here at all", "the dog", "ananas and banana", "more text to raise the mean length of lines"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t, tokenize='trigram')")
    con.executemany("insert into f(t) values (?)", [(t,) for t in texts])
    want = {r - 1: round(s, 9) for r, s in con.execute("select rowid, bm25(f) from f where f match ?", (f'"{phrase}"',))}
    c, d = library(spark, {"d": texts})
    got = {r["ordinal"]: round(r["rank"], 9) for r in search.hits(search.plan(c, d, phrase)).collect()}
    assert got == want


def test_lines_are_those_of_python(spark):
    text = "a\r\nb\x0bc\u2028 d\u3000 e \n\n\x1cf\x00g\u0085h"
    got = spark.createDataFrame([(text,)], "t string").select(T.lines(F.col("t")).alias("x")).first()["x"]
    want = [(i, " ".join(t.replace("\x00", " ").split())) for i, t in enumerate(text.splitlines(), 1)]
    assert [(r["line"], r["text"]) for r in got] == [w for w in want if w[1]]
