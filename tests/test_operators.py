"""Small fixtures for what SQL cannot say, and for dirty input."""

import math

import pytest
from pyspark.sql import functions as F

from stratalode.functions import text as T
from stratalode.functions import url as U
from stratalode.functions import vector as V
from stratalode.operators import chunking, code, ingest, memory, retrieval, search


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("url,want", [
    ("HTTP://User:pw@Example.COM:80/a/#f", "http://example.com/a"), ("https://e.com", "https://e.com/"), ("https://e.com:8443/x/?q=1", "https://e.com:8443/x?q=1"),
    ("no url", None), (None, None)])
def test_url_normalise(spark, url, want):
    assert one(spark, url, U.normalise) == want
    if want:
        assert one(spark, want, U.normalise) == want


@pytest.mark.parametrize("url,safe", [("https://e.com/x", True), ("ftp://e.com", False), ("http://10.1.2.3/", False), ("http://localhost:8080", False), ("http://a:b@e.com", False),
                                      ("http://metadata.google/", False), ("http://100.100.1.1/", False), ("https://100.128.1.1/", True), ("http://[::1]/", False)])
def test_url_safe(spark, url, safe):
    assert one(spark, url, U.is_safe) is safe


def test_dehyphenate(spark):
    assert one(spark, "plan-\nning state-\nbased", T.dehyphenate) == "planning state-\nbased"


def test_ngrams_agree_with_the_driver_form(spark):
    rows = spark.createDataFrame([(1, "Hello World"), (2, ""), (3, "ab"), (4, None), (5, "hello world")], "id int, t string")
    got = {}
    for r in V.ngram_rows(rows, "id", "t").collect():
        got.setdefault(r["id"], {})[r["idx"]] = r["weight"]
    assert set(got) == {1, 5} and got[1] == pytest.approx(got[5])
    assert got[1] == pytest.approx(V.hash_ngrams("Hello World"))
    assert math.isclose(sum(w * w for w in got[1].values()), 1.0, rel_tol=1e-9)
    s = {r["id"]: r["sparse"] for r in V.ngram_similarity(V.ngram_rows(rows, "id", "t"), "hello world").collect()}
    assert s[1] == pytest.approx(1.0)


def test_cycles_brute_force(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", "e"), ("f", "a"), ("d", "g")]
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {(r["cycle"], r["length"]) for r in code.cycles(df).collect()} == {("a > b", 2), ("b > c > d", 3), ("e", 1)}
    assert code.cycles(df.limit(0)).count() == 0


def test_reachable(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = {r["path"]: r["distance"] for r in code.reachable(df, spark.createDataFrame([("a",)], "path string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_reachable_over_a_long_chain(spark):
    df = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(24)], "src string, dst string")
    got = {r["path"]: r["distance"] for r in code.reachable(df, spark.createDataFrame([("n0",)], "path string")).collect()}
    assert got == {f"n{i}": i for i in range(25)}


def test_python_checks(spark):
    src = 'def f(a, b, _c):\n    """Text.\n\n    :param a: x\n    :param q: y\n    """\n    z = 1\n    return a\n'
    files = spark.createDataFrame([("m.py", src), ("bad.py", "def ("), ("n.py", None), ("e.py", "")], "path string, text string")
    got = {(r["rule"], r["name"]) for r in code.python_checks(files).collect()}
    assert got == {("param-missing", "b"), ("param-missing", "_c"), ("param-extra", "q"), ("return-missing", "f"), ("unused-parameter", "b"), ("unused-local", "z")}


def test_nesting_never_below_zero(spark):
    assert one(spark, ")){ ( } x", code.nesting) == 2


def test_segments_keep_everything():
    text = "# A\n\npara one. two\n\n- x\n  more\n- y\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\n# no heading\n```\n\n$$x$$\nend"
    parts = chunking.segments(text)
    assert [p[0] for p in parts] == ["heading", "text", "list", "table", "code", "formula", "text"]
    joined = "\n".join(p[1] for p in parts)
    for line in text.split("\n"):
        assert line.strip() in joined


def test_split_long_keeps_the_tail():
    out = chunking.split_long("A sentence here. " * 50 + "tail without stop", 40)
    assert all(chunking.tokens(x) <= 40 for x in out) and out[-1].endswith("tail without stop")


def test_semantic_chunks_dirty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 50_000), (4, "# T\n\nbody")], "id int, t string")
    got = chunking.semantic_chunks(df, "id", "t").collect()
    assert {r["doc"] for r in got} == {"3", "4"} and len({r["chunk_id"] for r in got}) == len(got)
    assert all(r["tokens"] <= 512 for r in got)


def test_bm25_orders_and_empty(spark):
    lines = spark.createDataFrame([("a", 1, "alpha beta"), ("a", 2, "alpha alpha"), ("b", 1, "gamma"), ("b", 2, None)], "path string, line_no int, content string")
    got = [(r["path"], r["line_no"]) for r in search.top(search.bm25(lines, "alpha"), 5).collect()]
    assert got == [("a", 2), ("a", 1)]
    assert search.bm25(lines, "!!").count() == 0
    assert search.bm25(lines.limit(0), "alpha").count() == 0


def test_index_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("a", 1, "alpha beta alpha"), ("b", 1, "beta")], "path string, line_no int, content string")
    search.write_index(lines, str(tmp_path / "ix"))
    got = {(r["term"], r["path"], r["tf"]) for r in search.read_postings(spark, str(tmp_path / "ix"), ["alpha"]).collect()}
    assert got == {("alpha", "a", 2)}
    a, b = search.bm25_indexed(spark, str(tmp_path / "ix"), "alpha beta").collect(), search.bm25(lines, "alpha beta").collect()
    assert sorted((r["path"], round(r["score"], 9)) for r in a) == sorted((r["path"], round(r["score"], 9)) for r in b)
    assert search.bm25_indexed(spark, str(tmp_path / "ix"), "none here").count() == 0


def test_memory_gate_and_merge(spark):
    m = spark.createDataFrame([("s", "semantic", "x", 0.5, None, None), ("t", "semantic", "x", 0.6, None, None), ("p", "procedural", "x", None, 2, 0.8), ("q", "procedural", "x", None, 1, 0.9),
                               ("k", "episodic", "ghp_" + "a" * 36, None, None, None), ("n", "episodic", None, None, None, None)],
                              "id string, layer string, content string, confidence double, occurrences int, strength double")
    assert {r["id"]: r["rejected"] for r in memory.gate(m).collect()} == {"s": "confidence", "t": None, "p": None, "q": "strength", "k": "secret", "n": "empty"}


def test_quota_top_and_prune(spark):
    df = spark.createDataFrame([(f"i{k}", "l1" if k % 2 else "l3", float(k // 2)) for k in range(20)], "id string, level string, score double")
    got = retrieval.quota_top(df, "level", {"l1": 2, "l3": 1}).collect()
    assert sorted(r["id"] for r in got) == ["i17", "i18", "i19"]
    g = df.withColumnRenamed("score", "gain")
    assert retrieval.prune(g, "topk", 3).count() == 3 and retrieval.prune(g, "ratio", 0.01).count() == 1 and retrieval.prune(g, "threshold", 99.0).count() == 0


def test_ingest_chain_reasons(spark):
    f = spark.createDataFrame([("a", "r", 5, "x"), ("b", "r", 50, "x"), ("c", "r", 4, "x\0"), ("d", "r", 6, "x"), ("e", "r", None, None)], "path string, repo string, bytes long, text string")
    got = {r["path"]: r["reason"] for r in ingest.ingest_chain(f, max_file=20, max_total=10).collect()}
    assert got == {"a": "kept", "b": "size", "c": "binary", "d": "total", "e": "unreadable"}


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("a", 1, "o"), ("b", 5, "o")], "id string, v int, x string")
    new = spark.createDataFrame([("a", 2, "n"), ("b", 4, "n"), (None, 9, "n"), ("c", 1, "n"), ("c", 1, "n")], "id string, v int, x string")
    assert {r["id"]: r["x"] for r in ingest.upsert(old, new, "id", "v").collect()} == {"a": "n", "b": "o", "c": "n"}


def test_page_and_url_states(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "url string, hash string")
    old = spark.createDataFrame([("b", "1"), ("c", None), ("d", "1")], "url string, hash string")
    assert {r["url"]: r["change"] for r in chunking.page_changes(now, old).collect()} == {"a": "added", "b": "updated", "c": "unchanged", "d": "removed"}


def test_sitemap(spark):
    xml = "<urlset><url><loc> https://e.com/a </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://e.com/b</loc><lastmod>soon</lastmod></url></urlset>"
    got = {r["loc"]: r["lastmod"] for r in chunking.sitemap_entries(spark.createDataFrame([(1, xml)], "id int, x string"), "id", F.col("x")).collect()}
    assert got["https://e.com/a"].year == 2024 and got["https://e.com/b"] is None


def test_missing_breaks(spark):
    src = ["switch (x) {", "case 1:", "  a();", "case 2:", "  b();", "  break;", "case 3:", "case 4:", "  return c(); // done", "default:", "  d();", "}"]
    lines = spark.createDataFrame([("m.js", i + 1, t) for i, t in enumerate(src)] + [("n.js", 1, None)], "path string, line_no int, content string")
    assert [(r["path"], r["line_no"]) for r in code.missing_breaks(lines).collect()] == [("m.js", 4)]


def test_hierarchy_links(spark):
    df = spark.createDataFrame([(1, "intro text. " * 30 + "\n\n# A\n\n" + "alpha words. " * 60 + "\n\n## B\n\nbeta"), (2, None), (3, "no heading")], "id int, t string")
    rows = chunking.hierarchy(df, "id", "t").collect()
    by = {r["chunk_id"]: r for r in rows}
    assert len(by) == len(rows) and {r["level"] for r in rows} == {"l1", "l2", "l3"}
    assert all(r["parent_id"] is None if r["level"] == "l1" else r["parent_id"] in by for r in rows)
    assert any(r["level"] == "l3" and by[r["parent_id"]]["content"] == "A" and r["content"].startswith("[A]") for r in rows)
    assert by[next(r for r in rows if r["doc"] == "3" and r["level"] == "l3")["parent_id"]]["level"] == "l1"


def test_resolve_links(spark):
    df = spark.createDataFrame([("https://e.com/a/b", "../c"), ("https://e.com/a/", "//x.org/y"), (None, "z"), ("https://e.com", None)], "base string, link string")
    assert [r["resolved"] for r in chunking.resolve_links(df, "base", "link").collect()] == ["https://e.com/c", "https://x.org/y", None, None]


def test_clones_are_counted_not_paired(spark):
    block = [f"line number {i} of the copied block" for i in range(8)]
    rows = [("a", i + 1, t) for i, t in enumerate(["x", *block, "y"])] + [("b", i + 1, t) for i, t in enumerate([*block, "z"])] + [("c", 1, "alone")]
    got = {(r["path"], r["first_line"], r["lines"], r["files"]) for r in code.clones(spark.createDataFrame(rows, "path string, line_no int, content string")).collect()}
    assert got == {("a", 2, 8, 2), ("b", 1, 8, 2)}
