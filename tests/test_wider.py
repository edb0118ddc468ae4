import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from stratalode.operators import chunking, crawl, memory, outline, retrieval, search
from stratalode.sources import archives

PY = '''import os

class Reader(Base, Mixin):
    """Reads."""

    def open(self, path, mode="r"):
        """Opens."""
        if path and mode or path:
            for part in path:
                while part:
                    part = part[1:]
        elif mode:
            return self.open(path)
        return path

    def _never(self):
        return 1


def helper(first, second, _third):
    value = first
    return Reader(value)
'''
JS = '''/**
 * Adds.
 * @param {number} left the left one
 * @param {number} gone
 */
export function add(left, right) {
  const sum = left + right;
  const idle = 3;
  if (sum > 3 && left < 2) {
    return sum;
  } else {
    switch (right) {
      case 1: return left;
    }
  }
  return add(sum, 1);
}

class Box extends Frame {
  size(width: number, height: number): number {
    return width;
  }
}
const short = (a, b) => a;
'''


def by_name(text):
    return {s["name"]: s for s in outline.symbols_of(text)}


def test_symbols_with_parents_and_extents():
    s = by_name(PY)
    assert [(k, v["kind"], v["parent"]) for k, v in s.items()] == [("Reader", "class", None), ("open", "method", "Reader"), ("_never", "method", "Reader"), ("helper", "function", None)]
    assert s["Reader"]["bases"] == ["Base", "Mixin"] and (s["open"]["first_line"], s["open"]["last_line"]) == (6, 14)
    assert s["open"]["params"] == ["path", "mode"] and s["helper"]["params"] == ["first", "second", "_third"]
    j = by_name(JS)
    assert j["size"]["parent"] == "Box" and j["Box"]["bases"] == ["Frame"] and j["size"]["params"] == ["width", "height"] and j["short"]["params"] == ["a", "b"]
    assert (j["add"]["first_line"], j["add"]["last_line"]) == (6, 17)
    assert outline.symbols_of("") == [] and outline.symbols_of("((((") == []


def test_cognitive_complexity():
    # if 1, and/or 2, for 2, while 3, elif 1, recursion 1
    assert by_name(PY)["open"]["cognitive"] == 10
    # if 1, && 1, else 1, switch 2, recursion 1
    assert by_name(JS)["add"]["cognitive"] == 6
    assert by_name("def f(a):\n    return a\n")["f"]["cognitive"] == 0


@pytest.fixture(scope="module")
def symbols(spark):
    df = spark.createDataFrame([("r/a.py", PY), ("r/b.ts", JS), ("r/c.py", None), ("r/d.py", "")], "path string, text string").withColumn("kind", F.lit("x")).withColumn("name", F.lit("y"))
    return outline.symbols(df).cache()


def test_relations_over_symbols(spark, symbols):
    g = {(r["src"], r["dst"], r["relation"]) for r in outline.graph(symbols).collect()}
    assert ("r/a.py#Reader", "r/a.py#Reader.open", "contains") in g and ("r/a.py#helper", "r/a.py#Reader", "calls") in g and ("r/b.ts", "r/b.ts#add", "contains") in g
    u = {tuple(r) for r in outline.unused(symbols).collect()}
    assert ("r/a.py", "helper", "unused-parameter", "second") in u and ("r/b.ts", "add", "unused-local", "idle") in u and ("r/a.py", "_never", "unused-private", "_never") in u
    assert not any(x[3] in ("_third", "first", "sum", "left") for x in u)
    d = {tuple(r)[1:] for r in outline.documentation(symbols).collect()}
    assert {("add", "missing-parameter", "right"), ("add", "unknown-parameter", "gone"), ("add", "bare-parameter", "gone"), ("add", "missing-result", "return")} <= d
    assert ("helper", "no-documentation", "helper") in d and not any(x[0] == "open" for x in d)
    assert {tuple(r) for r in outline.method_parents(symbols).collect()} == {("r/a.py", "open", "Reader"), ("r/a.py", "_never", "Reader"), ("r/b.ts", "size", "Box")}


def test_references_and_extension_points(spark, symbols):
    lines = spark.createDataFrame([("r/x.py", 3, "y = helper(1)"), ("r/a.py", 19, "def helper(first)"), ("r/x.py", 4, "help()")], "path string, line_no int, content string")
    got = {(r["path"], r["line_no"], r["defines"]) for r in outline.references(lines, symbols).where("name = 'helper'").collect()}
    assert {(p, n) for p, n, _ in got} == {("r/x.py", 3), ("r/a.py", 19)}
    files = spark.createDataFrame([("a.ts", "export type Mode = 'a' | 'b';\ninterface Opts {\n  onDone?: (x: number) => void;\n}\nclass Store<T extends Row> {}\nabstract class Base {}"), ("b.py", "class P(Protocol):\n    pass"), ("c.rs", "pub trait Show {}")], "path string, text string")
    assert {(r["kind"], r["name"]) for r in outline.extension_points(files).collect()} == {
        ("union-type", "Mode"), ("interface", "Opts"), ("optional-callback", "onDone"), ("bounded-generic", "Store"), ("abstract-class", "Base"), ("protocol", "P"), ("trait", "Show")}


MD = "intro\n\n# One\n\ntext\n\n## Two\n\n```py\n# no heading\n```\n\n#### Deep\n\nmore\n\n# Three\n\n| a | b |\n"


def test_chunks_by_level_and_scale():
    rows = chunking.by_level(MD, 2)
    assert [(r[0], r[2], r[4], r[5], r[6]) for r in rows] == [("section", "One", 3, 5, None), ("section", "Two", 7, 15, None), ("code", "Two", 9, 11, 1), ("section", "Three", 17, 19, None), ("table", "Three", 19, 20, 3)]
    scales = chunking.multi_scale(MD)
    assert [(r[0], r[3]) for r in scales if r[7] is None] == [(1, "One"), (1, "Three"), (2, "Two"), (4, "Deep")]
    assert all(scales[r[7]][7] is None for r in scales if r[7] is not None)
    assert chunking.by_level("", 2) == [] and chunking.multi_scale("no heading") == []
    parts = chunking.segments("a b\n\n```\nx\n```\n\nc d\n\n" + "word " * 3000)
    out = chunking.adaptive(parts)
    assert [p[0] for p in out[:2]] == ["text", "code"] and all(chunking.tokens(p[1]) <= chunking.MAX_TOKENS for p in out)
    pieces = chunking.split_long("é" * 3 + "wordwithoutend" * 400 + " and an end", 100)
    assert "".join(pieces).replace(" ", "") == ("é" * 3 + "wordwithoutend" * 400 + " and an end").replace(" ", "")
    assert all(not p[0].isspace() and len(p) <= 400 for p in chunking.split_long("some words " * 500, 100))


def test_level_chunks_frame(spark):
    df = spark.createDataFrame([("d", MD, "Paper"), ("n", None, "x"), (None, MD, "y")], "id string, t string, paper string")
    got = chunking.level_chunks(df, "id", "t", paper_col="paper").collect()
    ids = {r["chunk_id"] for r in got}
    assert len(ids) == len(got) and all(r["parent_id"] is None or r["parent_id"] in ids for r in got)
    assert got[0]["content"].startswith("[Paper][One][SECTION] # One")


def test_raw_queries(spark):
    assert search.parse_query("a AND (b OR \"c d\") NOT e") == ("and", ["a"], ("not", ("or", ["b"], ["c", "d"]), ["e"]))
    assert search.parse_query("a b") == ("and", ["a"], ["b"])
    for bad in ("", "a AND", "(a", "a)", "NOT", '""'):
        with pytest.raises(ValueError):
            search.parse_query(bad)
    lines = spark.createDataFrame([("f", 1, "Alpha beta gamma"), ("f", 2, "beta alpha"), ("f", 3, "alpha delta"), ("f", 4, None)], "path string, line_no int, content string")
    found = lambda q: sorted(r["line_no"] for r in search.raw_search(lines, q).collect())
    assert found('fts:"alpha beta"') == [1] and found("alpha NOT (gamma OR delta)") == [2] and found("alpha AND beta") == [1, 2]


def test_incremental_index_counts_present_states_only(spark, tmp_path):
    from stratalode.core.manifest import ManifestStore

    store = ManifestStore(spark, f"file://{tmp_path}/index")
    files = lambda rows: spark.createDataFrame(rows, "path string, bytes bigint, sha256 string, text string")
    search.update_index(store, files([("a", 1, "1", "old words"), ("b", 1, "1", "kept words")]))
    search.update_index(store, files([("a", 1, "2", "new words"), ("b", 1, "1", "kept words")]))
    assert search.update_index(store, files([("a", 1, "2", "new words"), ("b", 1, "1", "kept words")])) is None
    assert {r["term"]: r["files"] for r in search.indexed_terms(store).collect()} == {"new": 1, "words": 2, "kept": 1}


def test_robots_and_breadth_first(spark):
    o = "https://a.example"
    robots = crawl.robots_rules(spark.createDataFrame([(o, "User-agent: x\nDisallow: /\nUser-Agent: *\nDisallow: /no # comment\nAllow: /\n")], "o string, t string"), "o", F.col("t"))
    assert [tuple(r) for r in robots.collect()] == [(o, "/no")]
    pages = spark.createDataFrame([(f"{o}/1", [f"{o}/2", f"{o}/no/3", f"{o}/9"]), (f"{o}/2", [f"{o}/1", f"{o}/4"]), (f"{o}/no/3", [f"{o}/4"]), (f"{o}/4", None), ("http://localhost/5", [])], "url string, links array<string>")
    got = {r["url"]: r["depth"] for r in crawl.breadth_first(pages, spark.createDataFrame([(f"{o}/1",), ("http://localhost/5",), (None,)], "url string"), robots=robots).collect()}
    assert got == {f"{o}/1": 0, f"{o}/2": 1, f"{o}/4": 2}
    assert crawl.breadth_first(pages, spark.createDataFrame([(f"{o}/1",)], "url string"), max_pages=2).count() == 2


def test_sitemap_index(spark):
    o = "https://a.example"
    files = spark.createDataFrame([
        (f"{o}/sitemap.xml", f"<sitemapindex><sitemap><loc>{o}/m1.xml</loc></sitemap><sitemap><loc>{o}/m2.xml</loc></sitemap><sitemap><loc>{o}/gone.xml</loc></sitemap></sitemapindex>"),
        (f"{o}/m1.xml", f"<urlset><url><loc>{o}/p</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://b.example/q</loc></url></urlset>"),
        (f"{o}/m2.xml", f"<sitemapindex><sitemap><loc>{o}/m3.xml</loc></sitemap></sitemapindex>"), (f"{o}/m3.xml", f"<urlset><url><loc>{o}/r</loc><lastmod>never</lastmod></url></urlset>")], "url string, xml string")
    assert {r["url"]: str(r["lastmod"])[:10] for r in crawl.sitemap_urls(files, f"{o}/sitemap.xml").collect()} == {f"{o}/p": "2024-01-02", f"{o}/r": "None"}
    assert {r["url"] for r in crawl.sitemap_urls(files, f"{o}/sitemap.xml", most=2).collect()} == {f"{o}/p"}


def test_conditional_and_quick_check(spark):
    state = spark.createDataFrame([("a", "t1", None, "h"), ("b", None, None, "h"), ("c", None, "m", "h")], "url string, etag string, modified string, hash string")
    answers = spark.createDataFrame([("a", "HEAD", 200, "t1", None, None), ("b", "GET", 200, None, None, "x"), ("c", "HEAD", 501, None, None, None), ("d", "GET", 200, None, None, "h"), ("e", "GET", None, None, None, None), ("f", "GET", 410, None, None, None)],
                                    "url string, method string, status int, etag string, modified string, hash string")
    assert {r["url"]: r["outcome"] for r in crawl.conditional(state, answers).collect()} == {"a": "unchanged", "b": "changed", "c": "ask again", "d": "new", "e": "failed", "f": "gone"}
    sample = crawl.quick_sample(state.withColumn("depth", F.lit(1)))
    assert sample.count() == 3 and not crawl.quick_changed(sample, state) and crawl.quick_changed(sample, state.where("url <> 'b'"))


def test_best_pages(spark):
    rows = [(1, "a", "x" * 500), (1, "b", "# Head\n\n" + "x" * 480), (2, "a", None), (2, "b", "short"), (3, "b", "same " * 20), (3, "a", "same " * 20), (4, "a", "Here is the extracted text " * 20), (4, "b", "plain " * 12)]
    got = {r["page"]: r["reader"] for r in crawl.best_pages(spark.createDataFrame(rows, "page int, reader string, text string")).collect()}
    assert got == {1: "b", 2: "b", 3: "a", 4: "b"}


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k.replace("__", "/").replace("_xml", ".xml"), v)
    return out.getvalue()


def test_archives_and_documents(spark):
    bad = zipped(root__a="text", root__b=b"\xff\xfe\x00")
    escape = io.BytesIO()
    with zipfile.ZipFile(escape, "w") as z:
        z.writestr("root/../../etc", "x")
    df = spark.createDataFrame([("one", bytearray(bad)), ("two", bytearray(b"no zip")), ("three", bytearray(escape.getvalue())), ("four", None)], "path string, content binary")
    got = {(r["archive"], r["path"], r["text"], r["error"]) for r in archives.archive_members(df).collect()}
    assert got == {("one", "a", "text", None), ("one", "b", None, "binary"), ("two", None, None, "no archive"), ("three", "root/../../etc", None, "path")}
    w = 'xmlns:w="w"'
    docx = zipped(word__document_xml=f"<w:document {w}><w:p><w:t>Hello </w:t><w:t>world</w:t></w:p><w:p><w:t>Next</w:t></w:p></w:document>")
    pptx = zipped(ppt__slides__slide2_xml="<s><p><t>B</t></p></s>", ppt__slides__slide1_xml="<s><p><t>A</t></p></s>")
    xlsx = zipped(xl__sharedStrings_xml="<sst><si><t>name</t></si></sst>", xl__worksheets__sheet1_xml='<w><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>')
    assert [archives.office_text(x) for x in (docx, pptx, xlsx, b"x", None, zipped(a="b"))] == ["Hello world\nNext", "A\n\nB", "name\t7", None, None, None]
    stream = zlib.compress(b"BT (Scanned \\(once\\)) Tj T* [(Wo) -20 (rds) -300 (apart)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj\nstream\n" + stream + b"\nendstream\n"
    assert archives.pdf_text(pdf) == "Scanned (once)\nWords apart" and archives.pdf_text(b"%PDF-1.4") is None and archives.pdf_text(b"text") is None
    files = spark.createDataFrame([("a.docx", bytearray(docx)), ("b.pdf", bytearray(pdf)), ("c.md", bytearray(b"# x")), ("d.bin", bytearray(b"\0\1")), ("e.docx", None)], "path string, content binary")
    assert {r["path"]: (r["parser"], r["text"]) for r in archives.parse(files).collect()} == {
        "a.docx": ("office", "Hello world\nNext"), "b.pdf": ("pdf", "Scanned (once)\nWords apart"), "c.md": ("text", "# x"), "d.bin": ("text", None), "e.docx": ("office", None)}


def test_search_address():
    got = archives.search_address("https://x.example/api", "dense index", categories=["cs.IR", "cs.CL"], since="20240101")
    assert "all%3Adense+AND+all%3Aindex+AND+%28cat%3Acs.IR+OR+cat%3Acs.CL%29" in got and "20240101" in got


def test_near_existing(spark):
    rows = [("a", "s", "u", [1.0, 0.0]), ("b", "s", "u", [0.99, 0.05]), ("c", "s", "other", [1.0, 0.0]), ("d", "s", "u", None), ("e", "s", "u", [0.0, 1.0]), ("z", "s", "u", [0.0, 0.0]), ("l", "s", "u", [1.0])]
    m = spark.createDataFrame(rows, "id string, layer string, user_id string, vector array<float>")
    for block in (1, 4096):
        got = {(r["id"], r["existing"]) for r in memory.near_existing(m.where("id in ('a', 'e')"), m, block=block).collect()}
        assert got == {("a", "b")}
    assert memory.near_existing(m.limit(0), m).count() == 0


def test_listing_by_the_first_key_that_meets(spark):
    rows = [("1", "l1", "h1", "r", "b", None), ("2", "l1", None, "r", "b", None), ("3", "l3", "h1", "r", "b", None), ("4", "l3", "h9", "r", "b", None), ("5", "l2", None, None, "b", "p"), ("6", "l1", None, None, None, "p")]
    c = spark.createDataFrame(rows, "id string, level string, content_hash string, repo_id string, bundle_id string, paper_id string")
    assert {r["key"]: (r["l1"], r["l2"], r["l3"]) for r in retrieval.list_by_keys(c).collect()} == {"hash:h1": (1, 0, 1), "repo:r": (1, 0, 1), "paper:p": (1, 1, 0)}


def test_pages_of_a_list(spark):
    rows = spark.createDataFrame([(i,) for i in range(7)], "i int")
    p = lambda o: [(r["i"], r["has_more"]) for r in memory.page(rows, [F.col("i")], 3, o).orderBy("i").collect()]
    assert p(0) == [(0, True), (1, True), (2, True)] and p(6) == [(6, False)] and p(4) == [(4, False), (5, False), (6, False)] and p(9) == []
    with pytest.raises(ValueError):
        retrieval.retrieve(rows, "none", "", [0.0], 1)


def test_layout_kinds(spark):
    rows = [(1, 50.0, 10.0, 18.0, "Serif", "The Title"), (1, 50.0, 30.0, 10.0, "Serif", "ordinary words of a line"), (1, 50.0, 40.0, 10.0, "Serif", "more words"), (1, 50.0, 45.0, 10.0, "Serif", "and more"),
            (1, 50.0, 50.0, 10.0, "Courier", "x = f(y)"), (1, 50.0, 60.0, 10.0, "Serif", "a"), (1, 150.0, 60.2, 10.0, "Serif", "b"), (1, 250.0, 60.0, 10.0, "Serif", "c"), (1, 50.0, 70.0, 10.0, "Serif", "a = (b + c)"), (1, 50.0, 80.0, 10.0, "Serif", " ")]
    from stratalode.operators import documents

    got = {r["line"]: (r["kind"], r["text"]) for r in documents.layout_kinds(spark.createDataFrame(rows, "page int, x double, y double, size double, font string, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {10: "heading", 30: "text", 40: "text", 45: "text", 50: "code", 60: "table", 70: "formula"} and got[60][1] == "a b c"


def test_token_uncertainty(spark):
    from stratalode.functions import vector as V

    rows = [(["<s>", "a"], [[0.0, -9.0], [-1.0, -1.0]]), (["a"], [[-0.1]]), (["<s>"], [[-1.0, -1.0]]), ([], [])]
    df = spark.createDataFrame(rows, "t array<string>, l array<array<double>>")
    assert [None if r[0] is None else round(r[0], 6) for r in df.select(V.token_uncertainty(F.col("t"), F.col("l"))).collect()] == [1.0, 0.0, None, None]


def test_answers_are_tried_again(spark):
    rows = [(f"c{i:02d}", "filler words only.", 1.0 - i / 100) for i in range(7)] + [("z", "Other words. The gateway validates the snapshot. More.", 0.1)]
    df = spark.createDataFrame(rows, "id string, content string, score double")
    assert retrieval.answer(df, "gateway validates snapshot", k=2, step=3) == ("The gateway validates the snapshot.", 1.0, 8)
    assert retrieval.answer(df, "nowhere", k=2)[1:] == (0.0, 8) and retrieval.answer(df.limit(0), "x y", k=2)[0] == ""


def test_sitemap_changes_and_full_crawls(spark):
    import datetime as dt

    t = dt.datetime
    site = spark.createDataFrame([("a", t(2024, 2, 1)), ("b", t(2024, 1, 1)), ("c", None), ("d", t(2024, 1, 1))], "url string, lastmod timestamp")
    state = spark.createDataFrame([("a", t(2024, 1, 15)), ("b", t(2024, 1, 15)), ("c", t(2024, 1, 15))], "url string, fetched_at timestamp")
    assert {r["url"] for r in crawl.changed_in_sitemap(site, state).collect()} == {"a", "c", "d"}
    sites = spark.createDataFrame([("x", t(2024, 1, 1)), ("x", t(2024, 1, 9)), ("y", None), ("z", t(2024, 1, 1))], "site string, full_at timestamp")
    assert {r["site"]: r["due"] for r in crawl.full_due(sites, F.lit("2024-01-10").cast("timestamp")).collect()} == {"x": False, "y": True, "z": True}


def test_card_merge_and_relations(spark):
    from stratalode.operators import overview

    old = spark.createDataFrame([("r", "A", ["x"]), ("only", None, None)], "repo string, name string, tags array<string>")
    new = spark.createDataFrame([("r", None, ["y", "x"]), ("fresh", "B", [])], "repo string, name string, tags array<string>")
    assert {tuple(map(str, r)) for r in overview.merge_cards(old, new).collect()} == {("r", "A", "['x', 'y']"), ("only", "None", "[]"), ("fresh", "B", "[]")}
    e = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "entity string")
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d")], "src string, dst string")
    assert {r["entity"]: r["distance"] for r in overview.related(e, links, "a", 2).collect()} == {"a": 0, "b": 1, "c": 2}


def test_streams_of_several_batches(spark, tmp_path):
    import datetime as dt

    from stratalode.streaming import access

    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [("u", "x", t(1, 0)), ("u", "x", t(1, 20)), ("u", "y", t(1, 40)), ("u", "x", t(3, 0)), ("v", "y", t(1, 59))]
    events = spark.createDataFrame(rows, "user_id string, event_type string, ts timestamp")
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    got = {(r["start"].hour, r["event_type"]): r["n"] for r in access.drain_windows(spark, f"{tmp_path}/events").collect()}
    assert got == {(1, "x"): 2, (1, "y"): 2, (3, "x"): 1}
    assert sorted((r["user_id"], r["n"]) for r in access.drain_sessions(spark, f"{tmp_path}/events").collect()) == [("u", 1), ("u", 3), ("v", 1)]
