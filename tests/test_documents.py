import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratalode.operators import documents, ingest
from stratalode.sources import files, seams
from stratalode.streaming import access


def test_html_to_markdown():
    html = "<html><head><title>t</title></head><body><nav>menu</nav><main><h2>Head</h2><p>a <b>b</b> <a href='x'>l</a></p><ul><li>one<ul><li>in</li></ul></li></ul><pre>code  x</pre><table><tr><th>h</th></tr><tr><td>1|2</td></tr></table></main></body></html>"
    md = documents.to_markdown(html)
    for part in ("## Head", "a **b** [l](x)", "- one", "  - in", "```\ncode  x\n```", "| h |\n| --- |\n| 1\\|2 |"):
        assert part in md
    assert "menu" not in md and documents.to_markdown("") == ""


@pytest.mark.parametrize("text,want", [('```json\n{"a": 1}\n```', 1), ('so {"a": 2,} ok', 2), ("{'a': 3}", 3), ("{“a”: 4}", 4), ("nothing", None), ("", None), (None, None)])
def test_model_json(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(documents.parse_model_json(F.col("t"), "a int").alias("x")).first()["x"]
    assert (r["a"] if r else None) == want


def test_wrapped_lines(spark):
    df = spark.createDataFrame([(1, "The line goes\non here.\n12\nsee https://e.com/a/\nb-c\n\n- item\nNext"), (2, None), (3, "")], "id int, t string")
    got = {r["doc"]: r["text"] for r in documents.merge_wrapped(df, "id", "t").collect()}
    assert got == {"1": "The line goes on here.\nsee https://e.com/a/b-c\n\n- item\nNext", "3": ""}


def test_cursors():
    c = documents.encode_cursor(25, "list", now_ms=1000)
    assert documents.decode_cursor(c, "list", now_ms=2000)["offset"] == 25
    assert documents.decode_cursor(c, "other", now_ms=2000) is None and documents.decode_cursor(c, "list", now_ms=10**12) is None and documents.decode_cursor("%%", "list") is None


def test_examples_skip_trivial_tokens_only(spark):
    df = spark.createDataFrame([("a", "def test_password():\n    assert bypass(password, user) == expected_value"), ("b", "def test_nothing_at_all_here():\n    pass\n    # and more text"),
                                ("c", "def test_password():\n    assert bypass(password, user) == expected_value")], "path string, code string")
    got = documents.examples(df).collect()
    assert [(r["path"], r["category"]) for r in got] == [("a", "assertion")]


def test_examples_are_all_kept(spark):
    rows = [(f"p{i}", f"run job{i} --now --again --and --again") for i in range(60)] + [("s", "run x ".ljust(20, "-"))]
    df = spark.createDataFrame(rows + [("t", "run y ".ljust(19, "-"))], "path string, code string")
    assert {r["path"] for r in documents.examples(df).collect()} == {p for p, _ in rows}
    assert documents.examples(df, most_per_category=5).count() == 5


def test_read_tree(spark, tmp_path):
    for p, b in (("src/a.py", b"x = 1\r\n"), ("README.md", b"\xef\xbb\xbfhello"), ("node_modules/m.js", b"no"), ("bin.dat", b"a\0b"), ("latin.txt", b"caf\xe9"), ("big.txt", b"y" * 600_000)):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b)
    got = {r["repo_relative_path"]: r for r in files.read_tree(spark, str(tmp_path), "own").collect()}
    assert set(got) == {"src/a.py", "README.md"}
    assert got["src/a.py"]["text"] == "x = 1\n" and got["src/a.py"]["kind"] == "code" and got["README.md"]["kind"] == "doc"


def test_seams():
    a, b, c, d = seams.hashed_embedding(["hello world", "Hello  World", None, ""])
    assert a == b and c is None and not any(d) and abs(sum(x * x for x in a) - 1) < 1e-5
    with pytest.raises(KeyError):
        seams.provider("embedding", "remote")


def test_stream_counts_once(spark, tmp_path):
    rows = [(i, i % 3, dt.datetime(2024, 1, 1, i % 24)) for i in range(60)]
    src = tmp_path / "in"
    spark.createDataFrame(rows[:30], "event_id int, user_id int, ts timestamp").write.parquet(str(src / "a.parquet"))
    out = str(tmp_path / "out")
    access.merge_batches(access.read_events(spark, str(src / "a.parquet")), out)
    access.merge_batches(access.read_events(spark, str(src / "a.parquet")), out)  # nothing new
    assert {r["user_id"]: r["n"] for r in access.totals(spark, out).collect()} == {0: 10, 1: 10, 2: 10}


def test_memory_stream_window(spark, tmp_path):
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 5)), ("a", dt.datetime(2024, 1, 1, 0, 6)), ("b", dt.datetime(2024, 1, 1, 3, 0))], "event_type string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "s.parquet"))
    w = access.windows(access.read_events(spark, str(tmp_path / "s.parquet")))
    q = w.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["event_type"], r["n"]) for r in spark.sql("select event_type, n from win").collect()} == {("a", 2), ("b", 1)}


def test_config_patterns(spark):
    keys = spark.createDataFrame([("a", "db.host"), ("a", "db.port"), ("a", "db_user"), ("b", "host")], "path string, key string")
    got = {(r["path"], r["pattern"]) for r in documents.config_patterns(keys).collect()}
    assert ("a", "database_config") in got and ("a", "server_config") in got and not any(p == "b" and c != "auth_config" for p, c in got)


def test_present_ties(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("p", "1", t), ("p", "2", t), ("p", "0", None), (None, "9", t), ("q", None, None)], "path string, sha256 string, updated_at timestamp")
    assert {(r["path"], r["sha256"]) for r in ingest.present(df).collect()} == {("p", "2"), ("q", None)}
