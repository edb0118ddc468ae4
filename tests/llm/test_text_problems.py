"""Scans, markup, source files, personal data: small fixtures with known cases, and dirty input."""

import datetime as dt
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalode.llm import markup, pii, scans, sources

WORDS = ("the model stores every vector inside nightly index while scheduler reads trusted snapshot then merges partial result under stable gateway "
         "because pruned lexicon counts frequent words across hidden corpus without external template").split()


def page(rng, header, number, n=12):
    body = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(n)]
    return "\n".join(([header] if header else []) + body + ([number] if number else []))


@pytest.fixture(scope="module")
def scan_rows():
    rng = random.Random(1)
    rows = []
    for i in range(12):
        head = "Trusted Snapshot Index" if i % 2 else "Nightly Gateway"
        head = head.upper() if i == 3 else head.replace("o", "0") if i == 5 else head
        rows.append([f"a{i}", page(rng, head, f"- {40 + i} -"), "paper", i])
    rows += [[f"b{i}", page(rng, None, None), "other", i] for i in range(12)]
    return rows


def run_scans(spark, rows):
    df = spark.createDataFrame(rows, "id string, content string, paper string, page int").withColumn("is_page", F.lit(1)).withColumn("key", F.lit("k")).withColumn("h0", F.lit(0))
    out = scans.scan_noise(df, paper=F.col("paper"), index=F.col("page")).collect()
    return {r["id"]: (set(r["defects"]), r["text"]) for r in out}


def test_headers_numbers_misread(spark, scan_rows):
    got = run_scans(spark, scan_rows)
    assert all({"header", "page_number"} <= got[f"a{i}"][0] for i in range(12))
    assert "misread" in got["a5"][0] and "misread" not in got["a3"][0]
    assert all(not got[f"b{i}"][0] for i in range(12))
    assert "Gateway" not in got["a0"][1].split("\n")[0] and "- 40 -" not in got["a0"][1]


def test_broken_words_and_compounds(spark, scan_rows):
    rows = [list(r) for r in scan_rows]
    rows += [["c0", "we read the trus-\nted snapshot under time-\nbounded scheduler", "c", 0], ["c1", "the pruned lexi\u00ad", "c", 1], ["c2", "con counts words", "c", 2],
             ["c4", "we read under time-\n222\nbounded scheduler", "c", 7], ["c5", "we read the trus-\n333\nted snapshot", "c", 8],
             ["c3", "the tlie model st0res every", "c", 3]]
    rows += [[f"t{i}", "every time-bounded scheduler reads the index", "t", i] for i in range(6)]
    got = run_scans(spark, rows)
    assert "hyphenation" in got["c0"][0] and "trusted snapshot" in got["c0"][1] and "time-bounded" in got["c0"][1]
    assert "hyphenation" in got["c1"][0] and "hyphenation" not in got["c2"][0]
    assert "hyphenation" not in got["c4"][0] and "hyphenation" in got["c5"][0] and "trusted" in got["c5"][1]
    assert "misread" in got["c3"][0] and "stores" in got["c3"][1]


def test_scan_dirt(spark, scan_rows):
    rows = [list(r) for r in scan_rows] + [["n1", None, "p", 1], ["n2", "", "p", None], ["n3", "  \n ", "p", 3], [None, "x", "p", 4], ["n4", "x", None, 5], ["n5", "word " * 100_000, "p", 6],
                                           ["n6", "7", "p", 7], ["a0", scan_rows[0][1], "paper", 0]]
    got = run_scans(spark, rows)
    assert "n1" not in got and None not in got and "n4" not in got and {"n2", "n3", "n5", "n6"} <= set(got)
    assert run_scans(spark, []) == {}


def test_fold_is_an_index_for_can_become():
    rng = random.Random(2)
    for w in WORDS * 3:
        seen, i = "", 0
        while i < len(w):
            options = [(a, b) for a, b in scans.CONFUSIONS if w.startswith(a, i)]
            a, b = rng.choice(options) if options and rng.random() < 0.4 else (w[i], w[i])
            seen, i = seen + b, i + len(a)
        assert scans.can_become(w, seen) and scans.fold(w) == scans.fold(seen), (w, seen)


def test_line_model_decides_between_numbers_of_the_page_and_of_the_text(spark):
    words = "the small reader moves a long row of plain words over the table and then stops".split()
    body = lambda i: "\n".join(" ".join(words[(i + j) % 8 : (i + j) % 8 + 6]) for j in range(5))
    rows = [(f"p{i}", "paper", i, f"{body(i)}\n\n{i + 3}") for i in range(8) if i != 5]
    rows.append(("p5", "paper", 5, f"{body(5)}\nand the year in which they came was\n1984"))  # ends with a number of the text
    rows += [(f"q{i}", "other", i, f"The Shape of Long Tables\n{body(i)}") for i in range(2)]  # a title on two pages
    rows += [(f"r{i}", "other", 10 + i, f"Some Words Alone {i}\n{body(i)}") for i in range(2)]
    df = spark.createDataFrame(rows, "id string, paper string, page int, content string")
    got = {r["id"]: r for r in scans.scan_noise(df, paper=F.col("paper"), index=F.col("page")).collect()}
    assert all("page_number" in got[f"p{i}"]["defects"] for i in range(8) if i != 5)
    assert got["p5"]["defects"] == [] and got["p5"]["text"].endswith("1984")
    assert all(got[f"q{i}"]["defects"] == [] and "Shape" not in got[f"q{i}"]["text"] for i in range(2))
    assert all("Alone" in got[f"r{i}"]["text"] for i in range(2))


def test_viterbi_of_many_pages_is_that_of_each():
    model = scans.LineModel()
    pages = [scans.features(t.split("\n"), k % 3, k % 2, k % 3) for k, t in enumerate(["", "A Title\nsome words go on.\n\n12", "3\nwords here and there", "x\n" * 40 + "9", "\n\n"])]
    for f, path in zip(pages, model.labels(pages)):
        best = max(  # brute force over the last step of the recursion would not do: all paths of short pages
            __import__("itertools").product(range(5), repeat=len(f)),
            key=lambda q: model.start[q[0]] + sum(model.moves[a, b] for a, b in zip(q, q[1:])) + sum(t[s, f[i, k]] for i, s in enumerate(q) for k, t in enumerate(model.emit)),
        ) if len(f) <= 5 else None
        assert best is None or tuple(path) == best
    assert [scans.printed_number(x) for x in ("- 12 -", "xiv", "page 3", "IX", "word", "1,2")] == [12, 14, 3, 9, None, None]


@pytest.mark.parametrize("text,want", [
    ("a <b>bold</b> word", {"html"}), ("x &nbsp; y", {"html"}), ("AT&T; R&D", set()), ("A Map<string, number> holds", set()), ("a < 156 and b > 243", set()), ("end <div class=\"note", {"html"}),
    ("# Title\n\ntext", {"markdown"}), ("- 12 -", set()), ("see [it](./x.md)", {"markdown"}), ("Ticket #12 follows", set()), ("set max_size and min_size", set()), ("a * b * c", set()),
    ("== Head ==\ntext", {"wiki"}), ("the [[Link|word]]", {"wiki"}), ("{{note|x}}", {"wiki"}), ("array[[1]", set()), ("x == y", set()),
    ("C:\\temp\\new_1", set()), ("\\emph{x}", {"latex"}), ("cost $ 3 and $ 4 now", set()), ("$x^{2}$", {"latex"}), ("\\[a = b\\]", {"latex"}), ("| a | b |\n| --- | --- |\n| 1 | 2 |", {"markdown"}),
    ("**Notes**", {"markdown"}), ("**Notes*", set()), ("* one\n** two", {"wiki"}), ("text **bold words** text\n**Bold line**", {"markdown"}),
    ("[" + "x" * 900 + "](./x.md)", {"markdown"}), ("{{note|" + "y " * 900 + "z}}", {"wiki"}), ("''" + "z " * 900 + "z''", {"wiki"}), ("$x = " + "a + " * 400 + "a$", {"latex"}),
    ("it costs $ 5 and then $ 6 - or less", set()), ('class="' + "n" * 300 + '">rest of a tag', {"html"}),
    ("", set()), ("plain", set())])
def test_constructs(text, want):
    assert set(markup.constructs(text)) == want


def test_clean_is_idempotent():
    text = "# Head\n\n<ul><li>one</li><li>two</li></ul>\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\ncode()\n```\n\n$\\frac{a}{b} \\leq c$ and **bold** [[w|link]]"
    out = markup.clean(text, markup.constructs(text))
    assert markup.constructs(out) == {} and markup.clean(out, markup.constructs(out)) == out
    for part in ("Head", "• one", "a\tb", "    code()", "(a)/(b) ≤", "bold", "link"):
        assert part in out


def test_style_tree_removes_repeated_branches(spark):
    rows = [(f"p{i}", f"<div class='nav'><p>Home Products Contact</p></div><div class='main'><p>Story {i} about topic {i * 7}</p></div>", None, "host", False) for i in range(12)]
    rows += [("q", "<div class='nav'><p>Home Products Contact</p></div>", None, "lonely", False), ("n", None, None, None, None), ("c", "<b>x</b>", "<i>h</i>", "host", True), ("e", "", "", None, False),
             ("p0", rows[0][1], None, "host", False)]
    df = spark.createDataFrame(rows, "id string, content string, heading string, host string, code boolean").withColumn("path", F.lit(1)).withColumn("noise", F.lit(1)).withColumn("page", F.lit(2))
    out = markup.clean_markup(df, heading=F.col("heading"), host=F.col("host"), is_code=F.col("code")).collect()
    got = {r["id"]: r for r in out}
    assert len(out) == len(rows)
    assert all("Products" not in got[f"p{i}"]["text"] and f"Story {i}" in got[f"p{i}"]["text"] for i in range(12))
    assert "Products" in got["q"]["text"]  # one page tells nothing
    plain = markup.clean_markup(df, heading=F.col("heading"), host=F.col("host"), is_code=F.col("code"), min_pages=10**9).collect()
    assert all("Products" in r["text"] for r in plain if r["id"].startswith("p"))  # without the tree nothing is removed
    assert {r["id"]: r["languages"] for r in plain} == {r["id"]: r["languages"] for r in out}
    assert got["n"]["text"] is None and got["c"]["text"] == "<b>x</b>" and got["c"]["languages"] == [] and got["e"]["text"] == ""
    assert markup.clean_markup(df.limit(0)).count() == 0


def test_markup_long():
    text = "<p>" * 3000 + "x" * 200_000
    assert "x" * 100 in markup.clean(text, markup.constructs(text))


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, repo string, kind string, sha256 string, text string, updated_at timestamp").withColumn("lines", F.lit(1)).withColumn("style", F.lit("s"))


HAND = '''import os

def load_index(path, cache=None):
    """Read the index of the given path and keep what the cache does not hold."""
    names = [n for n in os.listdir(path) if n.endswith(".idx")]
    if not names:
        return cache
    for name in names:
        cache = merge_entry(cache, read_entry(path, name))
    return cache
'''


def test_unwritten(spark):
    t = dt.datetime(2024, 1, 1)
    gen = "// Code generated by x-gen. DO NOT EDIT.\n" + "\n".join(f"  public int getField{i}() {{ return field{i}_; }}" for i in range(20))
    mini = "!function(e,t){" + "".join(f"var a{i}=e[{i}]||{{}},b=!1;if(t==={i}){{n.push(r);return}}" for i in range(40)) + "}"
    data = "const t = [\n" + "\n".join(f"  {i}, {i * 7}, {i * 13}," for i in range(60)) + "\n];"
    blob = "x = '''\n" + "\n".join("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2" for _ in range(20)) + "\n'''"
    lib = ("// This helper keeps the order of all its entries, whatever the load of the machine.\nexport function keepOrder(entries, limit) {\n  const kept = entries.filter((x) => x.rank < limit);\n"
           "  // Ranks that are equal stay in the order in which they came to us from the reader.\n  return kept.sort((a, b) => a.rank - b.rank);\n}\n")
    rows = [("r/a/hand.py", "a", "code", "1", HAND, t), ("r/a/gen.java", "a", " CODE ", "2", gen, t), ("r/a/m.js", "a", "code", "3", mini, t), ("r/a/d.js", "a", "code", "4", data, t),
            ("r/a/blob.py", "a", "code", "5", blob, t), ("r/b/vendor/lib.js", "b", "code", "6", lib, t), ("r/c/src/own.js", "c", "code", "7", lib, t), ("r/a/doc.md", "a", "doc", "8", gen, t),
            ("r/a/null.py", "a", "code", None, None, t), ("r/a/empty.py", "a", "code", None, "", None), (None, "a", "code", None, gen, t), ("r/a/nokind.py", None, None, None, gen, t),
            ("r/a/old.py", "a", "code", "9", gen, t), ("r/a/old.py", "a", "code", "10", "\ufeff" + HAND.replace("\n", "\r\n"), dt.datetime(2024, 2, 1)), ("r/a/old.py", "a", "code", "10", HAND, dt.datetime(2024, 2, 1)),
            ("r/a/long.py", "a", "code", "11", HAND * 300, t), ("r/a/norepo.py", None, "code", "12", HAND, None)]
    got = {r["path"]: r["kinds"] for r in sources.unwritten(files(spark, rows)).collect()}
    assert got["r/a/gen.java"] == ["generated"] and got["r/a/m.js"] == ["minified"] and got["r/a/d.js"] == ["data"] and got["r/a/blob.py"] == ["data"]
    assert got["r/b/vendor/lib.js"] == ["vendored"] and got["r/c/src/own.js"] == ["vendored"]
    for p in ("r/a/hand.py", "r/a/old.py", "r/a/long.py", "r/a/norepo.py"):
        assert got[p] == [], p
    assert not {None, "r/a/doc.md", "r/a/null.py", "r/a/empty.py", "r/a/nokind.py"} & set(got)
    assert sources.unwritten(files(spark, rows).limit(0)).count() == 0


WRITTEN = """def load_reader(source_path, default_encoding):
    reader_options = read_options(source_path)
    if reader_options is None:
        raise ValueError("no options for " + source_path)
    return open_reader(reader_options, default_encoding)
"""


def model_of(texts):
    counts = Counter(("js", g) for t in texts for n in sources.names_of(t) for g in sources.trigrams(n))
    return sources.NameModel(counts)


def test_names_decide_what_is_minified():
    model = model_of([WRITTEN.replace("reader", w) for w in ("reader", "parser", "folder", "window")] * 20)
    one_line = " ".join((WRITTEN * 4).split())  # dense, but with names that somebody wrote
    mangled = ";".join(f"function {a}({b},{c}){{{a}={b}+{c};return {a}({c})}}" for a in "abcdefg" for b in "xyz" for c in "uvw")
    assert sources.judge(mangled, "r/src/a.js", model)[0] == ["minified"]
    assert "minified" not in sources.judge(one_line, "r/src/a.js", model)[0]
    assert "minified" not in sources.judge(mangled, "r/src/a.js", sources.NameModel({}))[0]  # without the model nothing is


def test_attribution_below_a_long_licence():
    licence = "/*\n" + "\n".join(f" * clause {i} of the terms under which this may be used" for i in range(60)) + "\n * taken from the Gantry project\n */\n"
    body = "\n".join(f"export function step{i}(value) {{ return value * {i} + other{i}; }}" for i in range(3))
    model = model_of([WRITTEN])
    kinds, foreign = sources.judge(licence + body, "r/src/a.js", model)
    assert foreign and "vendored" in kinds
    assert sources.judge(body + "\n" + "\n" * 3 + licence, "r/src/a.js", model)[1] is False


def test_only_the_present_row_counts(spark):
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    blob = "\n".join("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVoxMjM0NTY3ODkwYWJjZGVmZ2g=" * 2 for _ in range(20))
    rows = [("emptied", "r", "code", "1", blob, a), ("emptied", "r", "code", "2", None, b), ("grown", "r", "code", "1", "x = 1", a), ("grown", "r", "Code ", "2", blob, b), ("moved", "r", "code", "1", blob, a), ("moved", "r", "doc", "2", blob, b)]
    got = {r["path"]: r["kinds"] for r in sources.unwritten(files(spark, rows)).collect()}
    assert got == {"grown": ["data"]}


def test_lines_are_counted_by_repository_exactly(spark):
    lines = [f"the ranks of group {i} stay in the order in which they came to us from reader {i}" for i in range(4)]
    own = lambda n: "\n".join(lines + [f"const x{n} = {n};"])
    two = ("web/paper-index", "kestrel-lab/amber-reader")  # alike for a sketch of 512 registers
    t = dt.datetime(2024, 1, 1)
    rows = [("r/a/vendor/x.js", two[0], "code", "1", own(1), t), ("r/b/src/x.js", two[1], "code", "2", own(2), t)]
    got = {r["path"]: r["kinds"] for r in sources.unwritten(files(spark, rows)).collect()}
    assert got == {"r/a/vendor/x.js": ["vendored"], "r/b/src/x.js": ["vendored"]}


D = pii.Detector()


@pytest.mark.parametrize("text", [
    "plus four nine one five one two three four five six eight", "Plus Four Nine One Five One Two Three Four Five Six Eight",
    "plus four nine oh five one two three four five ſix eight", "plus vier neun eins fünf eins zwei drei vier fünf sechs acht", "plus quatre neuf un cinq un deux trois quatre cinq six huit",
    "más cuatro nueve uno cinco uno dos tres cuatro cinco seis ocho", "plus-four-nine-one-five-one-two-three-four-five-six-eight"])
def test_spelled_numbers_without_zero_and_seven(text):
    assert [(k, text[a:b]) for a, b, k in D.find(text)] == [("phone", text)]


@pytest.mark.parametrize("text,want", [
    ("mail ann.lee@post.example now", [("email", "ann.lee@post.example")]), ("a.b [at] c [dot] example", [("email", "a.b [at] c [dot] example")]),
    ("write to ann at post dot example today", [("email", "ann at post dot example")]), ("аnn@pоst.example", [("email", "аnn@pоst.example")]),
    ("git@code.example:a/b.git icon@2x.png x@1.2.3", []), ("call +49 30 23125 437.", [("phone", "+49 30 23125 437")]), ("ring (760) 555-0192", [("phone", "(760) 555-0192")]),
    ("Build 772-277-2025 on 10.0.72.25", []), ("2025-04-08T10:23:00Z", []), ("plus four four seven seven zero zero nine zero zero one two three", [("phone", "plus four four seven seven zero zero nine zero zero one two three")]),
    ("id 00 742 693 780;", [("id_number", "00 742 693 780")]), ("X0049479J", [("id_number", "X0049479J")]), ("925-63-7020 ok", [("id_number", "925-63-7020")]),
    ("at Lindenstraße 12b, 10115 Berlin, then", [("address", "Lindenstraße 12b, 10115 Berlin")]), ("12 Mill Lane, Apt 4, Oxford.", [("address", "12 Mill Lane, Apt 4, Oxford")]),
    ("121 bis, rue des Lilas, 75011 Paris", [("address", "121 bis, rue des Lilas, 75011 Paris")]), ("Calle Mayor 3, 2º A, 28013 Madrid", [("address", "Calle Mayor 3, 2º A, 28013 Madrid")]),
    ("by Anna Berg today", [("name", "Anna Berg")]), ("Berg, Anna wrote", [("name", "Berg, Anna")]), ("ANNA BERG-LUND", [("name", "ANNA BERG-LUND")]), ("and K. Berg.", [("name", "K. Berg")]),
    ("Release \"Amber Kestrel\" follows", []), ("Most Teams Read", []), ("", [])])
def test_detect(text, want):
    assert [(k, text[a:b]) for a, b, k in D.find(text)] == want


def test_digit_words_that_are_no_number():
    for text in ("one two three go", "one of the two, three of six, four or five, and then seven of eight", "一二三"):
        assert D.find(text) == []
    assert pii.rewrite("电话 四九一五一二三四五六八 号").text == "电话 49151234568 号"


def test_names_that_no_list_knows(spark):
    verbs = ("met", "asked", "thanked", "called", "joined", "saw")
    given, family = "Anna Bruno Clara Dario Emma Felix Greta Henrik".split(), [a + b for a in ("Nor", "Wel", "Kast", "Brim", "Dun", "Orl") for b in ("dal", "mark", "holt", "beck", "sen")]
    rows = [(f"we {verbs[i % 6]} {given[i % 8]} {family[i % 30]} and then the others came to the table",) for i in range(240)]
    rows += [(f"# Stable Index\nthe Falcon Lake dataset and the Amber Kestrel release were {verbs[i % 6]} by us",) for i in range(240)]
    tagger = pii.fit_tagger(spark.createDataFrame(rows, "text string"))
    find = lambda t: [t[a:b] for a, b, k in pii.Detector(tagger=tagger).find(t) if k == "name"]
    assert find("we met Aoife Brennan and then the others left") == ["Aoife Brennan"] and find("we asked Siobhan O'Neill and went") == ["Siobhan O'Neill"]
    assert find("the Falcon Lake dataset and the Amber Kestrel release") == [] and find("# Stable Index\nthe rest") == []
    assert pii.Detector().find("we met Aoife Brennan and then the others left") == []  # the model decides, not the list
    assert pii.fit_tagger(spark.createDataFrame([("Nothing Here",), (None,)], "text string")) is None


def test_many_spans_in_one_text():
    began = time.time()
    found = D.find("at Lindenstraße 12, 10115 Berlin, by Anna Berg; " * 4000)
    assert len(found) == 8000 and time.time() - began < 8


def test_scrub_dirt(spark):
    long = "word " * 100_000 + "Anna Berg"
    rows = [(1, None, "a"), (2, "", "b"), (3, long, None), (4, "\U0001f600 Anna Berg, a@b.example", "c"), (None, "x@y.example", "d"), (4, "\U0001f600 Anna Berg, a@b.example", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string").withColumn("clean", F.lit(1))
    out = pii.scrub(df)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["clean"] is None and got[2]["clean"] == "" and got[3]["clean"].endswith("[NAME]")
    assert got[4]["clean"] == "\U0001f600 [NAME], [EMAIL]"
    assert [(s["pii_type"], s["start_pos"]) for s in got[4]["spans"]] == [("name", 3), ("email", 14)]
    assert pii.occurrences(out).distinct().count() == 4 and pii.scrub(df.limit(0)).count() == 0


def test_redaction_keeps_the_rest():
    text = "before ann [at] post [dot] example after"
    assert pii.redact(text, D.find(text)) == "before [EMAIL] after"
    assert re.fullmatch(r"x\u200b \[EMAIL\] y", pii.redact("x\u200b ann@po\u200bst.example y", D.find("x\u200b ann@po\u200bst.example y")))
