"""Queries of full-text search over the lines of the present files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest, search
from ..session import table, workspace
from .q_ingest import _LINES

QUERY = "lockfile snapshot gateway"
PHRASE_QUERY = "index.normaliser shard"
CLAIM = "the snapshot gateway supports the lockfile"


def _lines(spark, d):
    return ingest.lines(ingest.present(table(spark, d, "files")))


def x3_bm25(spark, d):
    return search.bm25(_lines(spark, d), QUERY).withColumn("score", F.round("score", 6))


def x3_phrases(spark, d):
    """A token with punctuation is a phrase of its terms."""
    return search.bm25(_lines(spark, d), PHRASE_QUERY).withColumn("score", F.round("score", 6))


def x3_indexed(spark, d):
    """The same ranking from the durable inverted index."""
    root = workspace(spark, "index")
    search.write_index(_lines(spark, d), root)
    return search.bm25_indexed(spark, root, QUERY).withColumn("score", F.round("score", 6))


def w1_top_lines(spark, d):
    hits = search.bm25(_lines(spark, d), QUERY).withColumn("score", F.round("score", 6))
    return search.top(hits, 20)


def x4_grouped(spark, d):
    lines = _lines(spark, d)
    hits = search.bm25(lines, QUERY).withColumn("score", F.round("score", 6))
    return search.group_by_file(hits, lines).select("path", "hit_count", F.array_join("hit_lines", ",").alias("hit_lines"), "best_score", "best_line")


def a2_token_saving(spark, d):
    hits = search.bm25(_lines(spark, d), QUERY)
    return search.token_saving(hits.groupBy("path").agg(F.count("*").alias("hit_count")))


def x4_code_only(spark, d):
    """Scope and extension are applied before ranking, never after a limit."""
    lines = _lines(spark, d).where((F.col("kind") == "code") & ingest.extension(F.col("path")).isin(".py", ".ts"))
    return search.bm25(lines, QUERY).withColumn("score", F.round("score", 6))


def w9_surrounding(spark, d):
    lines = _lines(spark, d)
    return search.surrounding(lines, search.bm25(lines, QUERY))


def w11_enclosing(spark, d):
    lines = _lines(spark, d).where("kind = 'code'")
    hits = search.bm25(lines, QUERY).select("path", "line_no")
    return search.enclosing(lines).join(hits, ["path", "line_no"], "left_semi")


def w12_block_ends(spark, d):
    return search.block_ends(ingest.present(table(spark, d, "files")).where("lower(trim(kind)) = 'code'"))


def w10_excerpt(spark, d):
    """Five lines around the best hit of each file, cut at 2,000 bytes by a running sum."""
    from pyspark.sql import Window

    lines = _lines(spark, d)
    best = search.bm25(lines, QUERY).groupBy("path").agg(F.min(F.struct(F.round("score", 6).alias("score"), "line_no")).alias("b")).select("path", F.col("b.line_no").alias("hit"))
    wanted = best.select("path", "hit", F.explode(F.sequence(F.greatest(F.lit(1), F.col("hit") - 2), F.col("hit") + 2)).alias("line_no"))
    rows = wanted.join(lines.select("path", "line_no", "content"), ["path", "line_no"])
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.octet_length("content") + 1).over(w)).where("used <= 2000").select("path", "hit", "line_no", "content")


def x6_search_and_read(spark, d):
    """The best files with their excerpts' checksums: search, group, order, page, read."""
    lines = _lines(spark, d)
    hits = search.bm25(lines, QUERY).withColumn("score", F.round("score", 6))
    page = search.group_by_file(hits, lines).orderBy("best_score", "path").offset(5).limit(10)
    return page.select("path", "best_score", F.sha2("best_content", 256).alias("evidence"))


def x9_claim(spark, d):
    tokens = CLAIM.split()
    lines = _lines(spark, d)
    hits = search.bm25(lines, CLAIM).join(lines.select("path", "line_no", "content"), ["path", "line_no"])
    kind, score = search.evidence(F.col("content"), tokens)
    return search.verdict(hits.select(kind.alias("type"), score.alias("score")))


def v13_evidence(spark, d):
    lines = _lines(spark, d)
    kind, score = search.evidence(F.col("content"), CLAIM.split())
    return lines.where(F.col("content").rlike(r"(?i)\bsnapshot\b")).select("path", "line_no", kind.alias("type"), F.round(score, 6).alias("score"))


def t4_snippets(spark, d):
    lines = _lines(spark, d)
    hit = lines.where(F.col("content").rlike(r"(?i)\b(gateway|lockfile|snapshot)\b"))
    return hit.select("path", "line_no", T.snippet(F.col("content"), QUERY.split()).alias("snippet"))


def j1_keywords(spark, d):
    """Chunks by keyword: distinct content hashes whose headings hold a keyword."""
    c = table(spark, d, "chunks").select("id", F.col("metadata.content_hash").alias("content_hash"), F.col("metadata.heading_path").alias("hp")).dropDuplicates(["id"])
    keywords = c.where("content_hash is not null").select("content_hash", F.explode(F.transform("hp", lambda x: F.lower(x))).alias("keyword")).distinct()
    wanted = keywords.where(F.col("keyword").isin("glossary", "limits"))
    return c.join(wanted, "content_hash").select("id", "keyword").distinct()


def x8_modal_index(spark, d):
    """New content hashes of figures, tables and formulas with their lower-case keywords, one row each."""
    m = F.col("metadata")
    c = table(spark, d, "chunks").where(m["chunk_type"].isin("figure", "table", "formula")).select(
        m["content_hash"].alias("content_hash"), m["chunk_type"].alias("kind"), m["bundle_id"].alias("bundle_id")).where("content_hash is not null")
    return c.groupBy("content_hash").agg(F.min("kind").alias("kind"), F.count_distinct("bundle_id").alias("bundles"))


def a3_modal_stats(spark, d):
    m = F.col("metadata")
    c = table(spark, d, "chunks").dropDuplicates(["id"]).where(m["chunk_type"].isin("figure", "table", "formula"))
    return c.groupBy(m["chunk_type"].alias("kind")).agg(F.count("*").alias("items"), F.count_distinct(m["paper_id"]).alias("papers"))


_FOLD = "translate(lower(content), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def _bm(phrases: list[list[str]], where: str = "TRUE") -> str:
    def tf(p):
        if len(p) == 1:
            return f"len(list_filter(ts, lambda t: t = '{p[0]}'))"
        n = len(p)
        return f"len(list_filter(range(1, len(ts) - {n} + 2), lambda i: ts[i:i+{n - 1}] = [{', '.join(chr(39) + x + chr(39) for x in p)}]))"

    tfs = ", ".join(f"{tf(p)} AS tf{i}" for i, p in enumerate(phrases))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(phrases)))
    sc = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i in range(len(phrases)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(phrases)))
    return f"""WITH {_LINES},
tk AS (SELECT path, line_no, content, regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}]+') AS ts FROM ln WHERE {where}),
fr AS (SELECT path, line_no, content, len(ts) AS dl, {tfs} FROM tk),
st AS (SELECT count(*) AS n, avg(dl) AS a, {dfs} FROM fr),
hits AS (SELECT path, line_no, content, round(-({sc}), 6) AS score FROM fr, st WHERE {hit})
"""


_Q = search.query_terms(QUERY)
_BM = _bm(_Q)
_EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '.(\\.[^.]*)$', 1))"
_GROUP = """, g AS (SELECT path, count(*) AS hit_count, array_to_string(list_sort(list(DISTINCT line_no)), ',') AS hit_lines,
  min(struct_pack(s := score, l := line_no, c := content)) AS b FROM hits GROUP BY path)"""
_EVID = """CASE WHEN r >= 0.5 THEN CASE WHEN neg AND NOT aff THEN 'contradicting' ELSE 'supporting' END ELSE 'related' END AS type,
  least(1.0, (r * 0.7 + 0.3) * CASE WHEN r >= 0.5 THEN CASE WHEN neg AND NOT aff THEN 0.9 ELSE 1.0 END WHEN r >= 0.25 THEN 0.7 ELSE 0.5 END) AS score"""
_esc = lambda p: p.replace("'", "''")
_NEG = " OR ".join(f"regexp_matches(content, '{_esc(p)}')" for p in search.NEGATION)
_AFF = " OR ".join(f"regexp_matches(content, '{_esc(p)}')" for p in search.AFFIRMATION)
_RATIO = "(" + " + ".join(f"contains(lower(content), '{t}')::INT" for t in CLAIM.split()) + f") / {len(CLAIM.split())}.0"
_FN = search._FUNCTION.replace("'", "''")
_CL = search._CLASS.replace("'", "''")

QUERIES = {f.__name__: f for f in (
    x3_bm25, x3_phrases, x3_indexed, w1_top_lines, x4_grouped, a2_token_saving, x4_code_only, w9_surrounding, w11_enclosing, w12_block_ends, w10_excerpt,
    x6_search_and_read, x9_claim, v13_evidence, t4_snippets, j1_keywords, x8_modal_index, a3_modal_stats)}
ORACLES = {
    "x3_bm25": _BM + "SELECT path, line_no, score FROM hits",
    "x3_indexed": _BM + "SELECT path, line_no, score FROM hits",
    "x3_phrases": _bm(search.query_terms(PHRASE_QUERY)) + "SELECT path, line_no, score FROM hits",
    "w1_top_lines": _BM + "SELECT path, line_no, score FROM hits ORDER BY score, path, line_no LIMIT 20",
    "x4_grouped": _BM + _GROUP + " SELECT path, hit_count, hit_lines, b.s AS best_score, b.l AS best_line FROM g",
    "a2_token_saving": _BM + """, g AS (SELECT count(DISTINCT path) AS groups, count(*) AS hits FROM hits)
SELECT groups, hits, round((1 - 80 * groups / (100 * hits)) * 100)::BIGINT AS saving FROM g""",
    "x4_code_only": _bm(_Q, f"kind = 'code' AND {_EXT} IN ('.py', '.ts')") + "SELECT path, line_no, score FROM hits",
    "w9_surrounding": _BM + """SELECT h.path, h.line_no, string_agg(l.content, chr(10) ORDER BY l.line_no) AS context FROM hits h
JOIN ln l ON l.path = h.path AND l.line_no BETWEEN h.line_no - 3 AND h.line_no + 3 GROUP BY 1, 2""",
    "w11_enclosing": _bm(_Q, "kind = 'code'") + f""", e AS (SELECT path, line_no,
  last_value(nullif(regexp_extract(content, '{_FN}', 1), '') IGNORE NULLS) OVER w AS function, last_value(nullif(regexp_extract(content, '{_CL}', 1), '') IGNORE NULLS) OVER w AS class
  FROM ln WHERE kind = 'code' WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN 50 PRECEDING AND CURRENT ROW))
SELECT e.path, e.line_no, e.function, e.class FROM e JOIN hits h ON h.path = e.path AND h.line_no = e.line_no""",
    "w12_block_ends": f"""WITH {_LINES}, b AS (SELECT path, line_no, length(content) - length(replace(content, '{{', '')) AS o,
  (length(content) - length(replace(content, '{{', ''))) - (length(content) - length(replace(content, '}}', ''))) AS delta FROM ln WHERE kind = 'code'),
p AS (SELECT *, sum(delta) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS depth FROM b)
SELECT a.path, a.line_no, min(z.line_no) AS end_line FROM p a LEFT JOIN p z ON z.path = a.path AND z.line_no BETWEEN a.line_no + 1 AND a.line_no + 100 AND z.depth <= a.depth - a.delta
WHERE a.o > 0 AND a.delta > 0 GROUP BY 1, 2""",
    "w10_excerpt": _BM + """, b AS (SELECT path, min(struct_pack(s := score, l := line_no)).l AS hit FROM hits GROUP BY path),
r AS (SELECT b.path, b.hit, l.line_no, l.content, sum(octet_length(encode(l.content)) + 1) OVER (PARTITION BY b.path ORDER BY l.line_no ROWS UNBOUNDED PRECEDING) AS used
  FROM b JOIN ln l ON l.path = b.path AND l.line_no BETWEEN greatest(1, b.hit - 2) AND b.hit + 2)
SELECT path, hit, line_no, content FROM r WHERE used <= 2000""",
    "x6_search_and_read": _BM + _GROUP + " SELECT path, b.s AS best_score, sha256(b.c) AS evidence FROM g ORDER BY b.s, path LIMIT 10 OFFSET 5",
    "x9_claim": _bm(search.query_terms(CLAIM)) + f""", e AS (SELECT {_EVID} FROM (SELECT {_RATIO} AS r, ({_NEG}) AS neg, ({_AFF}) AS aff FROM hits)),
v AS (SELECT count(*) FILTER (type = 'supporting') AS supporting, count(*) FILTER (type = 'contradicting') AS contradicting, count(*) FILTER (type = 'related') AS related,
  coalesce(sum(score) FILTER (type = 'supporting'), 0) AS s, 0.8 * coalesce(sum(score) FILTER (type = 'contradicting'), 0) AS c,
  0.3 * coalesce(sum(score) FILTER (type = 'related'), 0) AS r, count(*) AS n FROM e),
w AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(1, CASE WHEN s + c + r = 0 THEN 0 WHEN c > s THEN 0.2 * s / (s + c + r) ELSE (s - 0.5 * c) / (s + c + r) END + least(0.2, n * 0.02)) END AS f FROM v)
SELECT supporting, contradicting, related, round(f, 6) AS confidence, CASE WHEN f >= 0.7 THEN 'high' WHEN f >= 0.4 THEN 'medium' WHEN f > 0 THEN 'low' ELSE 'none' END AS label FROM w""",
    "v13_evidence": f"""WITH {_LINES}, x AS (SELECT path, line_no, {_RATIO} AS r, ({_NEG}) AS neg, ({_AFF}) AS aff FROM ln WHERE regexp_matches(content, '(?i)\\bsnapshot\\b')),
e AS (SELECT path, line_no, {_EVID} FROM x) SELECT path, line_no, type, round(score, 6) AS score FROM e""",
    "j1_keywords": """WITH c AS (SELECT DISTINCT id, metadata.content_hash AS h, metadata.heading_path AS hp FROM chunks),
k AS (SELECT DISTINCT h, lower(unnest(hp)) AS keyword FROM c WHERE h IS NOT NULL)
SELECT DISTINCT id, keyword FROM c JOIN k USING (h) WHERE keyword IN ('glossary', 'limits')""",
    "x8_modal_index": """SELECT metadata.content_hash AS content_hash, min(metadata.chunk_type) AS kind, count(DISTINCT metadata.bundle_id) AS bundles FROM chunks
WHERE metadata.chunk_type IN ('figure', 'table', 'formula') AND metadata.content_hash IS NOT NULL GROUP BY 1""",
    "a3_modal_stats": """WITH c AS (SELECT id, any_value(metadata) AS m FROM chunks GROUP BY id)
SELECT m.chunk_type AS kind, count(*) AS items, count(DISTINCT m.paper_id) AS papers FROM c WHERE m.chunk_type IN ('figure', 'table', 'formula') GROUP BY 1""",
}
