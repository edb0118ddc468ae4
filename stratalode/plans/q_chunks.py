"""Queries of chunking, headings, pages and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import chunking
from ..session import table
from .q_text import _URL_SQL, _url_col


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


def c4_semantic_chunks(spark, d):
    return chunking.semantic_chunks(_docs(spark, d), "doc_id", "text").select("doc", "chunk_id", "ordinal", "kind", "heading", "first_line", "last_line", "tokens")


def c5_field_chunks(spark, d):
    """Simple chunks of one field of the bundles."""
    return table(spark, d, "bundles").where("display_name is not null").select(F.sha2(F.concat_ws(":", "bundle_id", "display_name"), 256).alias("chunk_id"), F.col("display_name").alias("content"))


def c6_context(spark, d):
    """Title and first 500 characters below an abstract heading of each document."""
    t = F.regexp_extract("text", r"(?is)(?:^|\n)#*\s*abstract\s*\n+(.{1,500})", 1)
    return _docs(spark, d).select("doc_id", F.length(t).alias("abstract_chars"))


def c7_headings(spark, d):
    return chunking.headings(_docs(spark, d), "doc_id", F.col("text"))


def c7_heading_tree(spark, d):
    return chunking.heading_tree(chunking.headings(_docs(spark, d), "doc_id", F.col("text"))).select("doc", "line_no", "level", "parent_line")


def s18_blocks(spark, d):
    return chunking.plain_blocks(_docs(spark, d), "doc_id", F.col("text")).groupBy("doc").agg(F.count("*").alias("blocks"), F.sum(F.length("block")).alias("chars"))


def s10_links(spark, d):
    return chunking.llms_links(_docs(spark, d), "doc_id", F.col("text"))


def _state(spark, d, before: bool):
    """Pages with their hashes; the earlier state lacks every seventh page, has other hashes for every fifth and some that are gone."""
    docs = table(spark, d, "documents").select("doc_id", U.normalise(_url_col()).alias("url"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "ingested_at", "updated_at")
    if not before:
        return docs
    kept = docs.where("doc_id % 7 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")))
    gone = docs.where("doc_id % 50 = 0").withColumn("url", F.concat("url", F.lit("-gone")))
    return kept.unionByName(gone)


def h8_page_changes(spark, d):
    return chunking.page_changes(_state(spark, d, False), _state(spark, d, True))


def j4_classify_urls(spark, d):
    now = _state(spark, d, False).select("url", F.col("updated_at").alias("lastmod"))
    return chunking.classify_urls(now, _state(spark, d, True).select("url", F.col("ingested_at").alias("fetched_at")))


def u2_url_union(spark, d):
    return _state(spark, d, False).select("url").union(_state(spark, d, True).select("url")).distinct()


def i2_degrade(spark, d):
    c = chunking.page_changes(_state(spark, d, False), _state(spark, d, True))
    return spark.createDataFrame([(chunking.should_degrade(c),)], "full_run boolean")


def s23_markdown_export(spark, d):
    return chunking.markdown_table(table(spark, d, "bundles"), ["bundle_id", "display_name", "kind"])


def s22_json_export(spark, d):
    b = table(spark, d, "bundles")
    return b.select("bundle_id", F.length(F.to_json(F.struct("bundle_id", "repo", "kind"))).alias("chars"))


def s6_frontier(spark, d):
    """One crawl level: the pages that the pages of a host link to, without those seen."""
    links = chunking.llms_links(_docs(spark, d), "doc_id", F.col("text")).select(U.normalise(F.col("url")).alias("url")).where("url is not null").distinct()
    return links.join(_state(spark, d, False).select("url"), "url", "left_anti").where(U.is_safe(F.col("url")))


_H = """ln AS (SELECT doc_id::VARCHAR AS doc, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line,
  generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1)::INT AS line_no FROM documents WHERE text IS NOT NULL),
hd AS (SELECT doc, line_no, length(regexp_extract(line, '^(#{1,6})\\s+\\S', 1)) AS level, trim(regexp_replace(regexp_replace(line, '^#+\\s+', ''), '\\s*#*\\s*$', ''), ' ') AS title
  FROM ln WHERE regexp_matches(line, '^#{1,6}\\s+\\S'))"""
_ST = _URL_SQL + """, nu AS (SELECT doc_id, origin || CASE WHEN p.path IN ('', '/') THEN '/' ELSE regexp_replace(p.path, '/$', '') END || p.query AS url FROM o),
nw AS (SELECT doc_id, url, sha256(coalesce(text, '')) AS hash, ingested_at, updated_at FROM nu JOIN documents USING (doc_id)),
bf AS (SELECT doc_id, url, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE hash END AS hash, ingested_at FROM nw WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, url || '-gone', hash, ingested_at FROM nw WHERE doc_id % 50 = 0),
ch AS (SELECT coalesce(n.url, b.url) AS url, CASE WHEN b.url IS NULL THEN 'added' WHEN n.url IS NULL THEN 'removed' WHEN n.hash = b.hash THEN 'unchanged' ELSE 'updated' END AS change
  FROM nw n FULL JOIN bf b ON n.url = b.url)"""

QUERIES = {f.__name__: f for f in (
    c4_semantic_chunks, c5_field_chunks, c6_context, c7_headings, c7_heading_tree, s18_blocks, s10_links, h8_page_changes, j4_classify_urls, u2_url_union, i2_degrade,
    s23_markdown_export, s22_json_export, s6_frontier)}
ORACLES = {
    "c5_field_chunks": "SELECT sha256(bundle_id || ':' || display_name) AS chunk_id, display_name AS content FROM bundles WHERE display_name IS NOT NULL",
    "c6_context": "SELECT doc_id, length(regexp_extract(text, '(?is)(?:^|\\n)#*\\s*abstract\\s*\\n+(.{1,500})', 1)) AS abstract_chars FROM documents WHERE text IS NOT NULL",
    "c7_headings": f"WITH {_H} SELECT doc, line_no, level, title FROM hd",
    "c7_heading_tree": f"""WITH {_H} SELECT a.doc, a.line_no, a.level, max(b.line_no) AS parent_line FROM hd a LEFT JOIN hd b ON a.doc = b.doc AND b.line_no < a.line_no AND b.level < a.level GROUP BY ALL""",
    "s18_blocks": """WITH b AS (SELECT doc_id::VARCHAR AS doc, unnest(regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '\\n[ \\t]*\\n')) AS block FROM documents WHERE text IS NOT NULL)
SELECT doc, count(*) AS blocks, sum(length(block))::BIGINT AS chars FROM b WHERE regexp_matches(block, '[^\\s\\x0B]') GROUP BY doc""",
    "s10_links": """SELECT DISTINCT doc_id AS doc, regexp_replace(regexp_replace(u, '#.*$', ''), '[.,;:]+$', '') AS url FROM
  (SELECT doc_id, unnest(regexp_extract_all(text, '(https?://[^\\s\\])>"'']+)', 1)) AS u FROM documents WHERE text IS NOT NULL)""",
    "h8_page_changes": f"WITH {_ST} SELECT url, change FROM ch",
    "j4_classify_urls": f"""WITH {_ST} SELECT coalesce(n.url, b.url) AS url, CASE WHEN b.url IS NULL THEN 'added' WHEN n.url IS NULL THEN 'removed'
  WHEN n.updated_at IS NOT NULL AND b.ingested_at IS NOT NULL AND n.updated_at <= b.ingested_at THEN 'unchanged' ELSE 'check' END AS status FROM nw n FULL JOIN bf b ON n.url = b.url""",
    "u2_url_union": f"WITH {_ST} SELECT url FROM nw UNION SELECT url FROM bf",
    "i2_degrade": f"WITH {_ST} SELECT count(*) FILTER (change <> 'unchanged') / count(*) > 0.5 AS full_run FROM ch",
    "s23_markdown_export": """SELECT '| ' || concat_ws(' | ', replace(bundle_id, '|', '\\|'), replace(coalesce(display_name, ''), '|', '\\|'), replace(kind, '|', '\\|')) || ' |' AS line FROM bundles""",
    "s22_json_export": """SELECT bundle_id, length('{"bundle_id":"' || bundle_id || '","repo":"' || repo || '","kind":"' || kind || '"}') AS chars FROM bundles""",
}
