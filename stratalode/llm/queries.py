"""Queries of the training-data problems, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import leakage, markup, neardup, pii, scans, sources, split, tokenize, vectors


def _scans(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    return scans.scan_noise(
        table(spark, d, "chunks"), paper=m["paper_id"], index=m["page_index"], is_page=m["source_type"] == "pdf_text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).select("id", F.explode("defects").alias("defect")).distinct()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each page's text as continuous paragraphs."""
    return _scans(spark, d).select("id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sources.unwritten(table(spark, d, "files")).where(F.size("kinds") > 0).select("path")


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every code file with what it is; no kinds: hand-written source."""
    return sources.unwritten(table(spark, d, "files"))


def _markup(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    return markup.clean_markup(
        table(spark, d, "chunks"), heading=m["section_heading"], host=F.coalesce(m["repo_id"], m["bundle_id"]),
        is_code=m["source_type"] == "code")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _markup(spark, d).select("id", F.explode("languages").alias("markup")).distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text and heading of every chunk, one row per id."""
    return _markup(spark, d).select("id", "heading", "text").dropDuplicates(["id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, col in (("chunks", "embedding"), ("semantic_index", "vector")):
        near = vectors.nearest(table(spark, d, name), vector_col=col, k=5, floor=0.85)
        parts.append(vectors.mutual_pairs(near).select(F.lit(name).alias("collection"), "id_a", "id_b"))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "chunks"), threshold=0.5).select("id_a", "id_b")


def p5_aligned(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with their set similarity and their edit similarity by banded alignment."""
    return neardup.near_duplicates(table(spark, d, "chunks"), threshold=0.5, alignment=True)


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk: its class over links of similarity 0.5 and the number of its links."""
    chunks = table(spark, d, "chunks")
    return neardup.classes(chunks, neardup.near_duplicates(chunks, threshold=0.5))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized item, with their lines or heading."""
    chunks = table(spark, d, "chunks").select("id", "content", F.col("metadata.section_heading").alias("heading"))
    index = table(spark, d, "semantic_index").select("id", "content", "start_line")
    of_chunks = split.split_oversized(chunks.where(F.length("content") > split.LIMIT).dropDuplicates(["id"]), heading_col="heading")
    of_index = split.split_oversized(index.where(F.length("content") > split.LIMIT).dropDuplicates(["id"]), line_col="start_line")
    return of_chunks.select(F.lit("chunks").alias("collection"), "*").unionByName(
        of_index.select(F.lit("semantic_index").alias("collection"), "*"))


def p6_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Every oversized item put together again from its pieces: each piece within the limit, each next one without what it shares."""
    shared = F.when(F.col("piece") > 0, split.OVERLAP).otherwise(0)
    rows = p6_pieces(spark, d).select("collection", "id", "piece", F.length("content").alias("size"), F.col("content").alias("c"), shared.alias("shared"))
    rows = rows.select("collection", "id", "size", F.struct("piece", F.substring(F.col("c"), F.col("shared") + 1, F.col("size")).alias("rest")).alias("x"))
    whole = rows.groupBy("collection", "id").agg(F.max("size").alias("longest"), F.array_sort(F.collect_list("x")).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["rest"]), "")
    return whole.select("collection", "id", (F.col("longest") <= split.LIMIT).alias("fits"), F.md5(text).alias("content_md5"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    chunks, index = table(spark, d, "chunks"), table(spark, d, "semantic_index")
    chunks = chunks.select("id", "content", F.col("metadata.section_heading").alias("heading"))
    parts = [
        split.split_oversized(chunks, heading_col="heading").select(F.lit("chunks").alias("collection"), "id", "piece"),
        split.split_oversized(index, line_col="start_line").select(F.lit("semantic_index").alias("collection"), "id", "piece"),
    ]
    # each oversized text has a second piece
    return parts[0].unionByName(parts[1]).where("piece = 1").select("collection", "id").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.occurrences(pii.scrub(table(spark, d, "documents"), with_text=False))
    return found.select("doc_id", "pii_type", "start_pos").distinct()


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every document with placeholders for personal data."""
    return pii.scrub(table(spark, d, "documents")).select("doc_id", F.col("clean").alias("text"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Each affected document with the merged spans of each leaked item."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id", F.explode("spans").alias("span")).select(
        "doc_id", "item_id", F.col("span.start").alias("start_pos"), F.col("span.end").alias("end_pos"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


_P4_SQL = """
WITH v AS (
  SELECT DISTINCT 'chunks' AS collection, id, embedding::DOUBLE[] AS x FROM chunks
  WHERE embedding IS NOT NULL AND len(embedding) = 64
  UNION
  SELECT DISTINCT 'semantic_index', id, vector::DOUBLE[] FROM semantic_index
  WHERE vector IS NOT NULL AND len(vector) = 64),
u AS (
  SELECT * FROM v WHERE len(list_filter(x, lambda e: isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
c AS (
  SELECT a.collection, a.id AS q, b.id AS n, list_cosine_similarity(a.x, b.x) AS s
  FROM u a JOIN u b ON a.collection = b.collection AND a.id <> b.id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY collection, q ORDER BY s DESC, n) AS rn FROM c WHERE s >= 0.85)
SELECT DISTINCT collection, least(q, n) AS id_a, greatest(q, n) AS id_b FROM r WHERE rn <= 5
"""

_P5_SQL = """
WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE content IS NOT NULL),
w AS (SELECT id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+') AS w FROM c),
s AS (
  SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS s
  FROM w WHERE len(w) >= 3),
z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
i AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM i JOIN z a ON a.id = id_a JOIN z b ON b.id = id_b WHERE i >= 0.5 * (a.n + b.n - i)
"""

QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p2_kinds": p2_kinds, "p3_found": p3_found, "p3_clean": p3_clean, "p4_found": p4_found, "p5_found": p5_found, "p5_aligned": p5_aligned, "p5_classes": p5_classes,
    "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_rejoined": p6_rejoined, "p8_ids": p8_ids,
    "p9_found": p9_found, "p10_found": p10_found, "p10_clean": p10_clean, "p9_spans": p9_spans}
_P5_CLASSES_SQL = "WITH RECURSIVE " + _P5_SQL.strip()[5:].replace("SELECT id_a, id_b FROM i JOIN", ", p AS (SELECT id_a, id_b FROM i JOIN") + """),
e AS (SELECT id_a AS a, id_b AS b FROM p UNION SELECT id_b, id_a FROM p),
l AS (SELECT a AS id, a AS label FROM e UNION SELECT e.b, l.label FROM l JOIN e ON e.a = l.id),
k AS (SELECT id, min(label) AS class_id FROM l GROUP BY id), n AS (SELECT a AS id, count(*) AS links FROM e GROUP BY a)
SELECT c.id, coalesce(k.class_id, c.id) AS class_id, coalesce(n.links, 0) AS links FROM (SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL) c LEFT JOIN k USING (id) LEFT JOIN n USING (id)
"""

ORACLES = {"p4_found": _P4_SQL, "p5_found": _P5_SQL, "p5_classes": _P5_CLASSES_SQL,
    "p9_found": """
WITH i AS (
  SELECT item_id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w
  FROM (SELECT item_id, question AS t FROM eval_items UNION ALL SELECT item_id, passage FROM eval_items) WHERE t IS NOT NULL),
g AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS g
  FROM i WHERE len(w) >= 12),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
h AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS g
  FROM d WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)""",
    "p6_rejoined": """
SELECT DISTINCT 'chunks' AS collection, id, TRUE AS fits, md5(content) AS content_md5 FROM chunks WHERE length(content) > 2048 AND id IS NOT NULL
UNION SELECT DISTINCT 'semantic_index', id, TRUE, md5(content) FROM semantic_index WHERE length(content) > 2048 AND id IS NOT NULL""",
    "p6_found": """
SELECT 'chunks' AS collection, id FROM chunks WHERE length(content) > 2048
UNION SELECT 'semantic_index', id FROM semantic_index WHERE length(content) > 2048""",
}
