"""Queries of vector retrieval over chunks and the window index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import facts, retrieval
from ..session import table

QUESTION = "Which gateway validates the snapshot of the dense lockfile and its manifest?"


def _query(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


def _chunks(spark, d):
    return _written(spark, d).dropDuplicates(["id"])


def _written(spark, d):
    """Chunks as they were written: some ids stand in two identical rows."""
    m = F.col("metadata")
    return table(spark, d, "chunks").select(
        "id", "content", F.col("embedding").alias("v"), F.substring(facts.collection_level(m), 1, 2).alias("level"), m["parent_chunk_id"].alias("parent"),
        m["bundle_id"].alias("bundle_id"), m["content_hash"].alias("content_hash"), m["chunk_index"].alias("chunk_index"), m["source_type"].alias("source_type"),
        F.coalesce(m["paper_id"], m["bundle_id"]).alias("content_key"))


def _scored(spark, d):
    # scored before the copies meet, so that neither vectors nor columns that nobody asks for are shuffled
    return retrieval.scored(_written(spark, d), F.col("v"), _query(spark, d)).drop("v").dropDuplicates(["id"])


def v1_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.scored(e, F.col("embedding"), _query(spark, d)).select("vec_id", "score")


def r1_semantic(spark, d):
    t = retrieval.scored(table(spark, d, "semantic_index"), F.col("vector"), _query(spark, d)).select("id", "score")
    return retrieval.top_k(t.dropDuplicates(["id"]), 20, "id")


def f6_kind_filter(spark, d):
    t = table(spark, d, "semantic_index").where((F.col("kind") == "code") & F.col("path").endswith(".py"))
    return retrieval.top_k(retrieval.scored(t, F.col("vector"), _query(spark, d)).select("id", "score").dropDuplicates(["id"]), 10, "id")


def r4_raw_hierarchical(spark, d):
    return retrieval.quota_top(_scored(spark, d), "level", retrieval.raw_quotas(20)).select("id", "level", "score")


def r7_expansion(spark, d):
    seeds = retrieval.top_k(_scored(spark, d), 15, "id")
    return retrieval.expand(seeds, _chunks(spark, d).select("id", "parent"))


def r8_hierarchical(spark, d):
    return retrieval.hierarchical(_scored(spark, d), 10, 15).select("id", "level", "content_key", "score")


def r9_bundles(spark, d):
    m = F.col("metadata")
    c = table(spark, d, "chunks").where(retrieval.scope(m, bundle_ids=["bdl_434fda519065", "bdl_2c44fd71304c"], source_types=["readme", "overview"]))
    return retrieval.top_k(retrieval.scored(c, F.col("embedding"), _query(spark, d)).select("id", "score").dropDuplicates(["id"]), 10, "id")


def r5_hybrid(spark, d):
    return retrieval.hybrid(_chunks(spark, d).where("content is not null"), QUESTION, _query(spark, d), 20)


def r11_gain(spark, d):
    c = _scored(spark, d).where("content is not null")
    return retrieval.information_gain(c, QUESTION)


def r12_prune_threshold(spark, d):
    return retrieval.prune(r11_gain(spark, d), "threshold", 0.25)


def r12_prune_topk(spark, d):
    return retrieval.prune(r11_gain(spark, d), "topk", 10)


def r12_prune_ratio(spark, d):
    return retrieval.prune(r11_gain(spark, d), "ratio", 0.05)


def a17_normalised(spark, d):
    return retrieval.normalise_scores(r11_gain(spark, d), "gain")


def r10_completion(spark, d):
    """One hop: the best chunks whose text points elsewhere draw in the neighbours of the same content."""
    from ..functions import text as T

    all_chunks = _chunks(spark, d)
    seeds = retrieval.top_k(_scored(spark, d).where("content is not null"), 30, "id")
    found = seeds.select("id", "score", F.lit("seed").alias("via"), "content_key", "chunk_index", "content")
    hop = found.where(~T.is_complete(F.col("content")) | F.col("content").rlike(r"(?i)\bthe rest\b")).select("content_key", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"))
    near = all_chunks.join(hop.distinct(), ["content_key", "chunk_index"], "left_semi").select("id", F.lit(retrieval.HOP).alias("score"), F.lit("hop").alias("via"))
    return retrieval.merge_by_id([found.select("id", "score", "via"), near])


def r16_by_hash(spark, d):
    return _chunks(spark, d).where("content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("chunks")).where("chunks > 1")


def r17_list_content(spark, d):
    return retrieval.list_content(_chunks(spark, d))


def r19_stats(spark, d):
    c = _chunks(spark, d)
    return c.groupBy("bundle_id", "source_type").agg(F.count("*").alias("chunks"), F.count_if(retrieval.usable(F.col("v"))).alias("with_vector"))


def d1_exact_dedup(spark, d):
    return _chunks(spark, d).where("content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("id")).select("id")


def j6_parents(spark, d):
    c = _chunks(spark, d)
    return c.where("parent is not null").select("id", "parent").join(c.select(F.col("id").alias("parent"), "level"), "parent").select("id", "parent", F.col("level").alias("parent_level"))


def j7_siblings(spark, d):
    """Siblings per parent: counted, not paired."""
    return _chunks(spark, d).where("parent is not null").groupBy("parent").agg(F.count("*").alias("children"), F.min("chunk_index").alias("first_index"))


def j17_invalid_parents(spark, d):
    c = _chunks(spark, d)
    return c.where("parent is not null").select("id", "parent").join(c.select(F.col("id").alias("parent")), "parent", "left_anti")


def a6_levels(spark, d):
    return _chunks(spark, d).groupBy("content_key", "level").agg(F.count("*").alias("chunks"))


def v3_ngrams(spark, d):
    """Unit n-gram vectors of the evaluation questions, sparse."""
    rows = V.ngram_rows(table(spark, d, "eval_items"), "item_id", "question")
    return rows.select("id", "idx", F.round("weight", 6).alias("weight"))


def v4_ngram_scores(spark, d):
    t = table(spark, d, "eval_items")
    return V.ngram_similarity(V.ngram_rows(t, "item_id", "question"), QUESTION).select("id", F.round("sparse", 6).alias("sparse"))


def v6_entropy(spark, d):
    logs = F.transform(F.slice("embedding", 1, 5), lambda x: -F.abs(x.cast("double")))
    h = V.softmax_entropy(logs)
    return table(spark, d, "embeddings").select("vec_id", F.round(h, 6).alias("entropy"), F.round(h / F.log(F.lit(5.0)), 6).alias("normalised"))


def v8_uncertainty(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(V.heuristic_uncertainty(F.col("text")).alias("nu")).agg(F.count("*").alias("documents"))


def w13_neighbours(spark, d):
    """Each chunk with the sizes of its neighbours of the same content, one before and one after."""
    from pyspark.sql import Window

    w = Window.partitionBy("content_key").orderBy("chunk_index", "id")
    n = F.length("content")
    return _chunks(spark, d).select("id", F.lag(n).over(w).alias("before"), F.lead(n).over(w).alias("after"))


_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_OK = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
_LEVEL = """CASE WHEN st IN ('overview', 'repocard') THEN 'l1' WHEN st = 'pdf_text' AND g = 'section' AND l = 1 AND s IN ('abstract', 'introduction', 'summary', 'overview') THEN 'l1'
  WHEN g = 'section' OR (st = 'pdf_text' AND l > 0 AND l <= 2) THEN 'l2' WHEN st = 'code' THEN 'l2' ELSE 'l3' END"""
_C = f"""{_Q}, raw AS (SELECT id, any_value(content) AS content, any_value(embedding) AS v, any_value(metadata) AS m FROM chunks GROUP BY id),
x AS (SELECT *, m.source_type AS st, m.granularity AS g, m.heading_level AS l, lower(trim(regexp_replace(m.section_heading, '^\\d+\\.?\\s*', ''), ' ')) AS s FROM raw),
c AS (SELECT id, content, v, {_LEVEL} AS level, m.parent_chunk_id AS parent, m.bundle_id AS bundle_id, m.content_hash AS content_hash, m.chunk_index AS chunk_index,
  m.source_type AS source_type, coalesce(m.paper_id, m.bundle_id) AS content_key FROM x),
sc AS (SELECT c.*, round(list_cosine_similarity(v::DOUBLE[], q), 6) AS score FROM c, q WHERE v IS NOT NULL AND {_OK.format('v')})
"""
_TERMS = sorted({t for t in __import__("re").findall(r"[^\W_]+", QUESTION.lower()) if len(t) > 1})
_GAIN = _C[:-1] + f""",
ga AS (SELECT id, round(0.7 * len(list_intersect([{', '.join(chr(39) + t + chr(39) for t in _TERMS)}], list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1))) / {len(_TERMS)}.0
  + 0.3 * greatest(0, least(1, score)), 6) AS gain FROM sc WHERE content IS NOT NULL)
"""

QUERIES = {f.__name__: f for f in (
    v1_cosine, r1_semantic, f6_kind_filter, r4_raw_hierarchical, r7_expansion, r8_hierarchical, r9_bundles, r5_hybrid, r11_gain, r12_prune_threshold, r12_prune_topk,
    r12_prune_ratio, a17_normalised, r10_completion, r16_by_hash, r17_list_content, r19_stats, d1_exact_dedup, j6_parents, j7_siblings, j17_invalid_parents, a6_levels,
    v3_ngrams, v4_ngram_scores, v6_entropy, v8_uncertainty, w13_neighbours)}
_SEM = f"WITH {_Q}, t AS (SELECT id, any_value(vector) AS v, any_value(kind) AS kind, any_value(path) AS path FROM semantic_index GROUP BY id), s AS (SELECT id, kind, path, round(list_cosine_similarity(v::DOUBLE[], q), 6) AS score FROM t, q WHERE v IS NOT NULL AND {_OK.format('v')})"
ORACLES = {
    "v1_cosine": f"WITH {_Q} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE {_OK.format('embedding')}",
    "r1_semantic": _SEM + " SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20",
    "f6_kind_filter": _SEM + " SELECT id, score FROM s WHERE kind = 'code' AND ends_with(path, '.py') ORDER BY score DESC, id LIMIT 10",
    "r4_raw_hierarchical": "WITH " + _C + """, r AS (SELECT id, level, score, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS rn FROM sc)
SELECT id, level, score FROM r WHERE rn <= CASE level WHEN 'l1' THEN 4 WHEN 'l3' THEN 10 ELSE 6 END""",
    "r7_expansion": "WITH " + _C + """, se AS (SELECT id, score FROM sc ORDER BY score DESC, id LIMIT 15), li AS (SELECT DISTINCT parent FROM c WHERE id IN (SELECT id FROM se) AND parent IS NOT NULL),
a AS (SELECT id, score, 'seed' AS via, 0 AS p FROM se UNION ALL SELECT id, 0.7, 'parent', 1 FROM c WHERE id IN (SELECT parent FROM li) UNION ALL SELECT id, 0.6, 'sibling', 2 FROM c WHERE parent IN (SELECT parent FROM li))
SELECT id, score, via FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS rn FROM a) WHERE rn = 1""",
    "r8_hierarchical": "WITH " + _C + """, k AS (SELECT content_key FROM sc WHERE level = 'l1' ORDER BY score DESC, id LIMIT 10),
r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS rn FROM sc WHERE level IN ('l2', 'l3') AND content_key IN (SELECT content_key FROM k))
SELECT id, level, content_key, score FROM r WHERE rn <= CASE level WHEN 'l3' THEN 9 ELSE 6 END""",
    "r9_bundles": "WITH " + _C + " SELECT id, score FROM sc WHERE bundle_id IN ('bdl_434fda519065', 'bdl_2c44fd71304c') AND source_type IN ('readme', 'overview') ORDER BY score DESC, id LIMIT 10",
    "r11_gain": "WITH " + _GAIN + "SELECT id, gain FROM ga",
    "r12_prune_threshold": "WITH " + _GAIN + "SELECT id, gain FROM ga WHERE gain >= 0.25",
    "r12_prune_topk": "WITH " + _GAIN + "SELECT id, gain FROM ga ORDER BY gain DESC, id LIMIT 10",
    "r12_prune_ratio": "WITH " + _GAIN + ", n AS (SELECT greatest(1, ceil(count(*) * 0.05)) AS n FROM ga), r AS (SELECT *, row_number() OVER (ORDER BY gain DESC, id) AS rn FROM ga) SELECT id, gain FROM r, n WHERE rn <= n",
    "a17_normalised": "WITH " + _GAIN + ", s AS (SELECT min(gain) AS a, max(gain) AS b FROM ga) SELECT id, gain, round(CASE WHEN a = b THEN 1 ELSE (gain - a) / (b - a) END, 6) AS normal FROM ga, s",
    "r16_by_hash": "WITH " + _C + "SELECT content_hash, min(id) AS first_id, count(*) AS chunks FROM c WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "r17_list_content": "WITH " + _C + "SELECT content_key, count(*) FILTER (level = 'l1') AS l1, count(*) FILTER (level = 'l2') AS l2, count(*) FILTER (level = 'l3') AS l3 FROM c WHERE content_key IS NOT NULL GROUP BY 1",
    "r19_stats": "WITH " + _C + f"SELECT bundle_id, source_type, count(*) AS chunks, count(*) FILTER (v IS NOT NULL AND {_OK.format('v')}) AS with_vector FROM c GROUP BY ALL",
    "d1_exact_dedup": "WITH " + _C + "SELECT min(id) AS id FROM c WHERE content_hash IS NOT NULL GROUP BY content_hash",
    "j6_parents": "WITH " + _C + "SELECT a.id, a.parent, b.level AS parent_level FROM c a JOIN c b ON a.parent = b.id",
    "j7_siblings": "WITH " + _C + "SELECT parent, count(*) AS children, min(chunk_index) AS first_index FROM c WHERE parent IS NOT NULL GROUP BY parent",
    "j17_invalid_parents": "WITH " + _C + "SELECT id, parent FROM c WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM c)",
    "a6_levels": "WITH " + _C + "SELECT content_key, level, count(*) AS chunks FROM c GROUP BY ALL",
    "v6_entropy": """WITH p AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: exp(-abs(x::DOUBLE))) AS p FROM embeddings),
n AS (SELECT vec_id, list_transform(p, lambda x: x / list_sum(p)) AS p FROM p), h AS (SELECT vec_id, -list_sum(list_transform(p, lambda x: x * ln(x))) AS h FROM n)
SELECT vec_id, round(h, 6) AS entropy, round(h / ln(5.0), 6) AS normalised FROM h""",
    "v8_uncertainty": """SELECT CASE WHEN regexp_matches(lower(text), 'random|creative|guess|story') THEN 0.8 WHEN regexp_matches(lower(text), '1\\+1|capital of france|say "yes" or "no"|exact sequence') THEN 0.12
  ELSE 0.45 END::DOUBLE AS nu, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "w13_neighbours": "WITH " + _C + """SELECT id, lag(length(content)) OVER w AS before, lead(length(content)) OVER w AS after FROM c
WINDOW w AS (PARTITION BY content_key ORDER BY chunk_index NULLS FIRST, id)""",
}
