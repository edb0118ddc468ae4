"""Queries of the memory table, derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import memory
from ..session import table

AS_OF = 1_790_000_000_000


def _rows(spark, d):
    i = F.col("doc_id")
    ms = F.unix_millis(F.col("ingested_at").cast("timestamp"))
    base = table(spark, d, "documents").select(
        i.alias("doc_id"), F.element_at(F.array(F.lit("episodic"), F.lit("semantic"), F.lit("procedural")), (i % 3 + 1).cast("int")).alias("layer"),
        F.coalesce("source", F.lit("nobody")).alias("user_id"), F.col("text").alias("content"), F.when(i % 2 == 0, "relation").otherwise("fact").alias("type"),
        F.coalesce("lang", F.lit("xx")).alias("subject"), F.lit("in").alias("predicate"), F.col("bundle_id").alias("object"), F.col("doc_kind").alias("category"),
        ((i * 7 % 10) / 10).alias("confidence"), ((i * 3 % 10) / 10).alias("strength"), (i % 4).cast("int").alias("occurrences"), ms.alias("created_ms"),
        F.coalesce(F.unix_millis(F.col("updated_at").cast("timestamp")), ms).alias("last_ms"), (i % 7).alias("accesses"), F.lit("active").alias("status"))
    mid = memory.memory_id(F.col("layer"), F.col("user_id"), F.col("content"), F.lit("default"), F.col("created_ms"), F.col("type"), F.col("subject"), F.col("predicate"), F.col("object"), F.col("category"))
    return base.withColumn("id", mid)


def t6_memory_ids(spark, d):
    return _rows(spark, d).where("content is not null").select("doc_id", "id")


def f9_gates(spark, d):
    return memory.gate(_rows(spark, d)).select("doc_id", "rejected")


def m1_write(spark, d):
    return memory.write(_rows(spark, d)).select("id", "layer", "user_id", "status", "created_ms")


def j8_conflicts(spark, d):
    return memory.conflicts(memory.write(_rows(spark, d))).select("id", "objects")


def j9_contested(spark, d):
    rel = _rows(spark, d).where("type = 'relation' and object is not null")
    return rel.groupBy("subject", "predicate").agg(F.count("*").alias("hits"), F.count_distinct("object").alias("objects")).where("hits > 1")


def _similarity():
    q = F.array(*[F.lit(x) for x in ("snapshot", "gateway", "lockfile", "shard")])
    return F.round(F.size(F.array_intersect(q, T.terms(F.col("content")))) / 4.0, 6)


def m4_search(spark, d):
    # the lowest document of each memory id stands for its copies; only what the score needs is shuffled, not the texts
    slim = _rows(spark, d).where("content is not null").select("id", "doc_id", F.struct("layer", "last_ms", "accesses", _similarity().alias("sim")).alias("r"))
    one = slim.groupBy("id").agg(F.min_by("r", "doc_id").alias("r")).select("id", "r.*")
    return memory.search(one, F.col("sim"), AS_OF, 20)


def m6_list(spark, d):
    rows = _rows(spark, d).where("content is not null and user_id = 'kestrel-lab/handbook'")
    return rows.orderBy(F.desc("created_ms"), "doc_id").offset(10).limit(20).select("doc_id", "created_ms")


def m7_stats(spark, d):
    return memory.stats(_rows(spark, d).where("content is not null"))


def m8_collect(spark, d):
    return memory.collectable(_rows(spark, d), AS_OF).groupBy("layer").agg(F.count("*").alias("memories"))


def m9_access(spark, d):
    """Access deltas of the events, added in one join."""
    e = table(spark, d, "events")
    deltas = e.select((F.col("user_id") % 1000).alias("id"), F.lit(1).alias("n"), F.unix_millis(F.col("ts").cast("timestamp")).alias("last_ms"))
    base = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("accesses"), F.unix_millis(F.col("ingested_at").cast("timestamp")).alias("last_ms"))
    return memory.apply_access(base, deltas)


def m5_merge(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    new = table(spark, d, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("id"), F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"))
    return memory.merge(old, new)


def a18_patterns(spark, d):
    return memory.patterns(_rows(spark, d).where("content is not null"))


def a19_compress(spark, d):
    return memory.compress(_rows(spark, d).where("content is not null").withColumn("id", F.lpad(F.col("doc_id").cast("string"), 20, "0")))


def m11_facts(spark, d):
    return memory.facts(table(spark, d, "documents"), "doc_id", F.col("text"))


def w8_newest(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("created_ms"), "doc_id")
    return _rows(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("doc_id", "user_id", "rn")


def v11_scores(spark, d):
    from ..functions import vector as V

    return _rows(spark, d).select("doc_id", F.round(V.recency(F.lit(float(AS_OF)), F.col("last_ms")), 9).alias("recency"), F.round(V.frequency(F.col("accesses")), 6).alias("frequency"))


_N = "regexp_replace(regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '\\s+', ' ', 'g'), '[^a-z0-9\\x{{4e00}}-\\x{{9fa5}} ]', '', 'g')"
_M = f"""m0 AS (SELECT doc_id, ['episodic', 'semantic', 'procedural'][doc_id % 3 + 1] AS layer, coalesce(source, 'nobody') AS user_id, text AS content,
  CASE WHEN doc_id % 2 = 0 THEN 'relation' ELSE 'fact' END AS type, coalesce(lang, 'xx') AS subject, 'in' AS predicate, bundle_id AS object, doc_kind AS category,
  (doc_id * 7 % 10) / 10 AS confidence, (doc_id * 3 % 10) / 10 AS strength, doc_id % 4 AS occurrences, (epoch_us(ingested_at) // 1000) AS created_ms,
  coalesce((epoch_us(updated_at) // 1000), (epoch_us(ingested_at) // 1000)) AS last_ms, doc_id % 7 AS accesses FROM documents),
m AS (SELECT *, 'mem_' || substr(layer, 1, 3) || '_' || substr(sha256(CASE WHEN layer = 'episodic' THEN user_id || 'default' || created_ms || substr(sha256(content), 1, 16)
  WHEN layer = 'semantic' AND type = 'relation' AND object IS NOT NULL THEN user_id || 'relation' || {_N.format('subject')} || {_N.format('predicate')} || {_N.format('object')}
  WHEN layer = 'semantic' THEN user_id || 'fact' || {_N.format('content')} ELSE user_id || category || {_N.format('content')} END), 1, 16) AS id FROM m0)"""
_SECRET = " OR ".join(f"regexp_matches(content, '{p}')" for p in T._SECRETS)
_G = _M + f""", g AS (SELECT *, CASE WHEN coalesce(trim(content, ' '), '') = '' THEN 'empty' WHEN {_SECRET} THEN 'secret' WHEN layer = 'semantic' AND confidence < 0.6 THEN 'confidence'
  WHEN layer = 'procedural' AND (occurrences < 2 OR strength < 0.8) THEN 'strength' END AS rejected FROM m)"""
_W = _G + """, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_ms DESC, content) AS rn FROM g WHERE rejected IS NULL) WHERE rn = 1),
cp AS (SELECT * EXCLUDE (rn) FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY layer, user_id ORDER BY created_ms DESC, id) AS rn FROM o) WHERE layer <> 'episodic' OR rn <= 1000),
cf AS (SELECT user_id, subject, predicate, count(DISTINCT object) AS objects FROM cp WHERE type = 'relation' AND object IS NOT NULL GROUP BY ALL HAVING count(DISTINCT object) > 1),
bad AS (SELECT cp.id, cf.objects FROM cp JOIN cf USING (user_id, subject, predicate) WHERE cp.type = 'relation' AND cp.object IS NOT NULL)"""
_PREF = " UNION ALL ".join(f"SELECT doc_id AS id, 'preference' AS kind, 'user' AS subject, trim(unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1)), ' ') AS object, 0.7 AS confidence FROM ok" for p in memory.PREFERENCES)

QUERIES = {f.__name__: f for f in (
    t6_memory_ids, f9_gates, m1_write, j8_conflicts, j9_contested, m4_search, m6_list, m7_stats, m8_collect, m9_access, m5_merge, a18_patterns, a19_compress, m11_facts,
    w8_newest, v11_scores)}
ORACLES = {
    "t6_memory_ids": f"WITH {_M} SELECT doc_id, id FROM m WHERE content IS NOT NULL",
    "f9_gates": f"WITH {_G} SELECT doc_id, rejected FROM g",
    "m1_write": f"WITH {_W} SELECT id, layer, user_id, CASE WHEN id IN (SELECT id FROM bad) THEN 'disputed' ELSE 'active' END AS status, created_ms FROM cp",
    "j8_conflicts": f"WITH {_W} SELECT id, objects FROM bad",
    "j9_contested": f"WITH {_M} SELECT subject, predicate, count(*) AS hits, count(DISTINCT object) AS objects FROM m WHERE type = 'relation' AND object IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "m4_search": f"""WITH {_M}, f AS (SELECT min(doc_id) AS doc_id FROM m WHERE content IS NOT NULL GROUP BY id),
s AS (SELECT id, layer, round(len(list_intersect(['snapshot', 'gateway', 'lockfile', 'shard'], list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1))) / 4.0, 6) AS similarity,
  last_ms, accesses FROM m SEMI JOIN f USING (doc_id)),
h AS (SELECT id, layer, similarity, round(similarity * exp(-0.1 * ({AS_OF} - last_ms) / 86400000.0) * (1 + ln(1 + accesses) * 0.2), 6) AS score FROM s WHERE similarity >= CASE layer WHEN 'procedural' THEN 0.3 ELSE 0.35 END),
r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY score DESC, id) AS rn FROM h)
SELECT id, layer, similarity, score FROM r WHERE rn <= CASE layer WHEN 'procedural' THEN 10 WHEN 'semantic' THEN 7 ELSE 4 END""",
    "m6_list": f"WITH {_M} SELECT doc_id, created_ms FROM m WHERE content IS NOT NULL AND user_id = 'kestrel-lab/handbook' ORDER BY created_ms DESC, doc_id LIMIT 20 OFFSET 10",
    "m7_stats": f"WITH {_M} SELECT user_id, layer, count(*) AS memories, sum(accesses)::BIGINT AS accesses, max(created_ms) AS newest_ms, count(*) >= 10 AS should_reflect FROM m WHERE content IS NOT NULL GROUP BY ALL",
    "m8_collect": f"WITH {_M} SELECT layer, count(*) AS memories FROM m WHERE last_ms < {AS_OF} - 7776000000 OR accesses < 1 GROUP BY layer",
    "m9_access": """WITH dl AS (SELECT user_id % 1000 AS id, count(*) AS n, max((epoch_us(ts) // 1000)) AS l FROM events GROUP BY 1)
SELECT doc_id AS id, doc_id % 7 + coalesce(n, 0) AS accesses, greatest((epoch_us(ingested_at) // 1000), coalesce(l, (epoch_us(ingested_at) // 1000))) AS last_ms FROM documents LEFT JOIN dl ON dl.id = doc_id""",
    "m5_merge": "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents",
    "a18_patterns": f"WITH {_M} SELECT user_id, category, count(*) AS occurrences, round(least(0.7, 0.4 + 0.1 * count(*)), 6) AS confidence FROM m WHERE content IS NOT NULL AND category IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
    "a19_compress": f"""WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, layer ORDER BY created_ms DESC, doc_id) AS rn, count(*) OVER (PARTITION BY user_id, layer) AS n FROM m WHERE content IS NOT NULL)
SELECT user_id, layer, substr(string_agg(substr(content, 1, 500), ' | ' ORDER BY rn), 1, 500) AS summary, round(least(0.6, 0.3 + 0.05 * any_value(n)), 6) AS confidence FROM r WHERE rn <= 500 GROUP BY user_id, layer""",
    "m11_facts": f"""WITH ok AS (SELECT doc_id, text, text AS content FROM documents WHERE text IS NOT NULL AND NOT ({_SECRET.replace('content', 'text')})),
z AS (SELECT doc_id, regexp_extract_all(text, '{memory.DEFINITION}', 1) AS s, regexp_extract_all(text, '{memory.DEFINITION}', 2) AS o FROM ok)
SELECT DISTINCT * FROM ({_PREF} UNION ALL SELECT doc_id, 'definition', unnest(s), trim(unnest(o), ' '), 0.6 FROM z)""",
    "w8_newest": f"WITH {_M} SELECT doc_id, user_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, doc_id) AS rn FROM m) WHERE rn <= 5",
    "v11_scores": f"WITH {_M} SELECT doc_id, round(exp(-0.1 * ({AS_OF} - last_ms) / 86400000.0), 9) AS recency, round(1 + ln(1 + accesses) * 0.2, 6) AS frequency FROM m",
}
