"""Queries of retrieval modes, raw full-text syntax, the incremental index, crawling, archives, chunking by level and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core.manifest import ManifestStore
from ..operators import chunking, crawl, ingest, memory, outline, retrieval, search
from ..session import table, workspace
from ..sources import archives
from .q_code import _DEF, _EDGES, _PF, _files
from .q_ingest import _LINES, PRESENT
from .q_retrieval import _C, QUESTION, _chunks, _query, _scored
from .q_search import _lines

BUNDLES = ["bdl_434fda519065", "bdl_2c44fd71304c"]
RAW = 'fts:(snapshot OR "dense lockfile") AND gateway NOT shard'
SITE = "https://site.example"


def r3_local(spark, d):
    return retrieval.local(_chunks(spark, d), F.col("v"), _query(spark, d), 10, BUNDLES).select("id", "score")


def r14_modes(spark, d):
    """The modes side by side; the hybrid one has a query of its own."""
    c, q = _chunks(spark, d), _query(spark, d)
    parts = [retrieval.retrieve(c, m, QUESTION, q, 12, BUNDLES if m == "local" else None).withColumn("mode", F.lit(m)) for m in retrieval.MODES if m != "hybrid"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("mode", "id", "score")


def r10_two_hops(spark, d):
    c = _chunks(spark, d).where("content is not null")
    seeds = retrieval.top_k(_scored(spark, d).where("content is not null"), 40, "id")
    return retrieval.complete(seeds, c, F.col("content").rlike(r"(?i)\bthe rest\b"), 2)


def j10_near(spark, d):
    """Near rows of a write batch (every twentieth vector) among all vectors of its label."""
    m = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", F.lit("semantic").alias("layer"), F.col("label").cast("string").alias("user_id"), F.col("embedding").alias("vector"))
    return memory.near_existing(m.where("vec_id % 20 = 0"), m, threshold=0.3)


def j15_listing(spark, d):
    m = F.col("metadata")
    rows = table(spark, d, "chunks").select("id", m["content_hash"].alias("content_hash"), m["repo_id"].alias("repo_id"), m["paper_id"].alias("paper_id")).dropDuplicates(["id"])
    return retrieval.list_by_keys(_chunks(spark, d).select("id", "level", "bundle_id").join(rows, "id"))


def r19_sample(spark, d):
    """Three rows of each level by the hash of their id."""
    from pyspark.sql import Window

    w = Window.partitionBy("level").orderBy(F.sha2("id", 256), "id")
    return _chunks(spark, d).select("id", "level").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("id", "level", "rn")


def r19_diagnose(spark, d):
    """What is wrong per level: no text, no vector, a parent that does not exist, an id written more than once."""
    c = _chunks(spark, d)
    twice = table(spark, d, "chunks").groupBy("id").agg(F.count("*").alias("copies"))
    ids = c.select(F.col("id").alias("parent"), F.lit(1).alias("there"))
    rows = c.join(twice, "id").join(ids, "parent", "left")
    return rows.groupBy("level").agg(
        F.count("*").alias("chunks"), F.count_if(F.trim(F.coalesce("content", F.lit(""))) == "").alias("without_text"), F.count_if(~F.coalesce(retrieval.usable(F.col("v")), F.lit(False))).alias("without_vector"),
        F.count_if(F.col("parent").isNotNull() & F.col("there").isNull()).alias("lost_parents"), F.count_if(F.col("copies") > 1).alias("repeated"))


def r19_delete(spark, d):
    """What stays after a bundle is deleted: an anti-join with the ids of the bundle."""
    c = _chunks(spark, d).select("id", "bundle_id", "level")
    gone = c.where(F.col("bundle_id") == BUNDLES[0]).select("id")
    return c.join(gone, "id", "left_anti").groupBy("level").agg(F.count("*").alias("chunks"))


def t2_raw_query(spark, d):
    return search.raw_search(_lines(spark, d), RAW)


def x2_incremental(spark, d):
    """Terms of the index after it met the oldest rows of the files and then the present ones."""
    files = table(spark, d, "files").where("path is not null and text is not null").select("path", "bytes", "sha256", "text", "updated_at")
    store = ManifestStore(spark, workspace(spark, "index"))
    for rule in (F.min, F.max):
        rows = files.groupBy("path").agg(rule(F.struct("updated_at", "sha256", "bytes", "text")).alias("r")).select("path", "r.bytes", "r.sha256", "r.text")
        search.update_index(store, rows)
    return search.indexed_terms(store)


def _site(spark, d):
    """Pages of a site, each with links to two further and one nearer page."""
    i = F.col("doc_id")
    url = lambda x: F.concat(F.lit(SITE + "/d/"), x.cast("string"))
    return table(spark, d, "documents").select(url(i).alias("url"), F.array(url(2 * i + 1), url(2 * i + 2), url((i / 3).cast("bigint"))).alias("links"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "ingested_at")


def s6_crawl(spark, d):
    starts = spark.createDataFrame([(SITE + "/d/0",), (SITE + "/d/9",)], "url string")
    robots = crawl.robots_rules(spark.createDataFrame([(SITE, "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /d/4\nDisallow:\n")], "origin string, text string"), "origin", F.col("text"))
    return crawl.breadth_first(_site(spark, d), starts, max_depth=20, max_pages=None, exclude=[r"7$"], robots=robots)


def s6_capped(spark, d):
    return crawl.breadth_first(_site(spark, d), spark.createDataFrame([(SITE + "/d/1",)], "url string"), max_depth=3, max_pages=10)


def s7_listed(spark, d):
    wanted = table(spark, d, "documents").where("doc_id % 11 = 0").select(F.concat(F.lit("HTTPS://Site.Example/d/"), F.col("doc_id").cast("string"), F.lit("#part")).alias("url"))
    return crawl.only(_site(spark, d), wanted).select("url")


def s9_sitemap(spark, d):
    """The pages below a sitemap index of one file per kind of bundle, one of them of another origin and one twice."""
    b = table(spark, d, "bundles").where("repo is not null").select(F.coalesce("kind", F.lit("none")).alias("kind"), "repo", "updated_at")
    when = F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format("updated_at", "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit("<lastmod>soon</lastmod>"))
    entry = F.concat(F.lit("<url><loc> " + SITE + "/"), F.col("repo"), F.lit(" </loc>"), when, F.lit("</url>"))
    subs = b.groupBy(F.concat(F.lit(SITE + "/maps/"), F.col("kind"), F.lit(".xml")).alias("url")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("xml"))
    foreign = F.lit("<url><loc>https://other.example/x</loc></url>")
    names = F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), "")
    index = subs.agg(F.concat(F.lit("<sitemapindex>"), names, names, F.lit("</sitemapindex>")).alias("xml")).select(F.lit(SITE + "/sitemap.xml").alias("url"), "xml")
    return crawl.sitemap_urls(subs.select("url", F.concat("xml", foreign).alias("xml")).unionByName(index), SITE + "/sitemap.xml", most=50)


def i1_conditional(spark, d):
    site = _site(spark, d).withColumn("n", F.regexp_extract("url", r"(\d+)$", 1).cast("bigint"))
    state = site.where("n % 7 <> 0").select("url", F.concat(F.lit("t"), (F.col("n") % 3).cast("string")).alias("etag"), F.lit(None).cast("string").alias("modified"), "hash")
    status = F.when(F.col("n") % 5 == 0, 304).when(F.col("n") % 11 == 0, 404).when(F.col("n") % 13 == 0, 405).when(F.col("n") % 17 == 0, 500).otherwise(200)
    answers = site.select("url", F.lit("HEAD").alias("method"), status.alias("status"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("t"), (F.col("n") % 3).cast("string"))).otherwise("new").alias("etag"), F.lit(None).cast("string").alias("modified"), "hash")
    return crawl.conditional(state, answers)


def i4_quick_sample(spark, d):
    return crawl.quick_sample(_site(spark, d).select("url", "hash", F.length("url").alias("depth"))).select("url", "depth")


def s14_best_pages(spark, d):
    """Of a whole reading and of its upper and lower halves the best one."""
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("page"), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.explode(F.array(F.struct(F.lit("lower").alias("reader"), F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)").alias("text")), F.struct(F.lit("upper").alias("reader"), F.substring("text", F.lit(1), half).alias("text")),
                                F.struct(F.lit("whole").alias("reader"), F.col("text").alias("text")))).alias("r")
    return crawl.best_pages(t.select("page", parts).select("page", "r.reader", "r.text")).select("page", "reader", F.round("points", 6).alias("points"))


def s4_archives(spark, d):
    """Files of archives of bounded size: what went in comes out."""
    f = ingest.present(table(spark, d, "files")).where("text is not null")
    packed = archives.pack(f.select(F.concat_ws("/", "repo", F.pmod(F.xxhash64("path"), F.lit(64)).cast("string")).alias("archive"), "path", "text"))
    return archives.archive_members(packed, id_col="archive").select("path", F.length("text").alias("characters"), "error")


def s26_feed(spark, d):
    b = table(spark, d, "bundles").where("repo is not null")
    xml = F.concat(F.lit("<feed><entry><id>http://papers.example/abs/"), F.col("bundle_id"), F.lit("v2</id><title>The\n  "), F.col("repo"), F.lit("</title><summary> of "), F.coalesce("kind", F.lit("none")),
                   F.lit("</summary><published>2024-05-06T07:08:09Z</published><author><name>A B</name></author><author><name> C D </name></author><category term=\"cs.IR\"/></entry></feed>"))
    e = archives.feed_entries(b.select(xml.alias("xml")), "xml")
    return e.select("paper", "title", "summary", F.array_join(F.transform("authors", F.trim), "; ").alias("authors"), F.array_join("categories", " ").alias("categories"))


def c9_adaptive(spark, d):
    c = chunking.semantic_chunks(table(spark, d, "documents"), "doc_id", "text", packing=chunking.adaptive)
    return c.select("doc", "ordinal", "kind", "first_line", "tokens")


def c10_sections(spark, d):
    return chunking.level_chunks(table(spark, d, "documents"), "doc_id", "text", 2).select("doc", "chunk_id", "parent_id", "level", "kind", "first_line", "last_line")


def c11_scales(spark, d):
    return chunking.level_chunks(table(spark, d, "documents"), "doc_id", "text").groupBy("level", "kind").agg(F.count("*").alias("chunks"))


def c12_prefixed(spark, d):
    c = chunking.level_chunks(table(spark, d, "documents"), "doc_id", "text", paper_col="source").where("parent_id is null")
    return c.select("doc", "first_line", F.regexp_extract("content", r"^(\[[^\]]*\]\[[^\n]*?\]\[[A-Z]+\]) ", 1).alias("prefix"))


def _symbols(spark, d):
    return outline.symbols(_files(spark, d))


def j16_parents(spark, d):
    return outline.method_parents(_symbols(spark, d))


def k6_cognitive(spark, d):
    return _symbols(spark, d).where("kind <> 'class'").select("path", "nth", "name", "cognitive")


def k3_unused(spark, d):
    return outline.unused(_symbols(spark, d))


def k10_documentation(spark, d):
    return outline.documentation(_symbols(spark, d)).groupBy("issue").agg(F.count("*").alias("hits"))


def k11_extension_points(spark, d):
    return outline.extension_points(_files(spark, d))


def k17_references(spark, d):
    code_lines = _lines(spark, d).where("kind = 'code'")
    return outline.references(code_lines, _symbols(spark, d)).groupBy("name").agg(F.count("*").alias("lines"), F.count_if("defines").alias("definitions"))


def g1_relations(spark, d):
    return outline.graph(_symbols(spark, d)).groupBy("relation").agg(F.count("*").alias("edges"))


def w5_page(spark, d):
    """A page of a list with the sign that more follows: one row more is asked for than shown."""
    rows = table(spark, d, "documents").where("updated_at is not null").select("doc_id", "updated_at")
    return memory.page(rows, [F.desc("updated_at"), F.col("doc_id")], 25, 50)


_N = "i AS (SELECT doc_id AS i FROM documents)"
_LN = f"WITH {_LINES}, tm AS (SELECT path, line_no, regexp_extract_all(translate(lower(content), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{{L}}\\p{{N}}]+') AS ts FROM ln)"
_POINTS = """least(length(text) / 100.0, 50.0) + least(len(regexp_extract_all(text, '\\|.*\\|')), 20) + least(len(regexp_extract_all(text, '(?m)^#{1,3}[ \\t]+\\S.*$')) * 2, 10)
 - CASE WHEN regexp_matches(text, '(?i)\\b(?:as an ai|i cannot|here is the (?:extracted|transcribed)|the image shows|output format)\\b') THEN 100 ELSE 0 END
 - CASE WHEN regexp_matches(text, '\\x{FFFD}{2,}|[Il1|]{6,}|(?:\\b\\w\\s){8,}') THEN 15 ELSE 0 END - CASE WHEN length(text) < 50 THEN 20 ELSE 0 END"""

QUERIES = {f.__name__: f for f in (
    r3_local, r14_modes, r10_two_hops, j10_near, j15_listing, r19_sample, r19_diagnose, r19_delete, t2_raw_query, x2_incremental, s6_crawl, s6_capped, s7_listed, s9_sitemap, i1_conditional,
    i4_quick_sample, s14_best_pages, s4_archives, s26_feed, c9_adaptive, c10_sections, c11_scales, c12_prefixed, j16_parents, k6_cognitive, k3_unused, k10_documentation, k11_extension_points,
    k17_references, g1_relations, w5_page)}
_B = "'" + "', '".join(BUNDLES) + "'"
ORACLES = {
    "r3_local": f"WITH {_C} SELECT id, score FROM sc WHERE bundle_id IN ({_B}) ORDER BY score DESC, id LIMIT 10",
    "r14_modes": f"""WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS rn FROM sc),
lo AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS rn FROM sc WHERE bundle_id IN ({_B})),
k AS (SELECT content_key FROM sc WHERE level = 'l1' ORDER BY score DESC, id LIMIT 12),
h AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS rn FROM sc WHERE level IN ('l2', 'l3') AND content_key IN (SELECT content_key FROM k))
SELECT 'naive' AS mode, id, score FROM r WHERE rn <= CASE level WHEN 'l1' THEN 3 WHEN 'l3' THEN 6 ELSE 3 END
UNION ALL SELECT 'local', id, score FROM lo WHERE rn <= CASE level WHEN 'l1' THEN 3 WHEN 'l3' THEN 6 ELSE 3 END
UNION ALL SELECT 'global', id, score FROM r WHERE level = 'l1' AND rn <= 12
UNION ALL SELECT 'hierarchical', id, score FROM h WHERE rn <= CASE level WHEN 'l3' THEN 8 ELSE 4 END""",
    "r10_two_hops": f"""WITH {_C}, t AS (SELECT id, content, content_key, chunk_index FROM c WHERE content IS NOT NULL), s AS (SELECT id, score FROM sc WHERE content IS NOT NULL ORDER BY score DESC, id LIMIT 40),
a1 AS (SELECT content_key, unnest([chunk_index - 1, chunk_index + 1]) AS chunk_index FROM t WHERE id IN (SELECT id FROM s) AND regexp_matches(content, '(?i)\\bthe rest\\b')),
n1 AS (SELECT * FROM t WHERE (content_key, chunk_index) IN (SELECT content_key, chunk_index FROM a1) AND id NOT IN (SELECT id FROM s)),
a2 AS (SELECT content_key, unnest([chunk_index - 1, chunk_index + 1]) AS chunk_index FROM n1 WHERE regexp_matches(content, '(?i)\\bthe rest\\b')),
n2 AS (SELECT * FROM t WHERE (content_key, chunk_index) IN (SELECT content_key, chunk_index FROM a2) AND id NOT IN (SELECT id FROM s) AND id NOT IN (SELECT id FROM n1))
SELECT id, score, 0 AS hop FROM s UNION ALL SELECT id, 0.5, 1 FROM n1 UNION ALL SELECT id, 0.5, 2 FROM n2""",
    "j10_near": """WITH p AS (SELECT a.vec_id AS q, b.vec_id AS e, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, e::VARCHAR) AS rn FROM p WHERE s >= 0.3) SELECT q::VARCHAR AS id, e::VARCHAR AS existing, s AS similarity FROM r WHERE rn <= 5""",
    "j15_listing": f"""WITH {_C}, z AS (SELECT id, level, bundle_id, content_hash AS h, m.repo_id AS r, m.paper_id AS p FROM c JOIN raw USING (id)),
l AS (SELECT coalesce('hash:' || nullif(h, ''), 'repo:' || nullif(r, ''), 'bundle:' || nullif(bundle_id, ''), 'paper:' || nullif(p, '')) AS key, count(*) AS l1 FROM z WHERE level = 'l1' GROUP BY 1 HAVING key IS NOT NULL),
t AS (SELECT id, level, unnest(['hash:' || nullif(h, ''), 'repo:' || r || '@' || substr(h, 1, 12), 'repo:' || nullif(r, ''), 'bundle:' || nullif(bundle_id, ''), 'paper:' || nullif(p, '')]) AS key, unnest([0, 1, 2, 3, 4]) AS k FROM z WHERE level <> 'l1'),
f AS (SELECT id, level, arg_min(key, k) AS key FROM t WHERE key IN (SELECT key FROM l) GROUP BY 1, 2)
SELECT l.key, l.l1, count(f.id) FILTER (f.level = 'l2') AS l2, count(f.id) FILTER (f.level = 'l3') AS l3 FROM l LEFT JOIN f USING (key) GROUP BY 1, 2""",
    "r19_sample": f"WITH {_C}, r AS (SELECT id, level, row_number() OVER (PARTITION BY level ORDER BY sha256(id), id) AS rn FROM c) SELECT id, level, rn FROM r WHERE rn <= 3",
    "r19_diagnose": f"""WITH {_C}, n AS (SELECT id, count(*) AS n FROM chunks GROUP BY id)
SELECT level, count(*) AS chunks, count(*) FILTER (trim(coalesce(content, ''), ' ') = '') AS without_text, count(*) FILTER (c.id NOT IN (SELECT id FROM sc)) AS without_vector,
  count(*) FILTER (parent IS NOT NULL AND parent NOT IN (SELECT id FROM c)) AS lost_parents, count(*) FILTER (n > 1) AS repeated FROM c JOIN n USING (id) GROUP BY level""",
    "r19_delete": f"WITH {_C} SELECT level, count(*) AS chunks FROM c WHERE bundle_id IS DISTINCT FROM '{BUNDLES[0]}' GROUP BY level",
    "t2_raw_query": _LN + """ SELECT path, line_no FROM tm WHERE (list_contains(ts, 'snapshot') OR contains(' ' || array_to_string(ts, ' ') || ' ', ' dense lockfile ')) AND list_contains(ts, 'gateway') AND NOT list_contains(ts, 'shard')""",
    "x2_incremental": _LN + ", u AS (SELECT path, unnest(ts) AS term FROM tm) SELECT term, count(DISTINCT path) AS files, count(*) AS occurrences FROM u GROUP BY term",
    "s6_crawl": f"""WITH RECURSIVE {_N}, ok AS (SELECT i FROM i WHERE NOT ends_with(i::VARCHAR, '7') AND NOT starts_with(i::VARCHAR, '4')),
b(i, depth) AS (SELECT i, 0 FROM ok WHERE i IN (0, 9) UNION SELECT n.i, b.depth + 1 FROM b, LATERAL (SELECT unnest([2 * b.i + 1, 2 * b.i + 2, b.i // 3]) AS i) n WHERE b.depth < 20 AND n.i IN (SELECT i FROM ok))
SELECT '{SITE}/d/' || i AS url, min(depth) AS depth FROM b GROUP BY i""",
    "s6_capped": f"""WITH RECURSIVE {_N}, b(i, depth) AS (SELECT i, 0 FROM i WHERE i = 1 UNION SELECT n.i, b.depth + 1 FROM b, LATERAL (SELECT unnest([2 * b.i + 1, 2 * b.i + 2, b.i // 3]) AS i) n WHERE b.depth < 3 AND n.i IN (SELECT i FROM i))
SELECT '{SITE}/d/' || i AS url, min(depth) AS depth FROM b GROUP BY i ORDER BY depth, url LIMIT 10""",
    "s7_listed": f"SELECT '{SITE}/d/' || doc_id AS url FROM documents WHERE doc_id % 11 = 0",
    "s9_sitemap": f"SELECT '{SITE}/' || repo AS url, max(date_trunc('day', updated_at)) AS lastmod FROM bundles WHERE repo IS NOT NULL GROUP BY 1",
    "i1_conditional": f"""WITH {_N} SELECT '{SITE}/d/' || i AS url, CASE WHEN i % 5 = 0 THEN 'unchanged' WHEN i % 11 = 0 THEN 'gone' WHEN i % 13 = 0 THEN 'ask again' WHEN i % 17 = 0 THEN 'failed' WHEN i % 7 = 0 THEN 'new'
  WHEN i % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS outcome FROM i""",
    "i4_quick_sample": f"WITH {_N} SELECT url, length(url) AS depth FROM (SELECT '{SITE}/d/' || i AS url FROM i) ORDER BY depth, url LIMIT 5",
    "s14_best_pages": f"""WITH r AS (SELECT doc_id AS page, 'whole' AS reader, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'upper', substr(text, 1, length(text) // 2) FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, 'lower', substr(text, length(text) // 2 + 1) FROM documents WHERE text IS NOT NULL), p AS (SELECT page, reader, {_POINTS} AS points FROM r)
SELECT page, reader, round(points, 6) AS points FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY points DESC, reader) AS rn FROM p) WHERE rn = 1""",
    "s4_archives": f"WITH {PRESENT} SELECT path, length(text) AS characters, NULL::VARCHAR AS error FROM pf WHERE text IS NOT NULL",
    "s26_feed": "SELECT bundle_id AS paper, 'The ' || repo AS title, 'of ' || coalesce(kind, 'none') AS summary, 'A B; C D' AS authors, 'cs.IR' AS categories FROM bundles WHERE repo IS NOT NULL",
    "w5_page": """WITH r AS (SELECT doc_id, updated_at, row_number() OVER (ORDER BY updated_at DESC, doc_id) AS rn, count(*) OVER () AS n FROM documents WHERE updated_at IS NOT NULL)
SELECT doc_id, updated_at, n > 75 AS has_more FROM r WHERE rn > 50 AND rn <= 75""",
    "g4_reach": f"""WITH RECURSIVE {_EDGES}, b(path, distance) AS (SELECT DISTINCT src, 0 FROM me WHERE src NOT IN (SELECT dst FROM me)
UNION SELECT me.dst, b.distance + 1 FROM b JOIN me ON me.src = b.path WHERE b.distance < 60) SELECT path, min(distance) AS distance FROM b GROUP BY path""",
    "w7_top_definitions": f"""WITH {_DEF} SELECT path, nth, name, round(least(1.0, 0.3 + CASE WHEN NOT starts_with(name, '_') THEN 0.25 ELSE 0 END
  + CASE WHEN lower(name) IN ('main', 'run', 'execute', 'start', 'init', 'setup', 'bootstrap', 'handlerequest', 'handler', 'serve') THEN 0.2 ELSE 0 END + CASE WHEN kind = 'class' THEN 0.1 ELSE 0 END), 6) AS score
FROM df ORDER BY score DESC, path, nth LIMIT 50""",
    "k5_nesting": f"""WITH {_PF}, s AS (SELECT path, string_split(regexp_replace(body, '[^{{}}()]', '', 'g'), '') AS marks FROM cf WHERE text IS NOT NULL)
SELECT path, coalesce(CASE WHEN len(marks) = 0 OR marks = [''] THEN 0 ELSE list_reduce(list_prepend([0, 0], list_transform(marks, lambda c: [CASE WHEN c IN ('{{', '(') THEN 1 ELSE -1 END, 0])),
  lambda a, x: [greatest(0, a[1] + x[1]), greatest(a[2], a[1] + x[1])])[2] END, 0) AS nesting FROM s""",
    "r14_pipeline": f"""WITH {_C.rstrip()}, r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS rn FROM sc WHERE content IS NOT NULL),
se AS (SELECT id, score FROM r WHERE rn <= CASE level WHEN 'l1' THEN 4 WHEN 'l3' THEN 10 ELSE 6 END), li AS (SELECT DISTINCT parent FROM c WHERE id IN (SELECT id FROM se) AND parent IS NOT NULL),
a AS (SELECT id, score, 0 AS p FROM se UNION ALL SELECT id, 0.7, 1 FROM c WHERE id IN (SELECT parent FROM li) UNION ALL SELECT id, 0.6, 2 FROM c WHERE parent IN (SELECT parent FROM li)),
w AS (SELECT id, score, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS rn FROM a) JOIN (SELECT id, content FROM c) USING (id) WHERE rn = 1 AND content IS NOT NULL),
ga AS (SELECT id, round(0.7 * len(list_intersect(QT, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1))) / QN + 0.3 * greatest(0, least(1, score)), 6) AS gain FROM w)
SELECT id, gain FROM ga ORDER BY gain DESC, id LIMIT 10""",
    "r13_answer": f"WITH {_C} SELECT string_agg(substr(content, 1, 200), chr(10) || '---' || chr(10) ORDER BY score DESC, id) AS answer FROM (SELECT id, content, score FROM sc WHERE content IS NOT NULL ORDER BY score DESC, id LIMIT 5)",
}
_TERMS = sorted({t for t in __import__("re").findall(r"[^\W_]+", QUESTION.lower()) if len(t) > 1})
ORACLES["r14_pipeline"] = ORACLES["r14_pipeline"].replace("QT", "['" + "', '".join(_TERMS) + "']").replace("QN", f"{len(_TERMS)}.0")
