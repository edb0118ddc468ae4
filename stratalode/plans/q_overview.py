"""Queries of whole repositories, summaries of checks, contexts and memory statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunking, code, crawl, documents, ingest, memory, outline, overview, retrieval
from ..session import table
from .q_code import _files, _metrics, _PF
from .q_ingest import _LANG, EXT, PRESENT
from .q_memory import _M, _rows
from .q_oracles import _METRICS
from .q_retrieval import _C, _GAIN, QUESTION, _chunks, _scored

FRAMEWORKS = ("react", "flask", "django", "express", "spring", "pandas", "numpy")


def _present(spark, d):
    return ingest.present(table(spark, d, "files"))


def g4_facts(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    found = F.filter(F.array(*[F.when(low.contains(f), F.lit(f)) for f in FRAMEWORKS]), lambda x: x.isNotNull())
    return overview.repository_facts(_present(spark, d), found).drop("description")


def g6_names(spark, d):
    return table(spark, d, "bundles").where("repo is not null").select("bundle_id", F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), overview.display_name(F.col("repo"))).alias("name"))


def g7_tree(spark, d):
    return overview.rendered_tree(_present(spark, d), 2)


def g7_candidates(spark, d):
    return overview.entry_candidates(_present(spark, d))


def g2_imports(spark, d):
    return overview.import_rows(_files(spark, d)).where(F.col("target").rlike(r"^[\w.@/:-]+$"))


def g10_merged_cards(spark, d):
    """Cards of the bundles before and after an update: tags are united, names replaced where they are given."""
    b = table(spark, d, "bundles").where("repo is not null").select("repo", "display_name", "primary_lang", "tags")
    new = b.where(F.length("repo") % 2 == 0).select("repo", F.lit(None).cast("string").alias("display_name"), F.lit("new").alias("primary_lang"), F.array(F.lit("updated")).alias("tags"))
    return overview.merge_cards(b, new).select("repo", "display_name", "primary_lang", F.array_join("tags", ",").alias("tags"))


def a14_summary(spark, d):
    """Issues of all kinds of metrics by severity, with the number of different files."""
    return overview.issue_summary(code.metric_issues(_metrics(spark, d)))


def a7_models(spark, d):
    """Memory statistics with the number of models per scope, whether they are mixed, and whether enough is new since the last reflection."""
    m = _rows(spark, d).withColumn("model", F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string"))).withColumn("reflected_ms", F.lit(1_740_000_000_000))
    return memory.scope_stats(m)


def w13_context(spark, d):
    """Every chunk with the last and first hundred characters of its neighbours."""
    w = Window.partitionBy("content_key").orderBy(F.col("chunk_index").asc_nulls_first(), "id")
    return _chunks(spark, d).select("id", F.expr("right(lag(content) over (partition by content_key order by chunk_index nulls first, id), 100)").alias("before"), F.substring(F.lead("content").over(w), 1, 100).alias("after"))


def t25_paper_titles(spark, d):
    """The title of a paper: the commonest title of its chunks, else the first heading of its first page."""
    m = F.col("metadata")
    c = table(spark, d, "chunks").dropDuplicates(["id"]).where(m["paper_id"].isNotNull()).select("id", m["paper_id"].alias("paper"), F.nullif(F.trim(m["paper_title"]), F.lit("")).alias("title"))
    n = c.where("title is not null").groupBy("paper", "title").agg(F.count("*").alias("n"))
    best = n.groupBy("paper").agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col("title").alias("t"))).alias("b")).select("paper", F.col("b.t").alias("title"))
    return c.select("paper").distinct().join(best, "paper", "left").select("paper", F.coalesce("title", F.col("paper")).alias("title"))


def r18_related(spark, d):
    """Repositories that share a tag with one, within two steps over the tags."""
    b = table(spark, d, "bundles").where("repo is not null")
    links = b.select(F.col("repo").alias("src"), F.explode("tags").alias("tag")).select("src", F.concat(F.lit("tag:"), "tag").alias("dst"))
    entities = b.select(F.col("repo").alias("entity")).unionByName(links.select(F.col("dst").alias("entity"))).distinct()
    first = b.where(F.size("tags") > 0).agg(F.min("repo")).first()[0]
    return overview.related(entities, links, first, 2)


def x8_modal_rows(spark, d):
    """The rows of the modal index: kind, words of the heading, size."""
    m = F.col("metadata")
    c = table(spark, d, "chunks").dropDuplicates(["id"]).where(m["chunk_type"].isin("table", "formula", "figure", "code"))
    return c.select("id", m["chunk_type"].alias("kind"), F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(m["section_heading"], F.lit(""))), r"[^a-z0-9]+"), lambda x: F.length(x) > 2))), " ").alias("keywords"),
                    F.length("content").alias("characters"))


def c6_contexts(spark, d):
    """Title and abstract of every document: the first heading, and the first 500 characters after it."""
    t = table(spark, d, "documents").where("text is not null")
    title = F.trim(F.regexp_extract("text", r"(?m)^#{1,6}[ \t]+(\S.*)$", 1))
    rest = F.trim(F.regexp_replace("text", r"^\s*#{1,6}[ \t][^\n]*\n?", ""))
    return t.select("doc_id", F.nullif(title, F.lit("")).alias("title"), F.substring(rest, 1, 500).alias("abstract"))


def j5_sitemap(spark, d):
    """Bundles whose sitemap entry is newer than the last fetch of their page."""
    b = table(spark, d, "bundles").where("repo is not null")
    fetched = b.where(F.length("repo") % 5 != 0).select(F.col("repo").alias("url"), F.expr("created_at + interval 30 days").alias("fetched_at"))
    return crawl.changed_in_sitemap(b.select(F.col("repo").alias("url"), F.col("updated_at").alias("lastmod")), fetched)


def i3_due(spark, d):
    """Statuses of index runs whose last finished run is a week old on a given day."""
    return crawl.full_due(table(spark, d, "index_runs").select(F.col("status").alias("site"), F.col("finished_at").alias("full_at")), F.lit("2025-06-01").cast("timestamp_ntz"))


def r13_verified(spark, d):
    """The answer without a model, with its support, tried again with more chunks where that is low."""
    text, support, used = retrieval.answer(_scored(spark, d), QUESTION)
    return spark.createDataFrame([(text, support, used)], "answer string, support double, chunks int")


def k13_depths(spark, d):
    """Design patterns by all three depths of evidence."""
    f = _files(spark, d)
    return code.pattern_evidence(code.definitions(f), outline.symbols(f), 3)


def c14_bridge(spark, d):
    """Chunks from all sources in one frame: cards, readme sections, code symbols."""
    b = table(spark, d, "bundles").select(F.col("bundle_id").alias("card_id"), F.col("display_name").alias("name"), "repo", "primary_lang", "tags")
    cards = documents.card_chunks(b, {"summary": "repo", "tech_stack": "primary_lang", "use_case": "tags"}).select(F.lit("repocard").alias("source"), F.col("card_id").alias("key"), "content", F.lit("l1").alias("level"))
    docs = chunking.level_chunks(table(spark, d, "documents").where("doc_kind = 'readme'"), "doc_id", "text", 2).select(F.lit("readme").alias("source"), F.col("doc").alias("key"), "content", F.lit("l2").alias("level"))
    s = outline.symbols(_files(spark, d)).select(F.lit("code").alias("source"), F.concat_ws("#", "path", "name").alias("key"), F.concat_ws(" ", "kind", "name").alias("content"), F.lit("l2").alias("level"))
    return cards.unionByName(docs).unionByName(s).groupBy("source", "level").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("characters"))


def w6_pruned(spark, d):
    """Pruning by halves until thirty are left."""
    from .q_retrieval import r11_gain

    return retrieval.prune_until(r11_gain(spark, d), 30)


def g9_quality(spark, d):
    """Per area what was checked and what failed: files and documents without text, chunks without text, heading or vector, cards without a name."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    area = lambda name, df, bad: df.agg(F.count("*").alias("checked"), F.count_if(bad).alias("failed")).select(F.lit(name).alias("area"), "checked", "failed")
    c = _chunks(spark, d)
    parts = [area("files", _present(spark, d), blank(F.col("text"))), area("documents", table(spark, d, "documents"), blank(F.col("text"))), area("chunks", c, blank(F.col("content"))),
             area("vectors", c, ~F.coalesce(retrieval.usable(F.col("v")), F.lit(False))), area("cards", table(spark, d, "bundles"), blank(F.col("display_name")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {f.__name__: f for f in (w6_pruned, g9_quality, j5_sitemap, i3_due, r13_verified, k13_depths, c14_bridge, g4_facts, g6_names, g7_tree, g7_candidates, g2_imports, g10_merged_cards, a14_summary, a7_models, w13_context, t25_paper_titles, r18_related, x8_modal_rows, c6_contexts)}
_FW = ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{f}') THEN '{f}' END" for f in FRAMEWORKS)
ORACLES = {
    "w6_pruned": "WITH RECURSIVE " + _GAIN.rstrip() + """, cn AS (SELECT count(*) AS n FROM ga), k(n) AS (SELECT n FROM cn UNION ALL SELECT greatest(1, ceil(n * 0.5))::BIGINT FROM k WHERE n > 30),
r AS (SELECT id, gain, row_number() OVER (ORDER BY gain DESC, id) AS rn FROM ga) SELECT id, gain FROM r WHERE rn <= (SELECT min(n) FROM k)""",
    "g9_quality": f"""WITH {_C.rstrip()}, {PRESENT} SELECT 'files' AS area, count(*) AS checked, count(*) FILTER (trim(coalesce(text, ''), ' ') = '') AS failed FROM pf
UNION ALL SELECT 'documents', count(*), count(*) FILTER (trim(coalesce(text, ''), ' ') = '') FROM documents UNION ALL SELECT 'chunks', count(*), count(*) FILTER (trim(coalesce(content, ''), ' ') = '') FROM c
UNION ALL SELECT 'vectors', count(*), count(*) FILTER (id NOT IN (SELECT id FROM sc)) FROM c UNION ALL SELECT 'cards', count(*), count(*) FILTER (trim(coalesce(display_name, ''), ' ') = '') FROM bundles""",
    "j5_sitemap": """WITH b AS (SELECT repo AS url, updated_at AS lastmod, CASE WHEN length(repo) % 5 <> 0 THEN created_at + INTERVAL 30 DAY END AS fetched_at FROM bundles WHERE repo IS NOT NULL)
SELECT url, lastmod FROM b WHERE fetched_at IS NULL OR lastmod IS NULL OR lastmod > fetched_at""",
    "i3_due": "SELECT status AS site, coalesce(max(finished_at) <= TIMESTAMP '2025-06-01' - INTERVAL 7 DAY, TRUE) AS due FROM index_runs GROUP BY status",
    "g4_facts": f"""WITH {PRESENT}, x AS (SELECT *, {EXT.format('rel')} AS e, regexp_extract(rel, '[^/]*$') AS b FROM pf), y AS (SELECT *, {_LANG} AS language FROM x),
fw AS (SELECT repo, array_to_string(list_sort(list(DISTINCT f)), ',') AS frameworks FROM (SELECT repo, unnest([{_FW}]) AS f FROM pf) WHERE f IS NOT NULL GROUP BY repo),
ml AS (SELECT repo, language, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, language) AS rn FROM y WHERE language IS NOT NULL AND kind = 'code' GROUP BY repo, language)
SELECT y.repo, array_to_string(list_transform(string_split(trim(regexp_replace(string_split(y.repo, '/')[-1], '[-_.]+', ' ', 'g'), ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name,
  any_value(ml.language) AS main_language, count(*) AS files, sum(coalesce(bytes, 0))::BIGINT AS bytes, count(*) FILTER (kind = 'code') AS code_files, count(*) FILTER (kind = 'doc') AS documents,
  count(*) FILTER (regexp_matches(rel, '(?i)(^|/)(test|tests|__tests__|spec)/|\\.(test|spec)\\.')) AS tests, count(*) FILTER (regexp_matches(b, '{code.ENTRY}')) AS entry_points, coalesce(any_value(fw.frameworks), '') AS frameworks
FROM y LEFT JOIN fw ON fw.repo = y.repo LEFT JOIN ml ON ml.repo = y.repo AND ml.rn = 1 GROUP BY y.repo""",
    "g6_names": """SELECT bundle_id, coalesce(nullif(trim(display_name, ' '), ''), array_to_string(list_transform(string_split(trim(regexp_replace(string_split(repo, '/')[-1], '[-_.]+', ' ', 'g'), ' '), ' '),
  lambda w: upper(w[1]) || lower(w[2:])), ' ')) AS name FROM bundles WHERE repo IS NOT NULL""",
    "g7_tree": f"""WITH {PRESENT}, s AS (SELECT repo, string_split(rel, '/') AS p FROM pf), n AS (SELECT repo, p, unnest([1, 2]) AS n FROM s), f AS (SELECT repo, n, array_to_string(p[1:n], '/') AS place, len(p) > n AS folder FROM n WHERE n <= len(p)),
g AS (SELECT repo, n, place, bool_or(folder) AS folder, count(*) AS c FROM f GROUP BY ALL)
SELECT repo, place, CASE WHEN n = 2 THEN '  ' ELSE '' END || string_split(place, '/')[-1] || CASE WHEN folder THEN '/ (' || c || ')' ELSE '' END AS line FROM g""",
    "g7_candidates": f"""WITH {PRESENT}, k AS (SELECT repo, rel AS path, len(string_split(rel, '/')) AS depth, CASE WHEN starts_with(lower(regexp_extract(rel, '[^/]*$')), 'readme') THEN 0 WHEN regexp_matches(regexp_extract(rel, '[^/]*$'), '{code.ENTRY}') THEN 1
  WHEN regexp_matches(text, '(?m)^\\s*(if __name__ ==|func main\\(|fn main\\(|public static void main)') THEN 2 END AS kind FROM pf),
r AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY kind, depth, path) AS rank FROM k WHERE kind IS NOT NULL) SELECT repo, path, rank FROM r WHERE rank <= 5""",
    "g2_imports": f"""WITH {_PF}, g AS (SELECT path, regexp_extract_all(body, '{overview.IMPORT.replace("'", "''")}', 0) AS l FROM cf WHERE text IS NOT NULL),
u AS (SELECT path, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS nth FROM g),
t AS (SELECT path, nth, CASE WHEN regexp_matches(line, '^\\s*import\\s.*[''"]') THEN regexp_extract(line, '[''"]([^''"]+)[''"]', 1) WHEN regexp_matches(line, '^\\s*from') THEN regexp_extract(line, 'from[ \\t]+([\\w.]+)', 1)
  WHEN regexp_matches(line, '#include') THEN regexp_extract(line, '[<"]([^>"]+)[>"]', 1) ELSE regexp_extract(line, '(?:import|use)[ \\t]+([\\w.:]+)', 1) END AS target FROM u)
SELECT path, nth, target FROM t WHERE regexp_matches(target, '^[\\w.@/:-]+$')""",
    "g10_merged_cards": """SELECT repo, display_name, CASE WHEN length(repo) % 2 = 0 THEN 'new' ELSE primary_lang END AS primary_lang,
  array_to_string(list_sort(list_distinct(CASE WHEN length(repo) % 2 = 0 THEN list_append(coalesce(tags, []), 'updated') ELSE coalesce(tags, []) END)), ',') AS tags FROM bundles WHERE repo IS NOT NULL""",
    "a14_summary": f"""WITH {_METRICS}, i AS (SELECT path, CASE WHEN CASE WHEN rule = 'nesting' THEN value > most + 2 ELSE value > 2 * most END THEN 'error' ELSE 'warning' END AS severity FROM al WHERE value > most)
SELECT severity, count(*) AS issues, count(DISTINCT path) AS files FROM i GROUP BY severity""",
    "a7_models": f"""WITH {_M} SELECT user_id, layer, count(*) AS memories, count(DISTINCT doc_id % 2) AS models, count(DISTINCT doc_id % 2) > 1 AS mixed, count(*) FILTER (created_ms > 1740000000000) >= 10 AS should_reflect FROM m GROUP BY user_id, layer""",
    "w13_context": f"""WITH {_C} SELECT id, right(lag(content) OVER w, 100) AS before, substr(lead(content) OVER w, 1, 100) AS after FROM c WINDOW w AS (PARTITION BY content_key ORDER BY chunk_index NULLS FIRST, id)""",
    "t25_paper_titles": """WITH c AS (SELECT id, any_value(metadata) AS m FROM chunks GROUP BY id), t AS (SELECT m.paper_id AS paper, nullif(trim(m.paper_title, ' '), '') AS title FROM c WHERE m.paper_id IS NOT NULL),
r AS (SELECT paper, title, row_number() OVER (PARTITION BY paper ORDER BY count(*) DESC, title) AS rn FROM t WHERE title IS NOT NULL GROUP BY paper, title)
SELECT p.paper, coalesce(r.title, p.paper) AS title FROM (SELECT DISTINCT paper FROM t) p LEFT JOIN r ON r.paper = p.paper AND rn = 1""",
    "r18_related": """WITH b AS (SELECT repo, tags FROM bundles WHERE repo IS NOT NULL), f AS (SELECT min(repo) AS repo FROM b WHERE len(tags) > 0), l AS (SELECT repo, unnest(tags) AS tag FROM b),
t AS (SELECT DISTINCT tag FROM l JOIN f USING (repo))
SELECT repo AS entity, 0 AS distance FROM f UNION ALL SELECT 'tag:' || tag, 1 FROM t UNION ALL SELECT DISTINCT l.repo, 2 FROM l JOIN t USING (tag) WHERE l.repo NOT IN (SELECT repo FROM f)""",
    "x8_modal_rows": """WITH c AS (SELECT id, any_value(content) AS content, any_value(metadata) AS m FROM chunks GROUP BY id)
SELECT id, m.chunk_type AS kind, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(m.section_heading, '')), '[^a-z0-9]+'), lambda x: length(x) > 2))), ' ') AS keywords, length(content) AS characters
FROM c WHERE m.chunk_type IN ('table', 'formula', 'figure', 'code')""",
    "c6_contexts": """SELECT doc_id, nullif(trim(regexp_extract(text, '(?m)^#{1,6}[ \\t]+(\\S.*)$', 1), ' '), '') AS title, substr(trim(regexp_replace(text, '^\\s*#{1,6}[ \\t][^\\n]*\\n?', ''), ' '), 1, 500) AS abstract FROM documents WHERE text IS NOT NULL""",
}
