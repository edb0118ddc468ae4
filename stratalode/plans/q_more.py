"""Queries of document operators, configuration, cards and the retrieval pipeline as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code, documents, facts, ingest, retrieval, search
from ..session import table
from ..sources import seams
from .q_code import _DEF, _files
from .q_chunks import _H
from .q_ingest import _CHUNKS, _LANG, EXT, PRESENT
from .q_memory import _M
from .q_retrieval import _C, QUESTION, _chunks, _query, _scored


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


def t10_pages(spark, d):
    return documents.page_lines(_docs(spark, d), "doc_id", F.col("text")).groupBy("doc").agg(F.max("page").alias("last_page"), F.count("*").alias("lines"))


def t14_wrapped(spark, d):
    c = table(spark, d, "chunks").dropDuplicates(["id"]).where("metadata.source_type = 'pdf_text'")
    return documents.merge_wrapped(c, "id", "content")


def h5_markdown(spark, d):
    c = table(spark, d, "chunks").dropDuplicates(["id"]).where("content like '%<%>%'")
    return documents.html_to_markdown(c, "id", "content")


def t26_metadata(spark, d):
    return _docs(spark, d).select("doc_id", documents.metadata(F.col("text")).alias("m")).select("doc_id", "m.*")


def t31_model_json(spark, d):
    """Answers of a model, with the usual damage, parsed again."""
    i = F.col("item_id")
    body = F.concat(F.lit('{"id": '), i.cast("string"), F.lit(', "answer": "'), F.substring(F.md5("question"), 1, 6), F.lit('"'))
    text = (
        F.when(i % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("}\n```"))).when(i % 4 == 1, F.concat(F.lit("Sure: "), body, F.lit(",}")))
        .when(i % 4 == 2, F.translate(F.concat(body, F.lit("}")), '"', "'")).otherwise(F.lit("no json here"))
    )
    return table(spark, d, "eval_items").select("item_id", documents.parse_model_json(text, "id bigint, answer string").alias("x")).select("item_id", "x.id", "x.answer")


def a11_doc_types(spark, d):
    f = ingest.present(table(spark, d, "files")).where("lower(trim(kind)) = 'doc'")
    t = facts.lookup(ingest.extension(F.col("repo_relative_path")), facts.DOC_LANGUAGES)
    return f.select(t.alias("doc_type")).where("doc_type is not null").groupBy("doc_type").agg(F.count("*").alias("files"))


def a11_project_types(spark, d):
    s = facts.structure(ingest.present(table(spark, d, "files")))
    kind = F.when(F.col("doc_files") > 2 * F.col("code_files"), "documentation").when(F.col("code_files") > 2 * F.col("doc_files"), "code").otherwise("mixed")
    return s.select("repo", kind.alias("project_type"))


def k15_purposes(spark, d):
    return ingest.present(table(spark, d, "files")).select("path", documents.config_purpose(F.col("path")).alias("purpose"))


def k15_assignments(spark, d):
    return documents.assignments(_files(spark, d)).groupBy("type").agg(F.count("*").alias("keys"), F.count_distinct("path").alias("files"))


def k15_patterns(spark, d):
    return documents.config_patterns(documents.assignments(_files(spark, d)))


def k16_examples(spark, d):
    blocks = _docs(spark, d).select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("path"), F.explode(F.regexp_extract_all("text", F.lit(r"(?s)```[\w+-]*\n(.*?)\n```"), F.lit(1))).alias("code"))
    return documents.examples(blocks).select("category", "hash", "complexity")


def c16_card_chunks(spark, d):
    b = table(spark, d, "bundles").select(F.col("bundle_id").alias("card_id"), F.col("display_name").alias("name"), "repo", "primary_lang", "tags")
    return documents.card_chunks(b, {"summary": "repo", "tech_stack": "primary_lang", "use_case": "tags"})


def a4_card_stats(spark, d):
    return c16_card_chunks(spark, d).groupBy("kind").agg(F.count("*").alias("chunks"), F.count_distinct("card_id").alias("cards"))


def f13_functions(spark, d):
    """Definitions that a code index takes: public, entry points, and no bare accessors or wrappers."""
    defs = code.definitions(_files(spark, d))
    entry = F.lower("name").isin("main", "run", "execute", "start", "init", "setup", "bootstrap", "handlerequest", "handler", "serve")
    skip = F.col("name").rlike("^(get|set|is|has)[A-Z]|^_")
    return defs.where((F.col("kind") == "class") | entry | ~skip).select("path", "nth", "name")


def w7_top_definitions(spark, d):
    return code.importance(code.definitions(_files(spark, d))).orderBy(F.desc("score"), "path", "nth").limit(50)


def w15_second_page(spark, d):
    f = ingest.present(table(spark, d, "files")).select("path", "bytes")
    _, cursor = documents.page_of(f, ["path"], 25, None, "list")
    return documents.page_of(f, ["path"], 25, cursor, "list")[0]


def g5_entry_points(spark, d):
    name = ingest.basename(F.col("path"))
    return _files(spark, d).where(name.rlike(code.ENTRY) | F.col("text").rlike(r"(?m)^\s*(if __name__ ==|func main\(|fn main\(|public static void main)")).select("path")


def g2_outline(spark, d):
    """Imports and definitions counted per file."""
    t = ingest.normal_text(F.col("text"))
    return _files(spark, d).where("text is not null").select(
        "path", F.regexp_count(t, F.lit(r"(?m)^\s*(import|from|use|#include)\b")).cast("long").alias("imports"), F.regexp_count(t, F.lit(code.DEFINITION)).cast("long").alias("definitions"),
        F.regexp_count(t, F.lit(r"(?m)^\s*(export|pub|public)\b")).cast("long").alias("exports"))


def embed_offline(spark, d):
    e = seams.embed(table(spark, d, "eval_items").withColumn("item", F.col("item_id").cast("string")), "item", "question")
    return e.select("id", F.size("embedding").alias("dims"))


def r13_answer(spark, d):
    """The answer without a model: the best contents joined."""
    best = retrieval.top_k(_scored(spark, d).where("content is not null"), 5, "id").select("id", "score", F.substring("content", 1, 200).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "part"))), lambda x: x["part"])
    return best.agg(F.array_join(parts, "\n---\n").alias("answer"))


def r14_pipeline(spark, d):
    """Hierarchical search, expansion, information gain, pruning: the retrieval pipeline end to end."""
    found = retrieval.quota_top(_scored(spark, d).where("content is not null"), "level", retrieval.raw_quotas(20))
    wide = retrieval.expand(found.select("id", "score"), _chunks(spark, d).select("id", "parent"))
    texts = wide.join(_chunks(spark, d).select("id", "content"), "id").where("content is not null")
    return retrieval.prune(retrieval.information_gain(texts, QUESTION), "topk", 10)


def r15_new_content(spark, d):
    """Chunks whose content is not in the window index yet, by hash."""
    have = table(spark, d, "semantic_index").where("content is not null").select(F.sha2("content", 256).alias("h")).distinct()
    return _chunks(spark, d).where("content is not null").select("id", F.sha2("content", 256).alias("h")).join(have, "h", "left_anti").select("id")


def r18_entities(spark, d):
    """Entities (bundles) by name prefix, with the number of their chunks."""
    m = F.col("metadata")
    c = table(spark, d, "chunks").dropDuplicates(["id"]).groupBy(m["bundle_id"].alias("bundle_id")).agg(F.count("*").alias("chunks"))
    return table(spark, d, "bundles").where(F.col("repo").startswith("northpier/")).join(c, "bundle_id", "left").select("bundle_id", "repo", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def v2_scores(spark, d):
    """Scores as one minus the cosine distance, for the labels of the vectors."""
    s = retrieval.scored(table(spark, d, "embeddings"), F.col("embedding"), _query(spark, d))
    return s.groupBy("label").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score"), 6).alias("best_score"))


def x5_context(spark, d):
    """Hits in code with their enclosing definition, one row per definition."""
    from .q_search import QUERY, _lines

    lines = _lines(spark, d).where("kind = 'code'")
    hits = search.bm25(lines, QUERY).select("path", "line_no")
    e = search.enclosing(lines).join(hits, ["path", "line_no"], "left_semi")
    return e.groupBy("path", "function").agg(F.count("*").alias("hits"), F.min("line_no").alias("first_line"))


def c12_hierarchy(spark, d):
    """Three linked levels of chunks of every document."""
    from ..operators import chunking

    return chunking.hierarchy(_docs(spark, d), "doc_id", "text").select("doc", "chunk_id", "parent_id", "level", "kind", "section", "first_line")


def c12_parents_exist(spark, d):
    """Chunks of the hierarchy whose parent is missing: none."""
    from ..operators import chunking

    h = chunking.hierarchy(_docs(spark, d), "doc_id", "text")
    return h.where("parent_id is not null").select("chunk_id", "parent_id").join(h.select(F.col("chunk_id").alias("parent_id")), "parent_id", "left_anti")


def t11_html_cells(spark, d):
    from ..operators import chunking

    return chunking.html_cells(table(spark, d, "chunks").dropDuplicates(["id"]), "id", F.col("content"))


def t22_resolve(spark, d):
    """Links of HTML chunks against an address of their repository."""
    from ..operators import chunking
    from .q_text import h1_links

    links = h1_links(spark, d).withColumn("base", F.lit("https://docs.example/a/b/"))
    return chunking.resolve_links(links, "base", "link").select("id", "link", "resolved")


def k8_missing_breaks(spark, d):
    from .q_search import _lines

    return code.missing_breaks(_lines(spark, d).where("kind = 'code'"))


def x7_modal_search(spark, d):
    """BM25 over the contents of tables, formulas and figures."""
    m = F.col("metadata")
    c = table(spark, d, "chunks").dropDuplicates(["id"]).where(m["chunk_type"].isin("table", "formula", "figure")).select(F.col("id").alias("path"), F.lit(1).alias("line_no"), "content")
    return search.bm25(c, "stale cache pointer").withColumn("score", F.round("score", 6))


def f7_memory_filter(spark, d):
    from .q_memory import _rows

    m = _rows(spark, d)
    cond = retrieval.where_all([F.col("user_id") == "kestrel-lab/handbook", F.col("type") == "relation", F.col("created_ms") >= 1_730_000_000_000])
    return m.where(cond).select("doc_id", "layer")


def j5_changed_in_sitemap(spark, d):
    """Pages that a sitemap says are newer than the last fetch, or of which it says nothing."""
    docs = table(spark, d, "documents")
    return docs.where(F.col("updated_at").isNull() | (F.col("updated_at") > F.col("ingested_at"))).select("doc_id")


def g9_repo_quality(spark, d):
    """Score of a repository: card 30, code chunks 50 by variety, readme 15, paper 5."""
    m = F.col("metadata")
    c = table(spark, d, "chunks").dropDuplicates(["id"]).groupBy(m["repo_id"].alias("repo")).agg(
        F.bool_or(m["source_type"] == "repocard").alias("card"), F.bool_or(m["source_type"] == "code").alias("code"), F.bool_or(m["source_type"] == "readme").alias("readme"),
        F.bool_or(m["source_type"].startswith("pdf")).alias("paper"))
    i = lambda x, n: F.when(F.col(x), n).otherwise(0)
    return c.where("repo is not null").select("repo", (i("card", 30) + i("code", 50) + i("readme", 15) + i("paper", 5)).cast("long").alias("score"))


def k12_architecture(spark, d):
    """Per repository: files and lines per top folder, the largest first folder."""
    t = ingest.normal_text(F.col("text"))
    f = ingest.present(table(spark, d, "files")).where("text is not null")
    return f.groupBy("repo", F.substring_index("repo_relative_path", "/", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum(F.size(F.split(t, "\n"))).alias("lines"))


def h6_titles(spark, d):
    """The title of a page: its title element, else its first heading."""
    t = F.trim(F.regexp_extract("content", r"(?is)<title[^>]*>([^<]*)</title>", 1))
    h = F.trim(F.regexp_extract("content", r"(?is)<h[1-6][^>]*>([^<]*)</h[1-6]>", 1))
    return table(spark, d, "chunks").dropDuplicates(["id"]).where("content like '%<%'").select("id", F.when(t != "", t).otherwise(h).alias("title"))


def i3_full_crawl(spark, d):
    """Sources whose last ingest is seven days or more before the newest of all: due for a full run."""
    docs = table(spark, d, "documents")
    newest = docs.agg(F.max("ingested_at").alias("m")).first()["m"]
    return docs.where("source is not null").groupBy("source").agg(F.max("ingested_at").alias("last")).select("source", (F.datediff(F.lit(newest), F.col("last")) >= 7).alias("due"))


def g10_cards(spark, d):
    """A card of each repository without a model: languages, files, bytes, documents."""
    f = ingest.present(table(spark, d, "files"))
    lang = facts.language_of(F.col("repo_relative_path"), F.lower(F.trim("kind")))
    return f.select("repo", "bytes", lang.alias("language"), F.lower(F.trim("kind")).alias("k")).groupBy("repo").agg(
        F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("k") == "doc").alias("documents"))


def r2_naive(spark, d):
    """Plain retrieval: the best of all levels by cosine."""
    return retrieval.top_k(_scored(spark, d), 10, "id").select("id", "score")


def v9_information_gain(spark, d):
    """Uncertainty of a question alone less that with its passage, by the offline stand-in."""
    from ..functions import vector as V

    e = table(spark, d, "eval_items")
    return e.select("item_id", F.round(V.heuristic_uncertainty(F.col("question")) - V.heuristic_uncertainty(F.concat_ws(" ", "question", "passage")), 6).alias("gain"))


def t25_categories(spark, d):
    """arXiv-style category marks of documents, each once."""
    c = F.array_distinct(F.regexp_extract_all(F.substring("text", 1, 2000), F.lit(r"\[((?:cs|math|stat|physics|q-bio|econ|eess)\.[A-Z]{2})\]"), F.lit(1)))
    return _docs(spark, d).select("doc_id", F.size(c).alias("categories"))


def d6_headings(spark, d):
    """Headings of documents, each text once per document, with the first line that has it."""
    from ..operators import chunking

    h = chunking.headings(_docs(spark, d), "doc_id", F.col("text"))
    return h.groupBy("doc", F.lower("title").alias("title")).agg(F.min("line_no").alias("first_line"))


def f19_paths(spark, d):
    """Whether a path stays inside its root once its dots are resolved."""
    return ingest.present(table(spark, d, "files")).select("path", (~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|\\|\x00")).alias("safe"))


def w16_first_links(spark, d):
    """The first 20 addresses of all documents by order of address."""
    from ..operators import chunking

    return chunking.llms_links(_docs(spark, d), "doc_id", F.col("text")).select("url").distinct().orderBy("url").limit(20)


def u3_first_type(spark, d):
    """Contents over the coarse levels, each with the first type that has it and that type's count."""
    m = F.col("metadata")
    c = table(spark, d, "chunks").dropDuplicates(["id"]).where(m["source_type"].isin("overview", "repocard"))
    g = c.groupBy(m["bundle_id"].alias("content"), m["source_type"].alias("type")).agg(F.count("*").alias("n"))
    return g.groupBy("content").agg(F.min(F.struct("type", "n")).alias("x")).select("content", "x.type", "x.n")


_meta = lambda p, pre: f"CASE WHEN regexp_extract(text, '{p}', 1) <> '' THEN '{pre}' || regexp_replace(regexp_replace(regexp_extract(text, '{p}', 1), '[.,;:)\\]]+$', ''), '\\.git$', '') END"
_PF = PRESENT + ", cf AS (SELECT * FROM pf WHERE kind = 'code')"
_ASG = _PF + """, al AS (SELECT path, unnest(string_split(body, chr(10))) AS line FROM cf WHERE text IS NOT NULL),
ag AS (SELECT path, regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(.*)$', 1) AS key, trim(regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(.*)$', 2), ' ') AS v FROM al)
"""
_purpose = " ".join("WHEN " + " OR ".join(f"contains(lower(path), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in documents.PURPOSES)
_doc = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in facts.DOC_LANGUAGES.items())
_CARD = """cd AS (SELECT bundle_id AS card_id, 'summary' AS kind, 0 AS nth, concat_ws(chr(10), concat_ws(' - ', display_name, 'summary'), repo) AS content FROM bundles WHERE trim(repo, ' ') <> ''
UNION ALL SELECT bundle_id, 'tech_stack', 0, concat_ws(chr(10), concat_ws(' - ', display_name, 'tech_stack'), primary_lang) FROM bundles WHERE trim(primary_lang, ' ') <> ''
UNION ALL SELECT bundle_id, 'use_case', nth - 1, concat_ws(chr(10), concat_ws(' - ', display_name, 'use_case'), t) FROM (SELECT bundle_id, display_name, unnest(tags) AS t, generate_subscripts(tags, 1) AS nth FROM bundles) WHERE trim(t, ' ') <> '')"""

QUERIES = {f.__name__: f for f in (
    t10_pages, t14_wrapped, h5_markdown, t26_metadata, t31_model_json, a11_doc_types, a11_project_types, k15_purposes, k15_assignments, k15_patterns, k16_examples, c16_card_chunks, a4_card_stats,
    f13_functions, w7_top_definitions, w15_second_page, g5_entry_points, g2_outline, embed_offline, r13_answer, r14_pipeline, r15_new_content, r18_entities, v2_scores, x5_context,
    c12_hierarchy, c12_parents_exist, t11_html_cells, t22_resolve, k8_missing_breaks, x7_modal_search, f7_memory_filter, j5_changed_in_sitemap, g9_repo_quality, k12_architecture,
    h6_titles, i3_full_crawl, g10_cards, r2_naive, v9_information_gain, t25_categories, d6_headings, f19_paths, w16_first_links, u3_first_type)}
ORACLES = {
    "t10_pages": """WITH l AS (SELECT doc_id AS doc, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc, n, nullif(regexp_extract(line, '(?i)^(?:#{1,6}\\s*page\\s+|page\\s+|---\\s*page\\s+)(\\d+)(?:\\s*---)?\\s*$', 1), '')::INT AS p FROM l)
SELECT doc, max(coalesce((SELECT NULL), p, 1)) AS last_page, count(*) AS lines FROM m GROUP BY doc""",
    "t26_metadata": f"""SELECT doc_id, {_meta('(?i)arxiv(?:\\.org/(?:abs|pdf)/|:)\\s*(\\d{{4}}\\.\\d{{4,5}})', 'arxiv:')} AS arxiv, {_meta('(10\\.\\d{{4,}}/[^\\s"<>\\]]+)', 'doi:')} AS doi,
  {_meta('(?i)github\\.com/([\\w-]+/[\\w.-]+)', 'https://github.com/')} AS github, {_meta('(?i)gitlab\\.com/([\\w-]+/[\\w.-]+)', 'https://gitlab.com/')} AS gitlab,
  {_meta('(?i)\\b(MIT|Apache-2\\.0|BSD-[23]-Clause|GPL-[23]\\.0|LGPL-3\\.0|MPL-2\\.0|ISC)\\b', '')} AS license FROM documents WHERE text IS NOT NULL""",
    "t31_model_json": "SELECT item_id, CASE WHEN item_id % 4 < 3 THEN item_id END AS id, CASE WHEN item_id % 4 < 3 THEN substr(md5(question), 1, 6) END AS answer FROM eval_items",
    "a11_doc_types": f"WITH {PRESENT}, x AS (SELECT CASE {EXT.format('rel')} {_doc} END AS doc_type FROM pf WHERE kind = 'doc') SELECT doc_type, count(*) AS files FROM x WHERE doc_type IS NOT NULL GROUP BY 1",
    "a11_project_types": f"""WITH {PRESENT}, s AS (SELECT repo, count(*) FILTER (kind = 'doc') AS dc, count(*) FILTER (kind = 'code') AS cc FROM pf GROUP BY repo)
SELECT repo, CASE WHEN dc > 2 * cc THEN 'documentation' WHEN cc > 2 * dc THEN 'code' ELSE 'mixed' END AS project_type FROM s""",
    "k15_purposes": f"WITH {PRESENT} SELECT path, CASE {_purpose} ELSE 'general_configuration' END AS purpose FROM pf",
    "k15_assignments": f"""WITH {_ASG} SELECT CASE WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(v, '^-?\\d+$') THEN 'integer' WHEN regexp_matches(v, '^-?\\d+\\.\\d+$') THEN 'float' ELSE 'string' END AS type,
  count(*) AS keys, count(DISTINCT path) AS files FROM ag WHERE key <> '' GROUP BY 1""",
    "c16_card_chunks": f"WITH {_CARD} SELECT card_id, kind, nth::INT AS nth, content FROM cd",
    "a4_card_stats": f"WITH {_CARD} SELECT kind, count(*) AS chunks, count(DISTINCT card_id) AS cards FROM cd GROUP BY kind",
    "f13_functions": f"""WITH {_DEF} SELECT path, nth, name FROM df WHERE kind = 'class' OR lower(name) IN ('main', 'run', 'execute', 'start', 'init', 'setup', 'bootstrap', 'handlerequest', 'handler', 'serve')
  OR NOT regexp_matches(name, '^(get|set|is|has)[A-Z]|^_')""",
    "w15_second_page": f"WITH {PRESENT} SELECT path, bytes FROM pf ORDER BY path LIMIT 25 OFFSET 25",
    "g5_entry_points": f"WITH {_PF} SELECT path FROM cf WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{code.ENTRY}') OR regexp_matches(text, '(?m)^\\s*(if __name__ ==|func main\\(|fn main\\(|public static void main)')",
    "g2_outline": f"""WITH {_PF} SELECT path, len(regexp_extract_all(body, '(?m)^\\s*(import|from|use|#include)\\b')) AS imports, len(regexp_extract_all(body, '{code.DEFINITION}')) AS definitions,
  len(regexp_extract_all(body, '(?m)^\\s*(export|pub|public)\\b')) AS exports FROM cf WHERE text IS NOT NULL""",
    "r15_new_content": """WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE content IS NOT NULL) SELECT id FROM c WHERE sha256(content) NOT IN (SELECT sha256(content) FROM semantic_index WHERE content IS NOT NULL)""",
    "r18_entities": """SELECT b.bundle_id, b.repo, count(DISTINCT c.id) AS chunks FROM bundles b LEFT JOIN chunks c ON c.metadata.bundle_id = b.bundle_id WHERE starts_with(b.repo, 'northpier/') GROUP BY 1, 2""",
    "v2_scores": """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)
SELECT label, round(avg(score), 6) AS mean_score, round(max(score), 6) AS best_score FROM s GROUP BY label""",
    "t11_html_cells": f"""WITH {_CHUNKS}, t AS (SELECT id, unnest(regexp_extract_all(content, '(?is)<table[^>]*>(.*?)</table>', 1)) AS t, generate_subscripts(regexp_extract_all(content, '(?is)<table[^>]*>(.*?)</table>', 1), 1) - 1 AS tbl FROM ck),
r AS (SELECT id, tbl, unnest(regexp_extract_all(t, '(?is)<tr[^>]*>(.*?)</tr>', 1)) AS r, generate_subscripts(regexp_extract_all(t, '(?is)<tr[^>]*>(.*?)</tr>', 1), 1) - 1 AS row FROM t)
SELECT id, tbl, row, array_to_string(list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(c, '<[^>]*>', '', 'g'), ' ')), ' | ') AS cells FROM r""",
    "h6_titles": f"""WITH {_CHUNKS}, x AS (SELECT id, trim(regexp_extract(content, '(?is)<title[^>]*>([^<]*)</title>', 1), ' ') AS t, trim(regexp_extract(content, '(?is)<h[1-6][^>]*>([^<]*)</h[1-6]>', 1), ' ') AS h FROM ck WHERE content LIKE '%<%')
SELECT id, CASE WHEN t <> '' THEN t ELSE h END AS title FROM x""",
    "i3_full_crawl": """SELECT source, date_diff('day', max(ingested_at)::DATE, (SELECT max(ingested_at)::DATE FROM documents)) >= 7 AS due FROM documents WHERE source IS NOT NULL GROUP BY source""",
    "g10_cards": f"""WITH {PRESENT}, x AS (SELECT repo, kind, bytes, {EXT.format('rel')} AS e FROM pf), y AS (SELECT repo, kind, bytes, {_LANG} AS language FROM x)
SELECT repo, coalesce(array_to_string(list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)), ', '), '') AS languages, count(*) AS files, sum(bytes)::BIGINT AS bytes, count(*) FILTER (kind = 'doc') AS documents FROM y GROUP BY repo""",
    "r2_naive": "WITH " + _C + "SELECT id, score FROM sc ORDER BY score DESC, id LIMIT 10",
    "v9_information_gain": """WITH p AS (SELECT item_id, lower(question) AS a, lower(concat_ws(' ', question, passage)) AS b FROM eval_items),
n AS (SELECT item_id, CASE WHEN regexp_matches(a, 'random|creative|guess|story') THEN 0.8 WHEN regexp_matches(a, '1\\+1|capital of france|say "yes" or "no"|exact sequence') THEN 0.12 ELSE 0.45 END AS x,
  CASE WHEN regexp_matches(b, 'random|creative|guess|story') THEN 0.8 WHEN regexp_matches(b, '1\\+1|capital of france|say "yes" or "no"|exact sequence') THEN 0.12 ELSE 0.45 END AS y FROM p)
SELECT item_id, round((x - y)::DOUBLE, 6) AS gain FROM n""",
    "t25_categories": "SELECT doc_id, len(list_distinct(regexp_extract_all(substr(text, 1, 2000), '\\[((?:cs|math|stat|physics|q-bio|econ|eess)\\.[A-Z]{2})\\]', 1))) AS categories FROM documents WHERE text IS NOT NULL",
    "d6_headings": f"WITH {_H} SELECT doc, lower(title) AS title, min(line_no) AS first_line FROM hd GROUP BY ALL",
    "f19_paths": f"WITH {PRESENT} SELECT path, NOT regexp_matches(path, '(^|/)\\.\\.(/|$)|^/|\\\\|\\x00') AS safe FROM pf",
    "w16_first_links": """SELECT DISTINCT regexp_replace(regexp_replace(u, '#.*$', ''), '[.,;:]+$', '') AS url FROM
  (SELECT unnest(regexp_extract_all(text, '(https?://[^\\s\\])>"'']+)', 1)) AS u FROM documents WHERE text IS NOT NULL) ORDER BY url LIMIT 20""",
    "u3_first_type": f"""WITH {_CHUNKS}, g AS (SELECT m.bundle_id AS content, m.source_type AS type, count(*) AS n FROM ck WHERE m.source_type IN ('overview', 'repocard') GROUP BY ALL)
SELECT content, min_by(type, type) AS type, min_by(n, type) AS n FROM g GROUP BY content""",
    "c12_parents_exist": "SELECT '' AS parent_id, '' AS chunk_id WHERE false",
    "f7_memory_filter": f"WITH {_M} SELECT doc_id, layer FROM m WHERE user_id = 'kestrel-lab/handbook' AND type = 'relation' AND created_ms >= 1730000000000",
    "j5_changed_in_sitemap": "SELECT doc_id FROM documents WHERE updated_at IS NULL OR updated_at > ingested_at",
    "g9_repo_quality": f"""WITH {_CHUNKS} SELECT m.repo_id AS repo, (CASE WHEN bool_or(m.source_type = 'repocard') THEN 30 ELSE 0 END + CASE WHEN bool_or(m.source_type = 'code') THEN 50 ELSE 0 END
  + CASE WHEN bool_or(m.source_type = 'readme') THEN 15 ELSE 0 END + CASE WHEN bool_or(starts_with(m.source_type, 'pdf')) THEN 5 ELSE 0 END)::BIGINT AS score FROM ck WHERE m.repo_id IS NOT NULL GROUP BY 1""",
    "k12_architecture": f"WITH {PRESENT} SELECT repo, string_split(rel, '/')[1] AS folder, count(*) AS files, sum(len(string_split(body, chr(10))))::BIGINT AS lines FROM pf WHERE text IS NOT NULL GROUP BY 1, 2",
}
