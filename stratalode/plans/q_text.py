"""Queries of text and URL functions over documents, chunks and evaluation items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import repair
from ..session import table
from .q_ingest import _CHUNKS, _LINES, PRESENT
from .q_search import _lines


def _chunks(spark, d):
    return table(spark, d, "chunks").dropDuplicates(["id"])


def _url_col():
    """A web address of each document, with the dirt that addresses have."""
    i = F.col("doc_id")
    source = F.coalesce(F.regexp_replace(F.col("source"), "[^a-z0-9-]+", "."), F.lit("localhost"))
    scheme = F.when(i % 5 == 0, "HTTP").when(i % 11 == 0, "ftp").otherwise("https")
    host = F.when(i % 13 == 0, F.concat(F.lit("10.0."), (i % 200).cast("string"), F.lit(".7"))).otherwise(F.concat(F.lit("WWW."), source, F.lit(".example")))
    port = F.when(i % 5 == 0, ":80").when(i % 7 == 0, ":8443").otherwise("")
    user = F.when(i % 17 == 0, "user:pw@").otherwise("")
    tail = F.when(i % 3 == 0, "/").when(i % 4 == 0, "?q=1&lang=en#top").otherwise("")
    return F.concat(scheme, F.lit("://"), user, host, port, F.lit("/docs/page-"), i.cast("string"), tail)


def _urls(spark, d):
    return table(spark, d, "documents").select("doc_id", _url_col().alias("url"))


def t1_query_tokens(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.array_join(T.query_tokens(F.col("question")), " ").alias("tokens"))


def t3_terms(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.terms(F.col("text"))).alias("terms"), F.size(F.array_distinct(T.terms(F.col("text")))).alias("distinct_terms"))


def t5_normalise(spark, d):
    return table(spark, d, "documents").where("doc_kind = 'memory'").select("doc_id", T.normalise_memory(F.col("text")).alias("normal"))


def t7_chunk_ids(spark, d):
    m = F.col("metadata")
    return _chunks(spark, d).select("id", F.concat(F.lit("chunk_"), F.substring(F.sha2("content", 256), 1, 8), F.lit("_"), m["chunk_index"].cast("string")).alias("computed"))


def t8_fingerprints(spark, d):
    b = table(spark, d, "bundles")
    text = F.concat_ws("|", F.lower(F.trim("repo")), F.lower(F.trim("kind")), F.array_join(T.normalise_list(F.col("tags")), ","))
    return b.select("bundle_id", F.sha2(text, 256).alias("fingerprint"))


def d2_input_dedup(spark, d):
    """Bundles of equal inputs: the newest of each fingerprint."""
    b = table(spark, d, "bundles")
    key = F.sha2(F.concat_ws("|", F.lower(F.trim("kind")), F.array_join(T.normalise_list(F.col("tags")), ",")), 256)
    return b.select(key.alias("fingerprint"), "bundle_id", "updated_at").groupBy("fingerprint").agg(
        F.max_by("bundle_id", F.struct(F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp_ntz")), F.col("bundle_id"))).alias("bundle_id"), F.count("*").alias("bundles"))


def t9_lists(spark, d):
    return table(spark, d, "bundles").select("bundle_id", F.array_join(T.normalise_list(F.col("tags")), ",").alias("tags"))


def t12_dehyphenate(spark, d):
    return _chunks(spark, d).where("metadata.source_type = 'pdf_text'").select("id", T.dehyphenate(F.col("content")).alias("text"))


def t13_repeated_lines(spark, d):
    m = F.col("metadata")
    pages = _chunks(spark, d).where((m["source_type"] == "pdf_text") & m["paper_id"].isNotNull() & F.col("content").isNotNull()).select(
        m["paper_id"].alias("paper"), F.col("id").alias("page"), F.col("content").alias("text"))
    return repair.repeated_lines(pages)


def t15_clean_markdown(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(T.clean_markdown(F.col("text")), 256).alias("hash"))


def t16_strip_tags(spark, d):
    return _chunks(spark, d).where("content like '%</%'").select("id", T.strip_tags(F.col("content")).alias("text"))


def t17_embedding_text(spark, d):
    return _chunks(spark, d).where("content is not null").select("id", F.length(T.embedding_text(F.col("content"))).alias("chars"), T.token_estimate(F.col("content")).alias("tokens"))


def t18_completeness(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(T.is_complete(F.col("text")).alias("complete")).agg(F.count("*").alias("documents"))


def t19_technical(spark, d):
    return table(spark, d, "eval_items").select("item_id", T.is_technical(F.col("question")).alias("technical"))


def t20_normalise_url(spark, d):
    return _urls(spark, d).select("doc_id", U.normalise(F.col("url")).alias("url"))


def t21_file_names(spark, d):
    return _urls(spark, d).select("doc_id", U.file_name(F.col("url")).alias("name"))


def t22_origin(spark, d):
    return _urls(spark, d).groupBy(U.origin(F.col("url")).alias("origin")).agg(F.count("*").alias("urls"))


def f14_url_filter(spark, d):
    return _urls(spark, d).where(U.included(F.col("url"), ["/docs/"], ["q=1"])).select("doc_id")


def f15_safe_urls(spark, d):
    return _urls(spark, d).select("doc_id", U.is_safe(F.col("url")).alias("safe"))


def f16_content_gates(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "text/plain", "application/pdf", "image/png", "application/json")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").groupBy(U.content_gate(kind).alias("gate")).agg(F.count("*").alias("documents"))


def s8_app_pages(spark, d):
    return _chunks(spark, d).where("content is not null").groupBy(U.looks_like_app(F.col("content")).alias("app")).agg(F.count("*").alias("chunks"))


def t23_paper_ids(spark, d):
    m = F.col("metadata")
    return _chunks(spark, d).where(m["paper_id"].isNotNull()).select("id", U.paper_id(m["paper_id"]).alias("paper"))


def t24_same_paper(spark, d):
    m = F.col("metadata")
    return _chunks(spark, d).where(m["paper_id"].isNotNull()).groupBy(U.same_paper(m["paper_id"], F.concat(m["paper_id"], F.lit("v2"))).alias("same")).agg(F.count("*").alias("chunks"))


def t27_titles(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", repair.title_of(F.col("text"), F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".md"))).alias("title"))


def t27_summaries(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", repair.summary_of(F.col("text")).alias("summary"))


def t28_column_types(spark, d):
    return repair.column_types(repair.pipe_cells(_chunks(spark, d), "id", F.col("content")))


def t29_text_tables(spark, d):
    return repair.text_tables(table(spark, d, "documents").where("text is not null"), "doc_id", F.col("text"))


def t30_equations(spark, d):
    m = F.col("metadata")
    return _chunks(spark, d).where(m["chunk_type"] == "formula").select("id", repair.equation_format(F.col("content")).alias("format"))


def t32_similar_words(spark, d):
    return table(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.bool_or(T.similar_words(F.lower("lang"), F.lit("en"))).alias("like_en"))


def t33_credentials(spark, d):
    return repair.credential_issues(_lines(spark, d))


def k9_weak_random(spark, d):
    return repair.random_issues(_lines(spark, d))


def t34_truncate(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(T.truncate_at_newline(F.col("text"), 500)).alias("chars"))


def f8_secrets(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(T.has_secret(F.col("text")).alias("secret")).agg(F.count("*").alias("documents"))


def _html(spark, d):
    return _chunks(spark, d).where("content like '%<%'")


def h1_links(spark, d):
    links = F.regexp_extract_all("content", F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"'>]+)[\"']"), F.lit(1))
    return _html(spark, d).select("id", F.explode(F.array_distinct(F.filter(links, lambda x: ~x.rlike(r"(?i)^(javascript:|mailto:|tel:|#)")))).alias("link"))


def h2_headings(spark, d):
    rows = _html(spark, d).select("id", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?i)<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1))).alias("pos", "heading"))
    return rows.select("id", "pos", F.trim("heading").alias("heading")).where("heading <> ''")


def h3_code_blocks(spark, d):
    rows = _html(spark, d).select("id", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?i)<pre[^>]*><code[^>]*>([^<]*)</code></pre>"), F.lit(1))).alias("pos", "code"))
    return rows.where(F.length("code") >= 10)


def h7_content_hash(spark, d):
    return _chunks(spark, d).where("content is not null").select("id", F.sha2("content", 256).alias("hash"), (F.sha2("content", 256) == F.col("metadata.content_hash")).alias("agrees"))


_URL_SQL = """u AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'HTTP' WHEN doc_id % 11 = 0 THEN 'ftp' ELSE 'https' END || '://' ||
  CASE WHEN doc_id % 17 = 0 THEN 'user:pw@' ELSE '' END ||
  CASE WHEN doc_id % 13 = 0 THEN '10.0.' || (doc_id % 200) || '.7' ELSE 'WWW.' || coalesce(regexp_replace(source, '[^a-z0-9-]+', '.', 'g'), 'localhost') || '.example' END ||
  CASE WHEN doc_id % 5 = 0 THEN ':80' WHEN doc_id % 7 = 0 THEN ':8443' ELSE '' END || '/docs/page-' || doc_id ||
  CASE WHEN doc_id % 3 = 0 THEN '/' WHEN doc_id % 4 = 0 THEN '?q=1&lang=en#top' ELSE '' END AS url FROM documents),
r AS (SELECT doc_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::(\\d+))?([^?#]*)(\\?[^#]*)?(#.*)?$',
  ['scheme', 'usr', 'host', 'port', 'path', 'query', 'frag']) AS p FROM u),
o AS (SELECT *, lower(p.scheme) || '://' || lower(p.host) || CASE WHEN p.port = '' OR (lower(p.scheme) = 'http' AND p.port = '80') OR (lower(p.scheme) = 'https' AND p.port = '443')
  THEN '' ELSE ':' || p.port END AS origin FROM r)"""
_e = lambda p: p.replace("'", "''")
_KEEP = "|".join(T.DEHYPHENATE_KEEP)
_PRIVATE = " OR ".join(f"regexp_matches(lower(p.host), '{x}')" for x in (*U.PRIVATE, *U.INTERNAL))
_WS = "' ' || chr(9) || chr(10) || chr(13)"
_PAPER = """CASE WHEN regexp_extract(t, '(?i)arxiv(?:\\.org/(?:abs|pdf)/|[:\\s]+)(\\d{4}\\.\\d{4,5}(?:v\\d+)?)', 1) <> '' THEN 'arxiv:' || regexp_extract(t, '(?i)arxiv(?:\\.org/(?:abs|pdf)/|[:\\s]+)(\\d{4}\\.\\d{4,5}(?:v\\d+)?)', 1)
  WHEN regexp_extract(t, '(?i)arxiv(?:\\.org/(?:abs|pdf)/|[:\\s]+)([a-z-]+(?:\\.[A-Z]{2})?/\\d{7}(?:v\\d+)?)', 1) <> '' THEN 'arxiv:' || regexp_extract(t, '(?i)arxiv(?:\\.org/(?:abs|pdf)/|[:\\s]+)([a-z-]+(?:\\.[A-Z]{2})?/\\d{7}(?:v\\d+)?)', 1)
  WHEN regexp_extract(t, '\\b(10\\.\\d{4,9}/[^\\s"<>]+)', 1) <> '' THEN 'doi:' || regexp_replace(regexp_extract(t, '\\b(10\\.\\d{4,9}/[^\\s"<>]+)', 1), '[.,;)]+$', '') END"""
_CRED = f"""WITH {_LINES}, a AS (SELECT path, line_no, content, regexp_extract(content, '([A-Za-z_][\\w.-]*)["'']?\\s*[:=]+\\s*["'']([^"'']+)["'']', 1) AS name,
  regexp_extract(content, '([A-Za-z_][\\w.-]*)["'']?\\s*[:=]+\\s*["'']([^"'']+)["'']', 2) AS v FROM ln),
sup AS (SELECT path, unnest([line_no, line_no + 1]) AS line_no FROM ln WHERE regexp_matches(content, '(?i)[a-z]+-ignore\b|nosec|eslint-disable'))
"""

QUERIES = {f.__name__: f for f in (
    t1_query_tokens, t3_terms, t5_normalise, t7_chunk_ids, t8_fingerprints, d2_input_dedup, t9_lists, t12_dehyphenate, t13_repeated_lines, t15_clean_markdown,
    t16_strip_tags, t17_embedding_text, t18_completeness, t19_technical, t20_normalise_url, t21_file_names, t22_origin, f14_url_filter, f15_safe_urls,
    f16_content_gates, s8_app_pages, t23_paper_ids, t24_same_paper, t27_titles, t27_summaries, t28_column_types, t29_text_tables, t30_equations, t32_similar_words,
    t33_credentials, k9_weak_random, t34_truncate, f8_secrets, h1_links, h2_headings, h3_code_blocks, h7_content_hash)}
ORACLES = {
    "t1_query_tokens": "SELECT item_id, array_to_string(regexp_extract_all(question, '[\\p{L}\\p{N}_./-]{2,}')[1:12], ' ') AS tokens FROM eval_items",
    "t3_terms": """WITH x AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) > 1) AS ts FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(ts) AS terms, len(list_distinct(ts)) AS distinct_terms FROM x""",
    "t5_normalise": f"SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text, {_WS})), '\\s+', ' ', 'g'), '[^a-z0-9\\x{{4e00}}-\\x{{9fa5}} ]', '', 'g') AS normal FROM documents WHERE doc_kind = 'memory'",
    "t7_chunk_ids": f"WITH {_CHUNKS} SELECT id, 'chunk_' || substr(sha256(content), 1, 8) || '_' || m.chunk_index AS computed FROM ck",
    "t8_fingerprints": """SELECT bundle_id, sha256(concat_ws('|', lower(trim(repo, ' ')), lower(trim(kind, ' ')),
  array_to_string(list_sort(list_filter(list_transform(tags, lambda x: lower(trim(x, ' '))), lambda x: x <> '')), ','))) AS fingerprint FROM bundles""",
    "d2_input_dedup": """WITH x AS (SELECT bundle_id, updated_at, sha256(concat_ws('|', lower(trim(kind, ' ')),
  array_to_string(list_sort(list_filter(list_transform(tags, lambda x: lower(trim(x, ' '))), lambda x: x <> '')), ','))) AS fingerprint FROM bundles)
SELECT fingerprint, max_by(bundle_id, (coalesce(updated_at, TIMESTAMP '1970-01-01'), bundle_id)) AS bundle_id, count(*) AS bundles FROM x GROUP BY fingerprint""",
    "t9_lists": "SELECT bundle_id, array_to_string(list_sort(list_filter(list_transform(tags, lambda x: lower(trim(x, ' '))), lambda x: x <> '')), ',') AS tags FROM bundles",
    "t12_dehyphenate": f"""WITH {_CHUNKS} SELECT id, replace(regexp_replace(regexp_replace(content, '(\\b[a-zA-Z]+)-\\n((?:{_KEEP})\\b)', '\\1-' || chr(1) || '\\2', 'g'),
  '(\\b[a-zA-Z]+)-\\n([a-z]+\\b)', '\\1\\2', 'g'), chr(1), chr(10)) AS text FROM ck WHERE m.source_type = 'pdf_text'""",
    "t13_repeated_lines": f"""WITH {_CHUNKS}, p AS (SELECT m.paper_id AS paper, id AS page, content FROM ck WHERE m.source_type = 'pdf_text' AND m.paper_id IS NOT NULL AND content IS NOT NULL),
l AS (SELECT paper, page, unnest(string_split(content, chr(10))) AS line FROM p),
k AS (SELECT DISTINCT paper, page, trim(regexp_replace(regexp_replace(lower(line), '\\d+', '#', 'g'), '[ \\t]+', ' ', 'g'), ' ') AS key FROM l
  WHERE trim(line, ' ') <> '' AND NOT regexp_matches(lower(line), '{repair.PAGE_NUMBER}')),
c AS (SELECT paper, key, count(*) AS pages FROM k WHERE length(key) BETWEEN 4 AND 160 GROUP BY ALL), n AS (SELECT paper, count(*) AS n FROM p GROUP BY paper)
SELECT paper, key, pages FROM c JOIN n USING (paper) WHERE n >= 2 AND pages >= greatest(2, ceil(n * 0.6))""",
    "t15_clean_markdown": f"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'),
  {_WS} || chr(11) || chr(12))) AS hash FROM documents WHERE text IS NOT NULL""",
    "t16_strip_tags": f"""WITH {_CHUNKS}, s AS (SELECT id, regexp_replace(regexp_replace(content, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM ck WHERE content LIKE '%</%')
SELECT id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS text FROM s""",
    "t17_embedding_text": f"WITH {_CHUNKS} SELECT id, length(trim(regexp_replace(content, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')) AS chars, ceil(length(content) / 4)::BIGINT AS tokens FROM ck WHERE content IS NOT NULL",
    "t18_completeness": """SELECT NOT (regexp_matches(text, '(?i)\\bsee above\\b|\\bas mentioned\\b|\\bcontinued from\\b|\\bsee below\\b')
  OR (regexp_matches(text, '(?i)\\bthe following\\b') AND NOT regexp_matches(text, '\\n-'))) AS complete, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "t19_technical": """SELECT item_id, regexp_matches(question, '\\b[A-Z]{2,}|\\b[A-Z][a-z]+[A-Z]') OR regexp_matches(question, '(?i)[=+\\-*/^()]|Eq\\.\\d|accuracy|precision|recall|F1|loss')
  OR regexp_matches(question, '(?i)\\b(highest|best|top|maximum|minimum)\\s+\\w*\\s*(accuracy|score|performance)') AS technical FROM eval_items""",
    "t20_normalise_url": f"WITH {_URL_SQL} SELECT doc_id, origin || CASE WHEN p.path IN ('', '/') THEN '/' ELSE regexp_replace(p.path, '/$', '') END || p.query AS url FROM o",
    "t21_file_names": f"""WITH {_URL_SQL}, n AS (SELECT *, regexp_replace(trim(p.path, '/'), '[^A-Za-z0-9._-]+', '_', 'g') AS n FROM o)
SELECT doc_id, CASE WHEN n = '' THEN 'index' WHEN length(n) > 50 THEN substr(n, 1, 50) || '_' || substr(sha256(url), 1, 8) ELSE n END ||
  CASE WHEN p.query = '' THEN '' ELSE '_' || substr(sha256(p.query), 1, 8) END || '.md' AS name FROM n""",
    "t22_origin": f"WITH {_URL_SQL} SELECT origin, count(*) AS urls FROM o GROUP BY origin",
    "f14_url_filter": f"WITH {_URL_SQL} SELECT doc_id FROM o WHERE contains(p.path || p.query, '/docs/') AND NOT contains(p.path || p.query, 'q=1')",
    "f15_safe_urls": f"WITH {_URL_SQL} SELECT doc_id, NOT (lower(p.host) IN ('localhost', '127.0.0.1', '::1') OR p.usr <> '' OR lower(p.scheme) NOT IN ('http', 'https') OR {_PRIVATE}) AS safe FROM o",
    "f16_content_gates": """SELECT ['html', 'text', 'skip', 'skip', 'other'][doc_id % 5 + 1] AS gate, count(*) AS documents FROM documents GROUP BY 1""",
    "s8_app_pages": f"""WITH {_CHUNKS} SELECT regexp_matches(lower(content), '<div id="root"></div>|<div id="app"></div>|<div id="__nuxt">|<app-root>|<body></body>|enable javascript|javascript is required|javascript must be enabled') AS app,
  count(*) AS chunks FROM ck WHERE content IS NOT NULL GROUP BY 1""",
    "t23_paper_ids": f"WITH {_CHUNKS}, x AS (SELECT id, m.paper_id AS t FROM ck WHERE m.paper_id IS NOT NULL) SELECT id, {_PAPER} AS paper FROM x",
    "t24_same_paper": f"""WITH {_CHUNKS}, x AS (SELECT lower(m.paper_id) AS a, lower(m.paper_id || 'v2') AS b FROM ck WHERE m.paper_id IS NOT NULL)
SELECT regexp_replace(a, '^(arxiv:.*?)v\\d+$', '\\1') = regexp_replace(b, '^(arxiv:.*?)v\\d+$', '\\1') AS same, count(*) AS chunks FROM x GROUP BY 1""",
    "t27_titles": """WITH x AS (SELECT doc_id, trim(regexp_extract(text, '(?m)^[ \\t]*#[ \\t]+(\\S.*)$', 1), ' ') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN t <> '' THEN substr(t, 1, 100) ELSE 'doc ' || doc_id END AS title FROM x""",
    "t28_column_types": f"""WITH {_CHUNKS}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS row FROM ck),
t AS (SELECT id, row, string_split(regexp_replace(regexp_replace(line, '^\\s*\\|', ''), '\\|\\s*$', ''), '|') AS c FROM l WHERE regexp_matches(line, '^\\s*\\|.*\\|\\s*$') AND NOT regexp_matches(line, '^[\\s|:-]+$')),
v AS (SELECT id, row, unnest(range(0, len(c))) AS col, trim(unnest(c), ' ') AS v, min(row) OVER (PARTITION BY id) AS head FROM t),
y AS (SELECT id, col, CASE WHEN v = '' THEN NULL WHEN lower(v) IN ('true', 'false', 'yes', 'no', '1', '0') THEN 'boolean'
  WHEN regexp_matches(v, '^-?\\d+(\\.\\d+)?$|^-?\\d{{1,3}}(,\\d{{3}})*(\\.\\d+)?$') THEN 'number' WHEN regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}|^\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}') THEN 'date' ELSE 'string' END AS ty
  FROM v WHERE row > head)
SELECT id, col, CASE WHEN count(DISTINCT ty) = 0 THEN 'string' WHEN count(DISTINCT ty) = 1 THEN min(ty) ELSE 'mixed' END AS type FROM y GROUP BY id, col""",
    "t29_text_tables": """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, CASE WHEN trim(line, ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(line, ' '), '\\t+| {2,}')) END AS cols FROM l),
r AS (SELECT *, sum((cols < 2)::INT) OVER (PARTITION BY id ORDER BY row ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT id, min(row) AS first_row, count(*) AS rows, max(cols) AS cols FROM r WHERE cols >= 2 GROUP BY id, run HAVING count(*) >= 2""",
    "t30_equations": f"""WITH {_CHUNKS} SELECT id, CASE WHEN contains(content, '<math') OR contains(content, '<mrow') THEN 'mathml' WHEN regexp_matches(content, '[\\\\{{^_]') THEN 'latex' ELSE 'text' END AS format
FROM ck WHERE m.chunk_type = 'formula'""",
    "t32_similar_words": "SELECT lang, bool_or(levenshtein(lower(lang), 'en') <= 2 AND levenshtein(lower(lang), 'en') <= greatest(length(lang), 2) * 0.3) AS like_en FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "t33_credentials": _CRED + f"""SELECT a.path, a.line_no, name FROM a ANTI JOIN sup ON sup.path = a.path AND sup.line_no = a.line_no
WHERE name <> '' AND regexp_matches(name, '{_e(repair.CREDENTIAL_NAME)}') AND length(v) >= 8 AND NOT ({' OR '.join(f"regexp_matches(v, '{_e(p)}')" for p in repair.PLACEHOLDERS)})
  AND regexp_matches(v, '[a-z]')::INT + regexp_matches(v, '[A-Z]')::INT + regexp_matches(v, '[0-9]')::INT + regexp_matches(v, '[^a-zA-Z0-9]')::INT >= 2""",
    "k9_weak_random": _CRED + """SELECT a.path, a.line_no FROM a ANTI JOIN sup ON sup.path = a.path AND sup.line_no = a.line_no
WHERE contains(content, 'Math.random()') OR (regexp_matches(content, 'new Random\\(|random\\w*\\.next[A-Z]') AND NOT contains(lower(content), 'secure'))""",
    "t34_truncate": """WITH x AS (SELECT doc_id, length(text) AS n, substr(text, 1, 500) AS h FROM documents WHERE text IS NOT NULL),
y AS (SELECT *, CASE WHEN contains(h, chr(10)) THEN length(h) - strpos(reverse(h), chr(10)) ELSE -1 END AS last FROM x)
SELECT doc_id, CASE WHEN n <= 500 THEN n WHEN last > 400 THEN last ELSE length(h) END AS chars FROM y""",
    "f8_secrets": f"SELECT {' OR '.join(f'regexp_matches(text, {chr(39)}{p}{chr(39)})' for p in T._SECRETS)} AS secret, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "h1_links": f"""WITH {_CHUNKS} SELECT DISTINCT id, link FROM (SELECT id, unnest(regexp_extract_all(content, '(?i)<a\\s[^>]*href=["'']([^"''>]+)["'']', 1)) AS link FROM ck WHERE content LIKE '%<%')
WHERE NOT regexp_matches(link, '(?i)^(javascript:|mailto:|tel:|#)')""",
    "h2_headings": f"""WITH {_CHUNKS}, h AS (SELECT id, regexp_extract_all(content, '(?i)<h[1-6][^>]*>([^<]*)</h[1-6]>', 1) AS hs FROM ck WHERE content LIKE '%<%')
SELECT id, pos, heading FROM (SELECT id, generate_subscripts(hs, 1) - 1 AS pos, trim(unnest(hs), ' ') AS heading FROM h) WHERE heading <> ''""",
    "h3_code_blocks": f"""WITH {_CHUNKS}, h AS (SELECT id, regexp_extract_all(content, '(?i)<pre[^>]*><code[^>]*>([^<]*)</code></pre>', 1) AS hs FROM ck WHERE content LIKE '%<%')
SELECT id, pos, code FROM (SELECT id, generate_subscripts(hs, 1) - 1 AS pos, unnest(hs) AS code FROM h) WHERE length(code) >= 10""",
    "h7_content_hash": f"WITH {_CHUNKS} SELECT id, sha256(content) AS hash, sha256(content) = m.content_hash AS agrees FROM ck WHERE content IS NOT NULL",
}
_ = PRESENT
