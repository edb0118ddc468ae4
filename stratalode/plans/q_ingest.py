"""Queries over files: ingest, facts, structure, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import facts, ingest
from ..session import table

#: The present files in SQL, for oracles.
PRESENT = """pf AS (
  SELECT path, repo, lower(trim(kind)) AS kind, repo_relative_path AS rel, sha256, bytes, text, updated_at,
         replace(CASE WHEN ascii(text) = 65279 THEN substr(text, 2) ELSE text END, chr(13) || chr(10), chr(10)) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST, sha256 DESC NULLS LAST) AS rn
        FROM files WHERE path IS NOT NULL) WHERE rn = 1)"""
EXT = "lower(regexp_extract(regexp_extract({0}, '[^/]*$'), '.(\\.[^.]*)$', 1))"


def _present(spark, d):
    return ingest.present(table(spark, d, "files"))


def s1_kept_files(spark, d):
    f = _present(spark, d)
    return f.where(~ingest.is_ignored(F.col("repo_relative_path"))).select("path", "repo")


def s2_ingest_chain(spark, d):
    return ingest.ingest_chain(_present(spark, d))


def s3_file_kind(spark, d):
    return _present(spark, d).select("path", ingest.classify_kind(F.col("repo_relative_path")).alias("kind"))


def s19_parser(spark, d):
    return _present(spark, d).groupBy(ingest.parser_of(F.col("path")).alias("parser")).agg(F.count("*").alias("files"))


def s21_upsert(spark, d):
    """Last write wins over the window index, which was written twice for some ids."""
    t = table(spark, d, "semantic_index")
    return ingest.upsert(t.limit(0), t, "id", "created_at").select("id", "path", "start_line", "end_line", "created_at")


def s25_entropy(spark, d):
    e = V.byte_entropy(_present(spark, d), "path", "text")
    return e.select(F.col("id").alias("path"), "bytes", F.round("entropy", 6).alias("entropy"), ingest.choose_codec(F.col("bytes"), F.col("entropy")).alias("codec"))


def s27_line_range(spark, d):
    """Lines 3 to 12 of every file."""
    return ingest.lines(_present(spark, d)).where("line_no between 3 and 12").select("path", "line_no", "content")


def f1_scope(spark, d):
    return ingest.lines(_present(spark, d)).where("kind = 'doc'").groupBy("repo").agg(F.count("*").alias("lines"))


def f2_extension(spark, d):
    f = _present(spark, d)
    return f.where(ingest.extension(F.col("path")).isin(".py", ".ts")).select("path", "bytes")


def f3_exclude_glob(spark, d):
    from ..operators.search import glob_regex

    return _present(spark, d).where(~F.col("path").rlike(glob_regex("**/tools/*"))).select("path")


def f12_should_index(spark, d):
    return _present(spark, d).select("path", ingest.should_index(F.col("path"), F.col("bytes")).alias("indexed"))


def j2_removed_files(spark, d):
    meta = table(spark, d, "file_meta").where("path is not null").select("path").distinct()
    return meta.join(table(spark, d, "files").select("path"), "path", "left_anti")


def j3_file_changes(spark, d):
    return ingest.file_changes(table(spark, d, "files"), table(spark, d, "file_meta"))


def a5_change_totals(spark, d):
    return ingest.file_changes(table(spark, d, "files"), table(spark, d, "file_meta")).groupBy("change").agg(F.count("*").alias("files"))


def a9_languages(spark, d):
    return facts.languages(_present(spark, d))


def a10_structure(spark, d):
    return facts.structure(_present(spark, d))


def a12_tree(spark, d):
    return facts.tree(_present(spark, d))


def a16_repo_types(spark, d):
    return facts.classify_repos(_present(spark, d))


def a20_tags(spark, d):
    return facts.tags(_present(spark, d))


def k14_architectures(spark, d):
    return facts.architectures(_present(spark, d))


def v16_module_complexity(spark, d):
    f = _present(spark, d).where("lower(trim(kind)) = 'code' and text is not null")
    loc = facts.lines_of_code(F.col("text"))
    imports = F.regexp_count(ingest.normal_text(F.col("text")), F.lit(r"(?m)^(import|use|from) "))
    return f.select("path", loc.cast("long").alias("loc"), imports.cast("long").alias("imports"), facts.complexity_bucket(loc, imports).alias("complexity"))


def t36_parse_quality(spark, d):
    c = table(spark, d, "chunks").dropDuplicates(["id"])
    out = facts.parse_quality(c, "id", F.col("content"))
    return out.withColumn("hyphenation_ratio", F.round("hyphenation_ratio", 6)).withColumn("garbled_ratio", F.round("garbled_ratio", 6))


def a15_chunk_quality(spark, d):
    return facts.chunk_quality(table(spark, d, "chunks"))


def v15_bundle_scores(spark, d):
    q = facts.chunk_quality(table(spark, d, "chunks"))
    issues = (F.col("orphans") > 0).cast("int") + (F.col("invalid_parents") > 0).cast("int") + (F.col("polluted") > 0).cast("int")
    return q.select("bundle_id", facts.pdf_score(F.lit(0), F.col("orphans"), F.col("invalid_parents"), issues).cast("long").alias("score"))


def c13_levels(spark, d):
    c = table(spark, d, "chunks").dropDuplicates(["id"])
    return c.groupBy(facts.collection_level(F.col("metadata")).alias("level")).agg(F.count("*").alias("chunks"))


def x1_lines(spark, d):
    """The line index: lines that are not blank, with their original numbers."""
    return ingest.lines(_present(spark, d)).where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "").select("path", "kind", "line_no", "content")


_LANG = "CASE WHEN kind = 'code' THEN CASE e {} ELSE 'Other' END WHEN kind = 'doc' THEN CASE e {} END END".format(
    " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in facts.CODE_LANGUAGES.items()), " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in facts.DOC_LANGUAGES.items()))
_LINES = PRESENT + """, ln AS (
  SELECT path, repo, kind, unnest(string_split(body, chr(10))) AS content, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM pf WHERE body IS NOT NULL)"""
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_DIRS = "|".join(x.replace(".", "\\.") for x in ingest.IGNORED_DIRS)
_CHUNKS = "ck AS (SELECT id, any_value(content) AS content, any_value(metadata) AS m FROM chunks GROUP BY id)"
_CHANGES = f"""WITH {PRESENT}, st AS (
  SELECT path, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, run_id DESC NULLS LAST, sha256 DESC NULLS LAST) AS rn
    FROM file_meta WHERE path IS NOT NULL) WHERE rn = 1),
ch AS (SELECT coalesce(p.path, s.path) AS path, CASE WHEN p.path IS NULL THEN 'removed' WHEN s.path IS NULL THEN 'new'
  WHEN p.sha256 IS NOT DISTINCT FROM s.sha256 THEN 'unchanged' ELSE 'changed' END AS change FROM pf p FULL JOIN st s ON p.path = s.path)
"""
_QA = f"""WITH {_CHUNKS}, q AS (
  SELECT m.bundle_id AS bundle_id, count(*) AS chunks,
    count(*) FILTER (m.granularity = 'element' AND m.parent_chunk_id IS NULL) AS orphans,
    count(*) FILTER (m.parent_chunk_id IS NOT NULL AND m.parent_chunk_id NOT IN (SELECT id FROM ck)) AS invalid_parents,
    count(*) FILTER (coalesce(trim(content, ' '), '') = '') AS blank, count(*) FILTER (contains(content, chr(65533))) AS polluted
  FROM ck GROUP BY 1)
"""

QUERIES = {f.__name__: f for f in (
    s1_kept_files, s2_ingest_chain, s3_file_kind, s19_parser, s21_upsert, s25_entropy, s27_line_range, f1_scope, f2_extension, f3_exclude_glob,
    f12_should_index, j2_removed_files, j3_file_changes, a5_change_totals, a9_languages, a10_structure, a12_tree, a16_repo_types, a20_tags,
    k14_architectures, v16_module_complexity, t36_parse_quality, a15_chunk_quality, v15_bundle_scores, c13_levels, x1_lines)}

_tags = " UNION ALL ".join(f"SELECT repo, '{t}' AS tag FROM pf WHERE regexp_matches(lower(rel), '{rx}')" for t, rx in facts.TAG_PATTERNS.items())
_arch_rows = " UNION ALL ".join(
    f"SELECT repo, '{a}' AS pattern, '{layer}' AS layer FROM pf WHERE regexp_matches(lower('/' || rel), '{rx}')"
    for a, (ls, *_) in facts.ARCHITECTURES.items() for layer, rx in ls.items())
_arch_keep = " OR ".join(
    f"(pattern = '{a}' AND " + (f"layers >= {need})" if len(ls) > 1 else "n >= 2)") for a, (ls, need, *_) in facts.ARCHITECTURES.items())
_arch_conf = " ".join(
    f"WHEN '{a}' THEN least({cap}, {base} + {step} * {'layers' if len(ls) > 1 else 'n'})" for a, (ls, need, base, step, cap) in facts.ARCHITECTURES.items())

ORACLES = {
    "s1_kept_files": f"WITH {PRESENT} SELECT path, repo FROM pf WHERE NOT regexp_matches(rel, '(^|/)({_DIRS})/')",
    "s2_ingest_chain": f"""WITH {PRESENT}, o AS (
  SELECT path, repo, coalesce(bytes, 0) AS b, CASE WHEN text IS NULL THEN 'unreadable' WHEN coalesce(bytes, 0) > 524288 THEN 'size'
    WHEN contains(substr(text, 1, 8192), chr(0)) THEN 'binary' END AS own FROM pf),
r AS (SELECT *, sum(CASE WHEN own IS NULL THEN b ELSE 0 END) OVER (PARTITION BY repo ORDER BY path ROWS UNBOUNDED PRECEDING)::BIGINT AS running_bytes FROM o)
SELECT path, repo, coalesce(own, CASE WHEN running_bytes > 52428800 THEN 'total' ELSE 'kept' END) AS reason, running_bytes FROM r""",
    "s3_file_kind": f"""WITH {PRESENT}, x AS (SELECT path, rel, lower(regexp_extract(rel, '[^/]*$')) AS b, {EXT.format('rel')} AS e FROM pf)
SELECT path, CASE WHEN b IN ({_IN(ingest.DOC_NAMES)}) OR starts_with(b, 'readme.') OR starts_with(b, 'license.') OR contains(rel, '/docs/')
  OR contains(rel, '/doc/') OR e IN ({_IN(ingest.DOC_ENDS)}) THEN 'doc' ELSE 'code' END AS kind FROM x""",
    "s19_parser": f"""WITH {PRESENT} SELECT CASE WHEN e IN ('.md', '.markdown', '.mdx') THEN 'markdown' WHEN e IN ('.html', '.htm', '.xhtml') THEN 'html'
  WHEN e = '.pdf' THEN 'pdf' WHEN e IN ('.docx', '.pptx', '.xlsx', '.doc', '.ppt', '.xls', '.odt') THEN 'office'
  WHEN e IN ('.txt', '.rst', '.adoc', '.log', '.csv') THEN 'text' ELSE 'code' END AS parser, count(*) AS files
FROM (SELECT {EXT.format('path')} AS e FROM pf) GROUP BY 1""",
    "s21_upsert": """SELECT id, path, start_line, end_line, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) AS rn
FROM semantic_index WHERE id IS NOT NULL) WHERE rn = 1""",
    "s25_entropy": f"""WITH {PRESENT}, h AS (SELECT path, octet_length(encode(text)) AS bytes, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM pf WHERE text IS NOT NULL),
c AS (SELECT path, bytes, b, count(*) AS n FROM h GROUP BY ALL),
e AS (SELECT path, bytes, -sum(n / bytes * log2(n / bytes)) AS entropy FROM c GROUP BY ALL),
z AS (SELECT * FROM e UNION ALL SELECT path, 0, 0.0 FROM pf WHERE text = '')
SELECT path, bytes, round(entropy, 6) AS entropy, CASE WHEN bytes < 1024 THEN 'none' WHEN entropy < 3 THEN 'br' WHEN entropy < 6 THEN 'gzip' ELSE 'none' END AS codec FROM z""",
    "s27_line_range": f"WITH {_LINES} SELECT path, line_no, content FROM ln WHERE line_no BETWEEN 3 AND 12",
    "f1_scope": f"WITH {_LINES} SELECT repo, count(*) AS lines FROM ln WHERE kind = 'doc' GROUP BY repo",
    "f2_extension": f"WITH {PRESENT} SELECT path, bytes FROM pf WHERE {EXT.format('path')} IN ('.py', '.ts')",
    "f3_exclude_glob": f"WITH {PRESENT} SELECT path FROM pf WHERE NOT regexp_matches(path, '(?i).*/tools/[^/]*')",
    "f12_should_index": f"""WITH {PRESENT} SELECT path, NOT (len(list_intersect(string_split(path, '/'), [{_IN(ingest.SKIPPED_DIRS)}])) > 0
  OR regexp_extract(path, '[^/]*$') IN ({_IN(ingest.LOCK_FILES)}) OR coalesce(bytes, 0) > 102400
  OR {' OR '.join(f"regexp_matches(path, '{p}')" for p in (*ingest.TEST_FILES, *ingest.GENERATED_FILES))}) AS indexed FROM pf""",
    "j2_removed_files": "SELECT DISTINCT path FROM file_meta WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM files WHERE path IS NOT NULL)",
    "j3_file_changes": _CHANGES + "SELECT path, change FROM ch",
    "a5_change_totals": _CHANGES + "SELECT change, count(*) AS files FROM ch GROUP BY change",
    "a9_languages": f"""WITH {PRESENT}, x AS (SELECT kind, {EXT.format('rel')} AS e FROM pf), y AS (SELECT {_LANG} AS language, e FROM x)
SELECT language, count(*) AS file_count, array_to_string(list_sort(list(DISTINCT e)), ',') AS extensions FROM y WHERE language IS NOT NULL GROUP BY language""",
    "a10_structure": f"""WITH {PRESENT} SELECT repo, count(*) AS total_files, sum((kind = 'doc')::INT)::BIGINT AS doc_files, sum((kind = 'code')::INT)::BIGINT AS code_files,
  count(DISTINCT CASE WHEN contains(rel, '/') THEN string_split(rel, '/')[1] END) AS top_dirs,
  bool_or(regexp_matches(lower(rel), '(^|/)(test|tests|__tests__|spec)/|\\.(test|spec)\\.')) AS has_tests,
  bool_or(regexp_matches(lower(rel), '(^|/)(package\\.json|tsconfig\\.json|pyproject\\.toml|setup\\.py|cargo\\.toml|go\\.mod|pom\\.xml|makefile|dockerfile)$|config')) AS has_config
FROM pf GROUP BY repo""",
    "a12_tree": f"""WITH {PRESENT}, p AS (SELECT repo, bytes, string_split(rel, '/') AS s FROM pf), l AS (SELECT repo, bytes, s, unnest(range(1, len(s))) AS depth FROM p)
SELECT repo, array_to_string(s[1:depth], '/') AS folder, depth, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM l GROUP BY ALL""",
    "a16_repo_types": f"""WITH {PRESENT}, x AS (SELECT repo, lower(regexp_extract(rel, '[^/]*$')) AS b, {EXT.format('rel')} AS e FROM pf),
g AS (SELECT repo, count(*) AS n, count(*) FILTER (e IN ({_IN(facts.CODE_LANGUAGES)})) AS code,
  count(*) FILTER (e IN ('.json', '.csv', '.tsv', '.parquet', '.yaml', '.yml', '.xml')) AS data, count(*) FILTER (e IN ('.md', '.mdx', '.rst', '.adoc', '.txt')) AS md,
  bool_or(regexp_matches(b, '^(index|main|app|server|cli|lib)\\.')) AS entry, bool_or(b = 'skill.md') AS skills FROM x GROUP BY repo)
SELECT repo, round(code / n, 6) AS code_ratio, CASE WHEN skills OR contains(lower(repo), 'awesome') OR (NOT entry AND data + md > code AND data > 0) THEN 'documentation'
  WHEN code / n >= 0.3 THEN 'code' WHEN code / n < 0.1 THEN 'documentation' ELSE 'hybrid' END AS repo_type FROM g""",
    "a20_tags": f"WITH {PRESENT}, v AS ({_tags}) SELECT repo, tag, count(*) AS files FROM v GROUP BY ALL",
    "k14_architectures": f"""WITH {PRESENT}, v AS ({_arch_rows}), g AS (SELECT repo, pattern, count(DISTINCT layer) AS layers, count(*) AS n FROM v GROUP BY ALL)
SELECT repo, pattern, layers, round(CASE pattern {_arch_conf} END, 6) AS confidence FROM g WHERE {_arch_keep}""",
    "v16_module_complexity": f"""WITH {PRESENT}, x AS (SELECT path, len(list_filter(string_split(body, chr(10)), lambda l: trim(l, ' ') <> '' AND NOT starts_with(trim(l, ' '), '//'))) AS loc,
  len(regexp_extract_all(body, '(?m)^(import|use|from) ')) AS imports FROM pf WHERE kind = 'code' AND text IS NOT NULL)
SELECT path, loc, imports, CASE WHEN loc / 100 + imports / 5 < 2 THEN 'low' WHEN loc / 100 + imports / 5 < 5 THEN 'medium' ELSE 'high' END AS complexity FROM x""",
    "t36_parse_quality": f"""WITH {_CHUNKS}, x AS (SELECT id, content AS t, length(content) AS n, len(regexp_extract_all(content, '(?i)page\\s+\\d+')) AS p,
  len(regexp_extract_all(content, '\\w+-\\n\\w+')) / len(regexp_split_to_array(content, '\\s+')) AS h,
  CASE WHEN length(content) > 0 THEN (length(content) - length(regexp_replace(content, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFD}}]', '', 'g'))) / length(content) ELSE 0 END AS g FROM ck WHERE content IS NOT NULL)
SELECT id, CASE WHEN p > 0 THEN p ELSE ceil(n / 3000)::BIGINT END AS page_count, round(h, 6) AS hyphenation_ratio, round(g, 6) AS garbled_ratio,
  (len(regexp_extract_all(t, '\\|.*\\|.*\\|')) // 2)::BIGINT AS tables, len(regexp_extract_all(t, '!\\[[^\\]]*\\]\\([^)]*\\)')) AS figures,
  len(regexp_extract_all(t, '\\$\\$[^$]*\\$\\$')) AS formulas, (h > 0.05)::INT + (g > 0.01)::INT AS issues FROM x""",
    "a15_chunk_quality": _QA + "SELECT * FROM q",
    "v15_bundle_scores": _QA + """, s AS (SELECT *, (orphans > 0)::INT + (invalid_parents > 0)::INT + (polluted > 0)::INT AS i FROM q)
SELECT bundle_id, (30 + 30 + CASE WHEN i = 0 THEN 40 ELSE greatest(0, 40 - least(20, orphans * 5) - CASE WHEN invalid_parents > 0 THEN 10 ELSE 0 END - i * 5) END)::BIGINT AS score FROM s""",
    "c13_levels": f"""WITH {_CHUNKS}, x AS (SELECT m.source_type AS st, m.granularity AS g, m.heading_level AS l,
  lower(trim(regexp_replace(m.section_heading, '^\\d+\\.?\\s*', ''), ' ')) AS s FROM ck)
SELECT CASE WHEN st = 'overview' THEN 'l1_doc' WHEN st = 'repocard' THEN 'l1_repo'
  WHEN st = 'pdf_text' AND g = 'section' AND l = 1 AND s IN ('abstract', 'introduction', 'summary', 'overview') THEN 'l1_pdf'
  WHEN g = 'section' OR (st = 'pdf_text' AND l > 0 AND l <= 2) THEN 'l2_section' WHEN st = 'code' THEN 'l2_section' ELSE 'l3_chunk' END AS level, count(*) AS chunks
FROM x GROUP BY 1""",
    "x1_lines": f"WITH {_LINES} SELECT path, kind, line_no, content FROM ln WHERE regexp_matches(content, '\\S')",
}
