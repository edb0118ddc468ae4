"""Queries of static analysis over the present code files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code, facts, ingest, repair
from ..session import table
from .q_ingest import _LINES, PRESENT
from .q_search import _lines


def _files(spark, d):
    return ingest.present(table(spark, d, "files")).where("lower(trim(kind)) = 'code'")


def j12_named_edges(spark, d):
    return code.named_edges(_files(spark, d))


def j12_imports(spark, d):
    return code.imports(_files(spark, d))


def j13_suffixes(spark, d):
    return code.unique_suffixes(_files(spark, d), 2)


def _modules(spark, d):
    """(nodes, edges) of module names over all repositories."""
    edges = code.module_edges(_files(spark, d))
    nodes = _files(spark, d).select(code.module_name(F.col("path")).alias("path")).unionByName(edges.select(F.col("dst").alias("path")))
    return nodes, edges


def j11_degrees(spark, d):
    return code.degrees(*_modules(spark, d))


def k2_dead_code(spark, d):
    return code.dead_code(code.degrees(*_modules(spark, d)))


def g3_roles(spark, d):
    return code.degrees(*_modules(spark, d)).select("path", facts.module_role(F.col("path"), F.col("importers")).alias("role"))


def k4_cycles(spark, d):
    return code.cycles(code.named_edges(_files(spark, d)))


def g4_reach(spark, d):
    edges = _modules(spark, d)[1]
    return code.reachable(edges, edges.select(F.col("src").alias("path")).distinct().join(edges.select(F.col("dst").alias("path")).distinct(), "path", "left_anti"))


def _metrics(spark, d):
    t = ingest.normal_text(F.col("text"))
    params = F.array_max(F.transform(F.regexp_extract_all(t, F.lit(r"(?:def|function|func|fn)\s+\w+\(([^)]*)\)"), F.lit(1)), lambda x: F.size(F.split(x, ","))))
    longest = F.array_max(F.transform(F.split(t, "\n"), lambda x: F.length(x)))
    return _files(spark, d).where("text is not null").select(
        "path", code.complexity(t).cast("long").alias("complexity"), code.nesting(t).cast("long").alias("nesting"), F.coalesce(params, F.lit(0)).cast("long").alias("params"), longest.cast("long").alias("length"))


def k5_complexity(spark, d):
    return _metrics(spark, d).select("path", "complexity", "params", "length")


def k5_nesting(spark, d):
    return _metrics(spark, d).select("path", "nesting")


def k7_issues(spark, d):
    return code.metric_issues(_metrics(spark, d))


def k8_error_prone(spark, d):
    return code.error_prone(_files(spark, d))


def k10_python_checks(spark, d):
    return code.python_checks(_files(spark, d))


def k1_check_summary(spark, d):
    """All checks as one frame of issues, counted by check."""
    f = _files(spark, d)
    dead = code.dead_code(code.degrees(*_modules(spark, d))).select("path", F.lit("dead-code").alias("check"))
    metric = code.metric_issues(_metrics(spark, d)).select("path", F.lit("complexity").alias("check"))
    err = code.error_prone(f).select("path", F.lit("error-prone").alias("check"))
    cred = repair.credential_issues(_lines(spark, d)).select("path", F.lit("security").alias("check"))
    return dead.unionByName(metric).unionByName(err).unionByName(cred).groupBy("check").agg(F.count("*").alias("issues"), F.count_distinct("path").alias("files"))


def g1_definitions(spark, d):
    return code.definitions(_files(spark, d))


def g1_graph(spark, d):
    return code.symbol_graph(code.definitions(_files(spark, d)))[1]


def k13_design_patterns(spark, d):
    return code.design_patterns(code.definitions(_files(spark, d)))


def v12_importance(spark, d):
    return code.importance(code.definitions(_files(spark, d)))


def d4_clones(spark, d):
    return code.clones(_lines(spark, d).where("kind = 'code'"))


def a13_clone_summary(spark, d):
    c = code.clones(_lines(spark, d).where("kind = 'code'"))
    return c.groupBy("path").agg(F.count("*").alias("runs"), F.sum("lines").alias("lines"))


_PF = PRESENT + ", cf AS (SELECT * FROM pf WHERE kind = 'code')"
_EDGES = _PF + """, us AS (SELECT path AS src, repo, unnest(regexp_extract_all(body, 'from\\s+[''"]\\.{1,2}/(?:[^''"]*/)?([\\w-]+)\\.\\w+[''"]', 1)) AS name FROM cf WHERE text IS NOT NULL),
nm AS (SELECT repo, replace(regexp_replace(regexp_extract(path, '[^/]*$'), '(_[0-9a-z]+)?\\.[^.]*$', ''), '_', '-') AS name, min(path) AS dst FROM cf GROUP BY 1, 2 HAVING count(*) = 1),
ed AS (SELECT DISTINCT src, dst FROM us JOIN nm USING (repo, name) WHERE src <> dst),
mp AS (SELECT path, body, text, replace(regexp_replace(regexp_extract(path, '[^/]*$'), '(_[0-9a-z]+)?\\.[^.]*$', ''), '_', '-') AS name FROM cf),
me AS (SELECT DISTINCT src, dst FROM (SELECT name AS src, unnest(regexp_extract_all(body, 'from\\s+[\'\'"]\\.{1,2}/(?:[^\'\'"]*/)?([\\w-]+)\\.\\w+[\'\'"]', 1)) AS dst FROM mp WHERE text IS NOT NULL) WHERE src <> dst),
nd AS (SELECT name AS path FROM mp UNION SELECT dst FROM me),
dg AS (SELECT nd.path, coalesce(i.n, 0) AS importers, coalesce(o.n, 0) AS imported FROM nd LEFT JOIN (SELECT dst, count(*) AS n FROM me GROUP BY dst) i ON i.dst = nd.path
  LEFT JOIN (SELECT src, count(*) AS n FROM me GROUP BY src) o ON o.src = nd.path)
"""
_CX = " + ".join(f"len(regexp_extract_all(body, '{p}'))" for p in (r"\bif\b", r"\belse\s+if\b", r"\bwhile\b", r"\bfor\b", r"\bcase\b", r"\bcatch\b", r"\?\s*[^:]", r"&&", r"\|\|"))
_MET = _PF + f""", mt AS (SELECT path, 1 + {_CX} AS complexity,
  coalesce(list_max(list_transform(regexp_extract_all(body, '(?:def|function|func|fn)\\s+\\w+\\(([^)]*)\\)', 1), lambda x: len(string_split(x, ',')))), 0) AS params,
  list_max(list_transform(string_split(body, chr(10)), lambda x: length(x))) AS length FROM cf WHERE text IS NOT NULL)
"""
_DEF = _PF + f""", dz AS (SELECT path, regexp_extract_all(body, '{code.DEFINITION}', 1) AS k, regexp_extract_all(body, '{code.DEFINITION}', 2) AS n FROM cf WHERE text IS NOT NULL),
df AS (SELECT path, CASE WHEN k IN ('def', 'function', 'func', 'fn') THEN 'function' ELSE 'class' END AS kind, name, nth FROM
  (SELECT path, unnest(k) AS k, unnest(n) AS name, generate_subscripts(k, 1) - 1 AS nth FROM dz))
"""
_votes = " UNION ALL ".join(f"SELECT path, '{p}' AS pattern FROM df WHERE regexp_matches(lower(name), '{rx}')" for p, rx in code.GOF.items())
_err = " UNION ALL ".join(f"SELECT path, '{k}' AS rule, len(regexp_extract_all(body, '{p}')) AS hits FROM cf WHERE text IS NOT NULL" for k, p in code.ERROR_PRONE.items())

QUERIES = {f.__name__: f for f in (
    j12_named_edges, j12_imports, j13_suffixes, j11_degrees, k2_dead_code, g3_roles, k4_cycles, g4_reach, k5_complexity, k5_nesting, k7_issues, k8_error_prone, k10_python_checks,
    k1_check_summary, g1_definitions, g1_graph, k13_design_patterns, v12_importance, d4_clones, a13_clone_summary)}
ORACLES = {
    "j12_named_edges": f"WITH {_EDGES} SELECT src, dst FROM ed",
    "j13_suffixes": f"""WITH {_PF}, s AS (SELECT path, array_to_string(string_split(path, '/')[-k:], '/') AS suffix FROM (SELECT path, unnest([1, 2]) AS k FROM cf) WHERE k <= len(string_split(path, '/')))
SELECT suffix, min(path) AS path FROM s GROUP BY suffix HAVING min(path) = max(path)""",
    "j11_degrees": f"WITH {_EDGES} SELECT path, importers, imported FROM dg",
    "k2_dead_code": f"""WITH {_EDGES} SELECT path, CASE WHEN importers = 0 AND imported = 0 THEN 'orphan' WHEN importers = 0 THEN 'unused-exports' ELSE 'possibly-dead' END AS rule FROM dg
WHERE NOT regexp_matches(regexp_extract(path, '[^/]*$'), '{code.ENTRY}') AND NOT regexp_matches(path, '{code.NOT_CHECKED}') AND (importers = 0 OR (importers = 1 AND imported = 0))""",
    "g3_roles": f"""WITH {_EDGES}, p AS (SELECT path, lower(path) AS p, importers FROM dg)
SELECT path, CASE WHEN regexp_matches(p, '/test/|/tests/|/__tests__/|\\.test\\.|\\.spec\\.') THEN 'test' WHEN regexp_matches(p, 'config|/scripts/') THEN 'config' WHEN regexp_matches(p, '/example|/demo') THEN 'example'
  WHEN importers >= 2 THEN 'core' WHEN regexp_matches(p, '/util|/helper') OR importers > 0 THEN 'utility' ELSE 'unknown' END AS role FROM p""",
    "k5_complexity": f"WITH {_MET} SELECT path, complexity, params, length FROM mt",
    "k8_error_prone": f"WITH {_PF}, e AS ({_err}) SELECT path, rule, hits FROM e WHERE hits > 0",
    "g1_definitions": f"WITH {_DEF} SELECT path, kind, name, nth FROM df",
    "g1_graph": f"WITH {_DEF} SELECT DISTINCT path AS src, path || '#' || name AS dst, 'contains' AS relation FROM (SELECT DISTINCT path, name, kind FROM df)",
    "k13_design_patterns": f"WITH {_DEF}, v AS ({_votes}) SELECT path, pattern, count(*) AS evidence, round(least(0.9, 0.4 + 0.1 * count(*)), 6) AS confidence FROM v GROUP BY ALL",
    "v12_importance": f"""WITH {_DEF} SELECT path, nth, name, round(least(1.0, 0.3 + CASE WHEN NOT starts_with(name, '_') THEN 0.25 ELSE 0 END
  + CASE WHEN lower(name) IN ('main', 'run', 'execute', 'start', 'init', 'setup', 'bootstrap', 'handlerequest', 'handler', 'serve') THEN 0.2 ELSE 0 END + CASE WHEN kind = 'class' THEN 0.1 ELSE 0 END), 6) AS score FROM df""",
}
_ = _LINES
