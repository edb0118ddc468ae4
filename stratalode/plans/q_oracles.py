"""SQL for queries of other families whose plans are folds or several steps: written from the definition, not from the plan."""

from __future__ import annotations

from .q_code import _EDGES, _MET, _PF
from .q_ingest import _LINES
from .q_search import _bm, _Q, search
from .q_wider import ORACLES as _WIDER

QUERIES: dict = {}

_NEST = _WIDER["k5_nesting"].split("SELECT path, coalesce(CASE")[1].split("AS nesting FROM s")[0]
_METRICS = f"""{_MET}, ns AS (SELECT path, string_split(regexp_replace(body, '[^{{}}()]', '', 'g'), '') AS marks FROM cf WHERE text IS NOT NULL),
ne AS (SELECT path, coalesce(CASE{_NEST} AS nesting FROM ns),
al AS (SELECT path, 'complexity' AS rule, complexity AS value, 15 AS most FROM mt UNION ALL SELECT path, 'nesting', nesting, 5 FROM ne UNION ALL SELECT path, 'params', params, 6 FROM mt UNION ALL SELECT path, 'length', length, 100 FROM mt)"""
# a run of equal lines: windows of six filled lines that stand at two places or more
_CLONES = f"""{_LINES}, b AS (SELECT path, line_no, trim(content, ' ') AS t, row_number() OVER (PARTITION BY path ORDER BY line_no) AS n FROM ln WHERE kind = 'code' AND trim(content, ' ') <> ''),
g AS (SELECT path, line_no, n, list(t) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS w FROM b),
h AS (SELECT path, line_no, n, array_to_string(w, chr(10)) AS w FROM g WHERE len(w) = 6), o AS (SELECT w, count(DISTINCT path) AS files FROM h GROUP BY w HAVING count(*) > 1),
m AS (SELECT path, line_no, n, files, n - row_number() OVER (PARTITION BY path ORDER BY n) AS run FROM h JOIN o USING (w)),
cl AS (SELECT path, min(line_no) AS first_line, count(*) + 5 AS lines, max(files) AS files FROM m GROUP BY path, run)"""
_esc = lambda p: p.replace("'", "''")

ORACLES = {
    "k7_issues": f"""WITH {_METRICS} SELECT path, rule, value, CASE WHEN CASE WHEN rule = 'nesting' THEN value > most + 2 ELSE value > 2 * most END THEN 'error' ELSE 'warning' END AS severity FROM al WHERE value > most""",
    "d4_clones": f"WITH {_CLONES} SELECT path, first_line, lines, files FROM cl",
    "a13_clone_summary": f"WITH {_CLONES} SELECT path, count(*) AS runs, sum(lines) AS lines FROM cl GROUP BY path",
    "k4_cycles": f"""WITH RECURSIVE {_EDGES}, p(start, nodes, tip, closed) AS (SELECT src, [src], src, FALSE FROM (SELECT DISTINCT src FROM ed)
UNION ALL SELECT p.start, CASE WHEN ed.dst = p.start THEN p.nodes ELSE list_append(p.nodes, ed.dst) END, ed.dst, ed.dst = p.start FROM p JOIN ed ON ed.src = p.tip
WHERE NOT p.closed AND len(p.nodes) <= 10 AND (ed.dst = p.start OR (ed.dst > p.start AND NOT list_contains(p.nodes, ed.dst))))
SELECT DISTINCT array_to_string(nodes, ' > ') AS cycle, len(nodes) AS length FROM p WHERE closed AND len(nodes) <= 10""",
    "k8_missing_breaks": f"""WITH {_LINES}, c AS (SELECT path, line_no, trim(regexp_replace(content, '//.*$', ''), ' ') AS c FROM ln WHERE kind = 'code'),
b AS (SELECT path, line_no, c, lag(c) OVER (PARTITION BY path ORDER BY line_no) AS b FROM c WHERE c <> '')
SELECT path, line_no FROM b WHERE regexp_matches(c, '^(case\\b.*|default\\s*):') AND b IS NOT NULL
  AND NOT regexp_matches(b, '\\b(break|return|throw|continue|goto|exit)\\b|^\\s*(case\\b.*|default\\s*):\\s*$|switch\\s*\\(|\\{{\\s*$')""",
    "j12_imports": f"""WITH {_PF}, s AS (SELECT path, unnest(regexp_extract_all(body, '(?m)^\\s*(?:import|export)\\s[^''"\\n]*from\\s+[''"](\\.[^''"]+)[''"]', 1)) AS spec FROM cf WHERE text IS NOT NULL),
z AS (SELECT *, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS parts, (length(spec) - length(replace(spec, '../', ''))) // 3 AS up FROM s)
SELECT DISTINCT path, array_to_string(parts[1:greatest(0, len(parts) - up)], '/') || '/' || regexp_replace(regexp_replace(spec, '^(\\./|(\\.\\./)+)', ''), '\\.(js|ts|jsx|tsx|mjs)$', '') AS target FROM z""",
    "x7_modal_search": _bm(search.query_terms("stale cache pointer")).replace(f"WITH {_LINES},", """WITH ck AS (SELECT id, any_value(content) AS content, any_value(metadata) AS m FROM chunks GROUP BY id),
ln AS (SELECT id AS path, 1 AS line_no, content FROM ck WHERE m.chunk_type IN ('table', 'formula', 'figure')),""") + "SELECT path, line_no, score FROM hits",
    "x5_context": _bm(_Q, "kind = 'code'").rstrip() + f""", e AS (SELECT path, line_no, last_value(nullif(regexp_extract(content, '{_esc(search._FUNCTION)}', 1), '') IGNORE NULLS) OVER
  (PARTITION BY path ORDER BY line_no ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) AS function FROM ln WHERE kind = 'code')
SELECT path, function, count(*) AS hits, min(line_no) AS first_line FROM e WHERE (path, line_no) IN (SELECT path, line_no FROM hits) GROUP BY path, function""",
    "t27_summaries": """WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(trim(x, ' '), '^(#|!\\[|\\[!\\[|<!--|```|---$)')
  AND NOT regexp_matches(trim(x, ' '), '^\\[.*\\)$')) AS ls FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, trim(ls[1], ' ') AS f FROM l)
SELECT doc_id, substr(CASE WHEN regexp_extract(f, '^[^.!?]+[.!?]') <> '' THEN regexp_extract(f, '^[^.!?]+[.!?]') ELSE f END, 1, 200) AS summary FROM f""",
    "k16_examples": """WITH b AS (SELECT 'doc_' || doc_id AS path, unnest(regexp_extract_all(text, '(?s)```[\\w+-]*\\n(.*?)\\n```', 1)) AS code FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, CASE WHEN regexp_matches(code, '\\bassert|expect\\(') THEN 'assertion' WHEN regexp_matches(code, '(?i)\\b(config|settings|options)\\b') THEN 'configuration'
  WHEN regexp_matches(code, '=\\s*(new\\s+)?[A-Z]\\w*\\(') THEN 'instantiation' WHEN regexp_matches(code, '\\.\\w+\\(') THEN 'method_call' ELSE 'workflow' END AS category FROM b
  WHERE length(code) >= 20 AND NOT regexp_matches(code, 'TRIVIAL'))
SELECT category, substr(md5(code), 1, 8) AS hash, round(least(1.0, 0.1 * any_value(len(string_split(code, chr(10)))) + 0.05 * (any_value(length(code) - length(replace(code, ',', ''))) + 1)), 6) AS complexity FROM c GROUP BY category, code""",
    "embed_offline": "SELECT item_id::VARCHAR AS id, 64 AS dims FROM eval_items",
}
from ..operators.documents import TRIVIAL as _TRIVIAL  # noqa: E402

ORACLES["k16_examples"] = ORACLES["k16_examples"].replace("TRIVIAL", _esc(_TRIVIAL))

from ..functions import vector as _V  # noqa: E402
from .q_retrieval import _C, QUESTION as _QUESTION  # noqa: E402


def _ngrams(source: str) -> str:
    """CTEs up to ``nv`` (id, idx, weight) of the rows (id, t) of ``source``; CRC-32 by its table, from the polynomial."""
    sizes = ", ".join(f"({n}, {w}::DOUBLE)" for n, w in _V.WEIGHTS.items())
    return f"""tb AS MATERIALIZED (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
it AS (SELECT id, lower(t) AS t FROM ({source}) WHERE length(t) >= 3), gr AS (SELECT id, w, unnest(list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n))) AS g FROM it, (VALUES {sizes}) s(n, w)),
dg AS (SELECT g, list_transform(range(1, octet_length(encode(g)) + 1), lambda i: ('0x' || substr(hex(encode(g)), 2 * i - 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT g FROM gr)),
cr AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % {_V.DIMENSIONS} AS idx FROM dg, tb),
sm AS (SELECT id, idx, ln(1 + sum(w)) AS v FROM gr JOIN cr USING (g) GROUP BY id, idx), nv AS (SELECT id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS weight FROM sm)"""


_ITEMS = "SELECT item_id AS id, question AS t FROM eval_items"
_ASK = "'" + _QUESTION.replace("'", "''") + "'"
ORACLES |= {
    "v3_ngrams": f"WITH {_ngrams(_ITEMS)} SELECT id, idx, round(weight, 6) AS weight FROM nv",
    "v4_ngram_scores": f"""WITH {_ngrams(_ITEMS + f" UNION ALL SELECT -1, {_ASK}")}, q AS (SELECT idx, weight AS qw FROM nv WHERE id = -1)
SELECT id, round(sum(weight * coalesce(qw, 0)), 6) AS sparse FROM nv LEFT JOIN q USING (idx) WHERE id <> -1 GROUP BY id""",
    "r5_hybrid": f"""WITH {_C.rstrip()}, ca AS (SELECT id, content, score AS dense FROM sc WHERE content IS NOT NULL ORDER BY score DESC, id LIMIT 40), {_ngrams(f"SELECT id, content AS t FROM ca UNION ALL SELECT '', {_ASK}")},
qv AS (SELECT idx, weight AS qw FROM nv WHERE id = ''), sp AS (SELECT id, sum(weight * coalesce(qw, 0)) AS s FROM nv LEFT JOIN qv USING (idx) WHERE id <> '' GROUP BY id)
SELECT id, dense, round(coalesce(s, 0), 6) AS sparse, round(dense * {_V.DENSE_SHARE} + coalesce(s, 0) * (1 - {_V.DENSE_SHARE}), 6) AS score FROM ca LEFT JOIN sp USING (id) ORDER BY score DESC, id LIMIT 20""",
}

from .q_code import ORACLES as _CODE  # noqa: E402
from .q_text import ORACLES as _TEXT  # noqa: E402

_PARTS = (("dead-code", _CODE["k2_dead_code"]), ("complexity", ORACLES["k7_issues"]), ("error-prone", _CODE["k8_error_prone"]), ("security", _TEXT["t33_credentials"]))
ORACLES["k1_check_summary"] = " UNION ALL ".join(f"SELECT '{name}' AS check, count(*) AS issues, count(DISTINCT path) AS files FROM ({sql}) HAVING count(*) > 0" for name, sql in _PARTS)
