"""Static analysis as relations: imports, degrees, cycles, dead code, complexity, checks, names, patterns, documentation."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .ingest import basename, normal_text

RESOLVE_ENDS = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js", "/__init__.py")
MAX_CYCLE = 10
# Names of files at which a program starts, and file names that dead-code checks leave out (fixed values).
ENTRY = r"(?i)^(index|main|app|server|cli|lib)\."
NOT_CHECKED = r"(?i)\.d\.ts$|[._-](test|spec)\.|(^|/)(test|tests|__tests__)/|config"
THRESHOLDS = {"complexity": 15, "nesting": 5, "params": 6, "length": 100}


def imports(files: DataFrame) -> DataFrame:
    """(path, target): relative import specifiers as paths without an extension, resolved against the importing folder."""
    text = normal_text(F.col("text"))
    spec = F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:import|export)\s[^'\"\n]*from\s+['\"](\.[^'\"]+)['\"]|$^"), F.lit(1))).alias("spec")
    rows = files.where("text is not null").select("path", spec).where("spec <> ''")
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    up = (F.length("spec") - F.length(F.regexp_replace("spec", r"\.\./", ""))) / 3
    parts = F.split(folder, "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - up.cast("int"))), "/")
    rest = F.regexp_replace(F.regexp_replace("spec", r"^(\./|(\.\./)+)", ""), r"\.(js|ts|jsx|tsx|mjs)$", "")
    return rows.select("path", F.concat(base, F.lit("/"), rest).alias("target")).distinct()


def resolve(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): each target as the first existing candidate, in the order of endings; unresolved imports leave."""
    tries = F.posexplode(F.array(*[F.concat("target", F.lit(e)) for e in RESOLVE_ENDS])).alias("n", "dst")
    found = edges.select(F.col("path").alias("src"), "target", tries).join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    return found.groupBy("src", "target").agg(F.min_by("dst", "n").alias("dst")).select("src", "dst").where("src <> dst").distinct()


def unique_suffixes(files: DataFrame, depth: int = 4) -> DataFrame:
    """(suffix, path) of path suffixes that belong to one file only; ambiguous ones leave. At most ``depth`` rows per file."""
    parts = F.split("path", "/")
    n = F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(parts)))).alias("k")
    rows = files.select("path", parts.alias("parts"), n).select("path", F.array_join(F.slice("parts", -F.col("k"), F.col("k")), "/").alias("suffix"))
    return rows.groupBy("suffix").agg(F.min("path").alias("path"), F.max("path").alias("other")).where("path = other").select("suffix", "path")


def named_edges(files: DataFrame) -> DataFrame:
    """(src, dst) within a repository from the base names in relative imports, where a base name is unique in the repository.

    The form that works on collections whose folders were flattened.
    """
    spec = F.explode(F.regexp_extract_all(normal_text(F.col("text")), F.lit(r"from\s+['\"]\.{1,2}/(?:[^'\"]*/)?([\w-]+)\.\w+['\"]"), F.lit(1))).alias("name")
    uses = files.where("text is not null").select(F.col("path").alias("src"), "repo", spec)
    stem = F.translate(F.regexp_replace(basename(F.col("path")), r"(_[0-9a-z]+)?\.[^.]*$", ""), "_", "-")
    names = files.select("path", "repo", stem.alias("name")).groupBy("repo", "name").agg(F.min("path").alias("dst"), F.count("*").alias("n")).where("n = 1").drop("n")
    return uses.join(names, ["repo", "name"]).where("src <> dst").select("src", "dst").distinct()


def module_name(path: Column) -> Column:
    """The base name without its ending and a trailing serial part, words joined by hyphens."""
    return F.translate(F.regexp_replace(basename(path), r"(_[0-9a-z]+)?\.[^.]*$", ""), "_", "-")


def module_edges(files: DataFrame) -> DataFrame:
    """(src, dst) between module names over all repositories: who imports a module of that name."""
    spec = F.explode(F.regexp_extract_all(normal_text(F.col("text")), F.lit(r"from\s+['\"]\.{1,2}/(?:[^'\"]*/)?([\w-]+)\.\w+['\"]"), F.lit(1))).alias("dst")
    return files.where("text is not null").select(module_name(F.col("path")).alias("src"), spec).where("src <> dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, importers, imported) for every node."""
    inn = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("importers"))
    out = edges.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("imported"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("path").distinct().join(inn, "path", "left").join(out, "path", "left").select("path", zero("importers"), zero("imported"))


def dead_code(deg: DataFrame) -> DataFrame:
    """(path, rule): orphans (no importer, no import) and files with one importer and no import."""
    checked = ~basename(F.col("path")).rlike(ENTRY) & ~F.col("path").rlike(NOT_CHECKED)
    rule = F.when((F.col("importers") == 0) & (F.col("imported") == 0), "orphan").when((F.col("importers") == 0), "unused-exports").when(
        (F.col("importers") == 1) & (F.col("imported") == 0), "possibly-dead")
    return deg.where(checked).select("path", rule.alias("rule")).where("rule is not null")


def cycles(edges: DataFrame, longest: int = MAX_CYCLE) -> DataFrame:
    """(cycle, length): elementary cycles of at most ``longest`` edges, each once, from its smallest node.

    Paths grow only from a start over greater nodes, one keyed join per length; nodes that cannot be on a cycle are peeled
    off first (no way in or no way out), until nothing changes, so that the joins run over the cyclic core only.
    """
    core = checkpoint(edges.select("src", "dst").distinct())
    loops = core.where("src = dst").select(F.col("src").alias("cycle"), F.lit(1).alias("length"))
    core = core.where("src <> dst")
    size = core.count()
    while size:
        keep = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
            core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        core = checkpoint(keep.select("src", "dst"))
        now = core.count()
        if now == size:
            break
        size = now
    found = [loops]
    if size:
        paths = core.where("src < dst").select(F.col("src").alias("start"), F.array("src", "dst").alias("nodes"), F.col("dst").alias("tip"))
        for n in range(2, longest + 1):
            step = paths.join(core.select(F.col("src").alias("tip"), F.col("dst").alias("nxt")), "tip")
            found.append(step.where("nxt = start").select(F.array_join("nodes", " > ").alias("cycle"), F.lit(n).alias("length")))
            if n == longest:
                break
            paths = checkpoint(step.where((F.col("nxt") > F.col("start")) & ~F.array_contains("nodes", F.col("nxt"))).select(
                "start", F.concat("nodes", F.array("nxt")).alias("nodes"), F.col("nxt").alias("tip")))
            if paths.isEmpty():
                break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(path, distance) from a set of starts; breadth first, one join per level, until a level finds nothing new."""
    edges = checkpoint(edges.select("src", "dst"))
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = checkpoint(starts.select("path").distinct().withColumn("distance", F.lit(0)))
    frontier, k = seen, 0
    while True:
        k += 1
        nxt = frontier.join(edges.withColumnRenamed("src", "path"), "path").select(F.col("dst").alias("path")).distinct().join(seen, "path", "left_anti")
        frontier = checkpoint(nxt.withColumn("distance", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier).coalesce(most))  # else partitions grow with the levels
    return seen


def complexity(text: Column) -> Column:
    """1 + decision tokens; ``else if`` counts twice, as in the form this follows."""
    out = F.lit(1)
    for p in (r"\bif\b", r"\belse\s+if\b", r"\bwhile\b", r"\bfor\b", r"\bcase\b", r"\bcatch\b", r"\?\s*[^:]", r"&&", r"\|\|"):
        out = out + F.regexp_count(text, F.lit(p))
    return out


def nesting(text: Column) -> Column:
    """Greatest depth of round and curly brackets; a closing bracket never goes below zero."""
    marks = F.split(F.regexp_replace(text, r"[^{}()]", ""), "")
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(s: Column, c: Column) -> Column:
        d = F.when(c.isin("{", "("), s["d"] + 1).when(c.isin("}", ")"), F.greatest(F.lit(0), s["d"] - 1)).otherwise(s["d"])
        return F.struct(d.alias("d"), F.greatest(s["m"], d).alias("m"))

    return F.aggregate(marks, zero, step, lambda s: s["m"])


def metric_issues(metrics: DataFrame) -> DataFrame:
    """(path, rule, value, severity): values over their thresholds; twice as much (for nesting two more) is an error."""
    rows = metrics.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).cast("long").alias("value"), F.lit(v).alias("most")) for k, v in THRESHOLDS.items()])).alias("x")).select("path", "x.*")
    worse = F.when(F.col("rule") == "nesting", F.col("value") > F.col("most") + 2).otherwise(F.col("value") > 2 * F.col("most"))
    return rows.where("value > most").select("path", "rule", "value", F.when(worse, "error").otherwise("warning").alias("severity"))


ERROR_PRONE = {
    "empty-catch": r"(?s)catch\s*(\([^)]*\))?\s*\{\s*\}|except[^\n:]*:\s*\n\s*pass\b",
    "empty-if": r"(?s)\bif\s*\([^)]*\)\s*\{\s*\}|\bif [^\n:]+:\s*\n\s*pass\b",
    "return-in-finally": r"(?s)finally\s*\{[^}]*\breturn\b|finally:\s*\n\s*return\b",
}


def error_prone(files: DataFrame) -> DataFrame:
    """(path, rule, hits)."""
    t = normal_text(F.col("text"))
    rows = files.where("text is not null").select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_count(t, F.lit(p)).alias("hits")) for k, p in ERROR_PRONE.items()])).alias("x"))
    return rows.select("path", "x.rule", F.col("x.hits").cast("long").alias("hits")).where("hits > 0")


def missing_breaks(lines: DataFrame) -> DataFrame:
    """(path, line_no): case labels that are reached from a case with statements that does not leave; empty cases are meant.

    Over the lines of switch statements: the line before a label (comments and blanks aside) must end the case or be a label itself.
    """
    code_line = F.trim(F.regexp_replace("content", r"//.*$", ""))
    body = lines.withColumn("c", code_line).where("c <> ''")
    before = F.lag("c").over(Window.partitionBy("path").orderBy("line_no"))
    label = F.col("c").rlike(r"^(case\b.*|default\s*):")
    leaves = F.col("b").rlike(r"\b(break|return|throw|continue|goto|exit)\b|^\s*(case\b.*|default\s*):\s*$|switch\s*\(|\{\s*$")
    return body.withColumn("b", before).where(label & F.col("b").isNotNull() & ~leaves).select("path", "line_no")


DEFINITION = r"(?m)^\s*(?:export\s+)?(?:async\s+)?(?:pub\s+)?(?:public\s+|private\s+|static\s+|final\s+)*(class|interface|struct|def|function|func|fn)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"


def definitions(files: DataFrame) -> DataFrame:
    """(path, kind, name, nth) of named definitions; a narrow map."""
    t = normal_text(F.col("text"))
    kinds, names = F.regexp_extract_all(t, F.lit(DEFINITION), F.lit(1)), F.regexp_extract_all(t, F.lit(DEFINITION), F.lit(2))
    rows = files.where("text is not null").select("path", F.posexplode(F.arrays_zip(kinds.alias("k"), names.alias("n"))).alias("nth", "z"))
    kind = F.when(F.col("z.k").isin("def", "function", "func", "fn"), "function").otherwise("class")
    return rows.select("path", kind.alias("kind"), F.col("z.n").alias("name"), "nth")


# Pattern -> words in class or function names (fixed values).
GOF = {
    "singleton": "singleton", "factory": "factory|creator|builder|producer", "builder": "builder|assembler", "decorator": "decorator|wrapper|enhancer|interceptor",
    "adapter": "adapter|wrapper|bridge|translator|converter", "observer": "observer|listener|subscriber|publisher", "strategy": "strategy|policy|algorithm|comparator|validator|handler",
    "command": "command|action|task|operation", "template-method": "abstract|base|template|skeleton|framework", "chain-of-responsibility": "handler|chain|middleware|filter",
}


def design_patterns(defs: DataFrame) -> DataFrame:
    """(path, pattern, evidence, confidence): one row of evidence per matching name, summed and capped."""
    low = F.lower("name")
    votes = F.filter(F.array(*[F.when(low.rlike(rx), F.lit(p)) for p, rx in GOF.items()]), lambda x: x.isNotNull())
    rows = defs.select("path", F.explode(votes).alias("pattern"))
    return rows.groupBy("path", "pattern").agg(F.count("*").alias("evidence"), F.round(F.least(F.lit(0.9), 0.4 + 0.1 * F.count("*")), 6).alias("confidence")).where("confidence >= 0.5")


def pattern_evidence(defs: DataFrame, symbols: DataFrame, depth: int = 3) -> DataFrame:
    """(path, pattern, evidence, confidence): names of definitions (depth 1), names of methods (2) and of base classes (3), each piece of
    evidence adds its weight (0.3, 0.15, 0.25); what reaches 0.5 is a pattern, at most 0.95."""
    def votes(rows: DataFrame, name: str, weight: float) -> DataFrame:
        low = F.lower(F.col(name))
        found = F.filter(F.array(*[F.when(low.rlike(rx), F.lit(p)) for p, rx in GOF.items()]), lambda x: x.isNotNull())
        return rows.select("path", F.explode(found).alias("pattern"), F.lit(weight).alias("weight"))

    every = votes(defs, "name", 0.3)
    if depth > 1:
        every = every.unionByName(votes(symbols.where("kind = 'method'").select("path", "name"), "name", 0.15))
    if depth > 2:
        every = every.unionByName(votes(symbols.where("kind = 'class'").select("path", F.explode("bases").alias("base")), "base", 0.25))
    return every.groupBy("path", "pattern").agg(F.count("*").alias("evidence"), F.round(F.least(F.lit(0.95), F.sum("weight")), 6).alias("confidence")).where("confidence >= 0.5")


def importance(defs: DataFrame) -> DataFrame:
    """(path, name, score): 0.3, more for public names, entry points and classes, at most 1."""
    entry = F.lower("name").isin("main", "run", "execute", "start", "init", "setup", "bootstrap", "handlerequest", "handler", "serve")
    s = 0.3 + F.when(~F.col("name").startswith("_"), 0.25).otherwise(0.0) + F.when(entry, 0.2).otherwise(0.0) + F.when(F.col("kind") == "class", 0.1).otherwise(0.0)
    return defs.select("path", "nth", "name", F.round(F.least(F.lit(1.0), s), 6).alias("score"))


def symbol_graph(defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): keyed by file and name, so equal names of two files stay apart; files contain their definitions."""
    nodes = defs.select(F.concat_ws("#", "path", "name").alias("key"), "path", "name", "kind").distinct()
    return nodes, nodes.select(F.col("path").alias("src"), F.col("key").alias("dst"), F.lit("contains").alias("relation"))


def clones(lines: DataFrame, window: int = 6) -> DataFrame:
    """(path, first_line, lines, files): runs of ``window`` or more equal lines that other places hold as well.

    Windows of lines are hashed within each file; a hash that occurs twice or more marks its places (a count, not pairs);
    marked places that follow one another are one run, by gaps and islands.
    """
    body = lines.where(F.trim("content") != "")
    w = Window.partitionBy("path").orderBy("line_no")
    grams = body.select("path", "line_no", F.collect_list(F.trim("content")).over(w.rowsBetween(0, window - 1)).alias("g"), F.row_number().over(w).alias("n"))
    hashed = grams.where(F.size("g") == window).select("path", "line_no", "n", F.xxhash64(F.array_join("g", "\n")).alias("h"))
    often = hashed.groupBy("h").agg(F.count("*").alias("c"), F.count_distinct("path").alias("files")).where("c > 1")
    marked = hashed.join(often, "h")
    runs = marked.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy("path").orderBy("n")))
    return runs.groupBy("path", "run").agg(F.min("line_no").alias("first_line"), (F.count("*") + window - 1).alias("lines"), F.max("files").alias("files")).drop("run")


# -- Python documentation and unused names, by the standard library's parser ------------------------------------------------


def _python_issues(source: str) -> list[tuple[str, str, int]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        doc = ast.get_docstring(node) or ""
        args = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs) if a.arg not in ("self", "cls")]
        import re as _re

        documented = _re.findall(r"^\s*(?::param\s+(?:\w+\s+)?(\w+):|(\w+)\s*(?:\([^)]*\))?:\s)", doc, _re.M)
        documented = [a or b for a, b in documented if (a or b).lower() not in ("args", "returns", "raises", "yields", "note", "example")]
        if documented:
            out += [("param-missing", a, node.lineno) for a in args if a not in documented]
            out += [("param-extra", a, node.lineno) for a in documented if a not in args]
        returns = any(isinstance(x, ast.Return) and x.value is not None for x in ast.walk(node))
        if documented and returns and not _re.search(r":return|returns?:", doc, _re.I):
            out.append(("return-missing", node.name, node.lineno))
        used = {x.id for x in ast.walk(node) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)}
        out += [("unused-parameter", a, node.lineno) for a in args if a not in used and not a.startswith("_")]
        stored = {x.id for x in ast.walk(node) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
        out += [("unused-local", a, node.lineno) for a in sorted(stored - used) if not a.startswith("_")]
    return out


def python_checks(files: DataFrame) -> DataFrame:
    """(path, rule, name, line_no) over Python files; sources that do not parse have no rows."""
    rows = files.where(F.col("path").endswith(".py") & F.col("text").isNotNull()).select("path", normal_text(F.col("text")).alias("t"))

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for path, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for rule, name, line in _python_issues(t):
                    for c, v in zip(cols, (path, rule, name, line)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())],
                                             names=["path", "rule", "name", "line_no"])

    return rows.mapInArrow(run, "path string, rule string, name string, line_no int")
