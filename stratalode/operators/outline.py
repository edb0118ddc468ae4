"""What a parser would tell, from layout: definitions with their parents and extents, complexity, parameters, documentation.

Blocks are read from indentation, which the languages at hand share: a definition ends before the next line that stands no deeper,
closing brackets aside. One fold over the lines of a file (a narrow map in Arrow batches) gives the symbols; everything else is
relational over them. Files that are not indented as usual give wrong extents, never failures.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import normal_text

_CLASS = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:(?:public|private|protected|abstract|final|static|sealed|pub)\s+)*(?:class|interface|struct|trait|enum)\s+([A-Za-z_]\w*)(.*)")
_FUNCTION = (
    re.compile(r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("),
    re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\("),
    re.compile(r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\("), re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*(?:<[^>]*>)?\("),
    re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"),
    re.compile(r"^\s+(?:(?:public|private|protected|static|final|async|abstract|synchronized|override|readonly)\s+)*(?:[\w<>\[\],.?]+\s+)?([A-Za-z_$][\w$]*)\s*\([^;]*\)\s*(?::\s*[^{;]+|throws\s+[\w, .]+)?\{\s*$"),
)
_WORDS_NO_NAMES = frozenset("if for while switch catch return else do try with new throw await yield match loop unless elif except super this constructor_".split())
_BASES = re.compile(r"\(([^)]*)\)|extends\s+([\w., <>]+?)(?:\s+implements\s+([\w., <>]+))?\s*\{?\s*$|implements\s+([\w., <>]+)|:\s*(?:public\s+)?([\w., <>]+)\s*\{")
_FLOW = re.compile(r"\b(if|elif|else\s+if|else|for|foreach|while|switch|match|case|catch|except|loop)\b")
_NESTS = frozenset("if for foreach while switch match catch except loop".split())
_LOGIC = re.compile(r"&&|\|\||\band\b|\bor\b")
_STRINGS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`")
_COMMENT = re.compile(r"\s*(?:#(?!include|!\[|\[)|//|\*|/\*)")
_CLOSES = re.compile(r"^\s*[)}\]]+[;,)]*\s*$|^\s*[)}\]]")


def _indent(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())


def _parameters(text: str) -> list[str]:
    """Names between the first bracket and its partner; types, defaults and receivers left out."""
    start = text.find("(")
    depth, end = 0, len(text)
    for i in range(start, len(text)):
        depth += (text[i] in "([{<") - (text[i] in ")]}" or text[i] == ">" and text[i - 1] not in "=-")
        if depth == 0:
            end = i
            break
    parts, depth, held = [], 0, ""
    for c in text[start + 1 : end]:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            parts.append(held)
            held = ""
        else:
            held += c
    names = []
    for p in [*parts, held]:
        p = re.sub(r"=.*", "", p, flags=re.S).strip().lstrip("*&.")
        if not p or p[0] in "{[/":
            continue
        head = p.split(":")[0].strip().rstrip("?") if ":" in p else p
        words = re.findall(r"[A-Za-z_$][\w$]*", head)
        if words:
            typed = ":" not in p and len(words) > 1 and re.match(r"^(?:final\s+)?[A-Z\w<>\[\], .?]+\s+[a-z_]\w*$", head)
            names.append(words[-1] if typed or ":" in p else words[0])
    return [n for n in names if n not in ("self", "cls", "this")]


def cognitive(body: list[str], name: str) -> int:
    """One for each break of the flow, more the deeper it stands; one for each run of like logical operators; one for recursion."""
    total, stack = 0, []
    recursion = False
    for raw in body:
        if not raw.strip() or _COMMENT.match(raw):
            continue
        line = _STRINGS.sub("''", raw)
        line = re.sub(r"//.*|(?<!\S)#.*", "", line)
        depth = _indent(raw)
        flows = [" ".join(m[1].split()) for m in _FLOW.finditer(line)]
        goes_on = bool(flows) and flows[0] in ("else", "elif", "else if", "catch", "except") and bool(re.match(r"\s*[}\s]*(?:else|elif|catch|except)\b", line))
        while stack and (stack[-1] > depth or stack[-1] == depth):
            stack.pop()
        for k, f in enumerate(flows):
            if f in ("else", "elif", "else if"):
                total += 1
                continue
            if f == "case":
                continue
            total += 1 + len(stack)
        total += line.count(" ? ") * (1 + len(stack))
        ops = [{"and": "&&", "or": "||"}.get(o, o) for o in _LOGIC.findall(line)]
        total += sum(1 for i, o in enumerate(ops) if i == 0 or ops[i - 1] != o)
        recursion = recursion or re.search(rf"(?<![\w.$])(?:self\.|this\.)?{re.escape(name)}\s*\(", line) is not None
        if goes_on or any(f in _NESTS for f in flows):
            stack.append(depth)
    return total + recursion


def symbols_of(text: str) -> list[dict]:
    """Definitions of a file in their order."""
    lines = text.split("\n")
    indents = [_indent(x) if x.strip() else -1 for x in lines]
    out: list[dict] = []
    stack: list[tuple[int, str, str]] = []  # indentation, kind, name
    for i, line in enumerate(lines):
        if indents[i] < 0 or _COMMENT.match(line):
            continue
        while stack and stack[-1][0] >= indents[i] and not _CLOSES.match(line):
            stack.pop()
        kind = name = ""
        rest = ""
        if m := _CLASS.match(line):
            kind, name, rest = "class", m[1], m[2]
        else:
            for k, p in enumerate(_FUNCTION):
                m = p.match(line)
                if m and m[1] not in _WORDS_NO_NAMES and not (k == 5 and not (stack and stack[-1][1] == "class")):
                    kind, name = "function", m[1]
                    break
        if not kind:
            continue
        end = i + 1
        while end < len(lines) and (indents[end] < 0 or indents[end] > indents[i] or indents[end] == indents[i] and _CLOSES.match(lines[end])):
            end += 1
        while end > i + 1 and indents[end - 1] < 0:
            end -= 1
        parent = next((n for d, k, n in reversed(stack) if k == "class"), None) if stack and stack[-1][1] == "class" else None
        bases: list[str] = []
        if kind == "class" and (b := _BASES.search(rest)):
            bases = [x.strip().split("<")[0] for g in b.groups() if g for x in g.split(",") if x.strip() and "=" not in x]
        header = " ".join(lines[i : i + 8]) if kind == "function" else ""
        body = lines[i + 1 : end]
        out.append({
            "kind": "method" if kind == "function" and parent else kind, "name": name, "parent": parent, "bases": bases, "first_line": i + 1, "last_line": end,
            "params": _parameters(header) if header else [], "cognitive": cognitive(body, name) if kind == "function" else 0,
            "documented": i > 0 and lines[i - 1].strip().startswith(("*/", "///", "//")) or bool(body and body[0].strip().startswith(('"""', "\'\'\'", 'r"""'))),
            "body": "\n".join(body) if kind == "function" else "", "doc": _doc_above(lines, i) if kind == "function" else "",
        })
        stack.append((indents[i], kind, name))
    return out


def _doc_above(lines: list[str], at: int) -> str:
    """The block comment that ends right above a definition, annotations between them aside."""
    i = at - 1
    while i >= 0 and lines[i].strip().startswith("@"):
        i -= 1
    if i < 0 or not lines[i].strip().endswith("*/"):
        return ""
    j = i
    while j >= 0 and "/**" not in lines[j]:
        j -= 1
    return "\n".join(lines[j : i + 1]) if j >= 0 else ""


_SCHEMA = ("path string, nth int, kind string, name string, parent string, bases array<string>, first_line int, last_line int, params array<string>, cognitive int, "
           "documented boolean, body string, doc string")


def symbols(files: DataFrame) -> DataFrame:
    """(path, nth, kind, name, parent, bases, first_line, last_line, params, cognitive, documented, body, doc); null texts give none."""
    slim = files.where("text is not null").select("path", normal_text(F.col("text")).alias("t"))
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.string(), pa.string()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = [(p, n, *s.values()) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, s in enumerate(symbols_of(t))]
            order = ["path", "nth", "kind", "name", "parent", "bases", "first_line", "last_line", "params", "cognitive", "documented", "body", "doc"]
            yield pa.RecordBatch.from_arrays([pa.array([r[order.index(n)] for r in rows], t) for n, t in zip(names, types)], names=names)

    return slim.mapInArrow(run, _SCHEMA)


def graph(s: DataFrame) -> DataFrame:
    """(src, dst, relation): files contain definitions, classes contain methods, classes inherit, functions call.

    Keys are path#name or path#class.name. Bases and called names are resolved where one definition of that name exists, in the file
    first, else in the whole collection; names that several files define stay open. All joins are on names and paths.
    """
    key = F.concat_ws("#", "path", F.concat_ws(".", "parent", "name"))
    own = s.select("path", "name", "kind", key.alias("key")).distinct()
    contains = s.select(F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat_ws("#", "path", "parent")).alias("src"), key.alias("dst"), F.lit("contains").alias("relation"))
    unique = own.groupBy("name").agg(F.min("key").alias("key"), F.max("key").alias("other")).where("key = other").select("name", F.col("key").alias("anywhere"))
    here = own.groupBy("path", "name").agg(F.min("key").alias("key"), F.max("key").alias("other")).where("key = other").select("path", "name", F.col("key").alias("here"))

    def resolved(uses: DataFrame, relation: str) -> DataFrame:
        found = uses.join(here, ["path", "name"], "left").join(unique, "name", "left").withColumn("dst", F.coalesce("here", "anywhere"))
        return found.where("dst is not null and dst <> src").select("src", "dst", F.lit(relation).alias("relation"))

    bases = s.where("kind = 'class'").select("path", key.alias("src"), F.explode("bases").alias("name"))
    called = F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?<![\w.$])([A-Za-z_$][\w$]*)\s*\("), F.lit(1)))
    calls = s.where("kind <> 'class'").select("path", key.alias("src"), F.explode(called).alias("name"))
    return contains.unionByName(resolved(bases, "inherits")).unionByName(resolved(calls, "calls")).distinct()


def unused(s: DataFrame) -> DataFrame:
    """(path, name, rule, what): parameters and locals that the body of their function does not use, private methods that no body of the
    file calls. Names that start with an underscore are meant to be unused, empty bodies tell nothing."""
    uses = lambda body, n: F.regexp_count(body, F.concat(F.lit(r"(?<![\w$])"), F.regexp_replace(n, r"\$", r"\\\\$"), F.lit(r"(?![\w$])")))
    f = s.where("kind <> 'class'").where(F.trim(F.regexp_replace("body", r"[{}\s]|pass", "")) != "")
    params = f.select("path", "name", "body", F.explode("params").alias("what"), F.lit("unused-parameter").alias("rule"), F.lit(0).alias("least"))
    names = F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?m)^\s*(?:const|let|var|final\s+\w+|int|String|boolean)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?="), F.lit(1)))
    local = f.select("path", "name", "body", F.explode(names).alias("what"), F.lit("unused-local").alias("rule"), F.lit(1).alias("least"))
    rows = params.unionByName(local).where(~F.startswith("what", F.lit("_")) & (uses(F.col("body"), F.col("what")) <= F.col("least")))
    private = s.where(F.col("name").rlike(r"^_[a-z]") & (F.col("kind") == "method")).select("path", "name")
    called = s.select("path", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1)))).alias("name")).distinct()
    lone = private.join(called, ["path", "name"], "left_anti").select("path", "name", F.lit("unused-private").alias("rule"), F.col("name").alias("what"))
    return rows.select("path", "name", "rule", "what").unionByName(lone).distinct()


def documentation(s: DataFrame) -> DataFrame:
    """(path, name, issue, what) of functions with a block comment of tags: parameters that are not described, descriptions of parameters
    that do not exist, descriptions without words, a missing or a needless description of the result."""
    d = F.col("doc")
    told = F.array_distinct(F.regexp_extract_all("doc", F.lit(r"@param\s+(?:\{[^}]*\}\s*)?\[?([A-Za-z_$][\w$]*)"), F.lit(1)))
    bare = F.array_distinct(F.regexp_extract_all("doc", F.lit(r"(?m)@param\s+(?:\{[^}]*\}\s*)?\[?([A-Za-z_$][\w$]*)\]?[ \t]*$"), F.lit(1)))
    gives = F.col("body").rlike(r"(?m)\breturn\s+[^;\s]")
    tells = d.rlike(r"@returns?\b")
    one = lambda issue, what: F.transform(what, lambda w: F.struct(F.lit(issue).alias("issue"), w.alias("what")))
    nothing = F.array().cast("array<string>")
    issues = F.concat(
        one("missing-parameter", F.array_except("params", told)), one("unknown-parameter", F.array_except(told, "params")), one("bare-parameter", bare),
        one("missing-result", F.when(gives & ~tells, F.array(F.lit("return"))).otherwise(nothing)), one("needless-result", F.when(~gives & tells, F.array(F.lit("return"))).otherwise(nothing)))
    rows = s.where((F.col("kind") != "class") & (d != "")).select("path", "name", F.explode(issues).alias("i")).select("path", "name", "i.issue", "i.what")
    public = ~F.startswith("name", F.lit("_")) & (F.col("kind") != "class") & ~F.col("documented") & (d == "")
    return rows.unionByName(s.where(public).select("path", "name", F.lit("no-documentation").alias("issue"), F.col("name").alias("what"))).distinct()


def references(lines: DataFrame, s: DataFrame) -> DataFrame:
    """(name, path, line_no, defines): every line that holds the name of a definition, as an equi-join of words with names."""
    names = s.groupBy("name").agg(F.collect_set(F.struct("path", F.col("first_line").alias("line_no"))).alias("at"))
    words = lines.select("path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("name"))
    return words.join(names, "name").select("name", "path", "line_no", F.array_contains("at", F.struct("path", "line_no")).alias("defines"))


# Kind of extension point -> pattern with the name as its group.
EXTENSION = {
    "union-type": r"(?m)^\s*(?:export\s+)?type\s+(\w+)(?:<[^>]*>)?\s*=\s*\|?\s*(?:['\"\w.]+\s*\|\s*)+['\"\w.]+", "optional-callback": r"(?m)^\s*(?:readonly\s+)?(\w+)\?\s*:\s*\([^)]*\)\s*=>",
    "bounded-generic": r"(?m)\b(?:class|interface|function|type)\s+(\w+)\s*<[^>]*\bextends\b", "abstract-class": r"(?m)\babstract\s+class\s+(\w+)",
    "protocol": r"(?m)^\s*class\s+(\w+)\([^)]*\b(?:Protocol|ABC|ABCMeta)\b", "interface": r"(?m)^\s*(?:export\s+|public\s+)?interface\s+(\w+)|^\s*type\s+(?:\w+)\s+interface\b", "trait": r"(?m)^\s*(?:pub\s+)?trait\s+(\w+)",
}


def extension_points(files: DataFrame) -> DataFrame:
    """(path, kind, name): where types leave room for others."""
    t = normal_text(F.col("text"))
    def named(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    found = F.concat(*[named(k, F.regexp_extract_all(t, F.lit(p), F.lit(1))) for k, p in EXTENSION.items()])
    return files.where("text is not null").select("path", F.explode(found).alias("x")).select("path", "x.kind", "x.name").where("name <> ''").distinct()


def method_parents(s: DataFrame) -> DataFrame:
    """(path, name, parent) of methods; the class is the one around the method, not any class with a method of that name."""
    return s.where("kind = 'method'").select("path", "name", "parent").distinct()
