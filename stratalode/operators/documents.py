"""Documents, pages and configuration: markers, wrapped lines, HTML to Markdown, metadata, configs, examples, cards, cursors."""

from __future__ import annotations

import base64
import json
import re
import time
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import basename, normal_text

PAGE = r"(?i)^(?:#{1,6}\s*page\s+(\d+)|page\s+(\d+)|---\s*page\s+(\d+)\s*---)\s*$"


def page_lines(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(doc, line_no, page, line): markers become comments, each line knows its page (the last marker above, else 1)."""
    rows = df.select(F.col(id_col).alias("doc"), F.posexplode(F.split(normal_text(text), "\n")).alias("n", "line"))
    num = F.coalesce(*[F.nullif(F.regexp_extract("line", PAGE, i), F.lit("")) for i in (1, 2, 3)])
    w = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("mark", num.cast("int")).withColumn("page", F.coalesce(F.last("mark", True).over(w), F.lit(1)))
    line = F.when(F.col("mark").isNotNull(), F.concat(F.lit("<!-- pagebreak:"), F.col("mark").cast("string"), F.lit(" -->"))).otherwise(F.col("line"))
    return marked.select("doc", (F.col("n") + 1).alias("line_no"), "page", line.alias("line"))


def merge_wrapped(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text): lines that were wrapped by a layout joined again, page numbers left out, broken URLs continued; a fold per text."""
    number = re.compile(r"^\s*(?:-\s*)?(?:page\s+)?\d{1,5}(?:\s*-)?\s*$", re.I)
    starts = re.compile(r"^(?:[-*+•]\s|\d+[.)]\s|#{1,6}\s|\||```|>)")

    def fold(t: str) -> str:
        out: list[str] = []
        for line in t.replace("\r\n", "\n").split("\n"):
            s = line.strip()
            if number.match(line) and s:
                continue
            if not s:
                out.append("")
            elif out and out[-1] and re.search(r"https?://\S*[/\-_=&?]$", out[-1]) and re.match(r"^[\w/\-.%=&?#]+$", s):
                out[-1] += s
            elif out and out[-1] and not starts.match(s) and not starts.match(out[-1]) and out[-1][-1] not in ".!?:;。！？" and (s[0].islower() or s[0].isdigit()):
                out[-1] = f"{out[-1]} {s}"
            else:
                out.append(s)
        return "\n".join(out)

    slim = df.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("t")).where("t is not null")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fold(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc", "text"])

    return slim.mapInArrow(run, "doc string, text string")


class _Markdown(HTMLParser):
    """HTML as Markdown: headings, paragraphs, lists, tables, code, links; scripts, styles, navigation and footers leave."""

    SKIP = {"script", "style", "nav", "footer", "noscript", "template", "svg", "head"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.pre = 0
        self.lists: list[list] = []
        self.row: list[str] | None = None
        self.rows = 0
        self.href: str | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "main", "table", "blockquote"):
            self.out.append("\n\n")
            self.rows = 0 if tag == "table" else self.rows
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.out.append("\0")
        elif tag == "a" and a.get("href"):
            self.href = a["href"]
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch(r"h[1-6]", tag) or tag in ("p", "div", "section", "article", "main", "table", "blockquote"):
            self.out.append("\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag in ("td", "th") and self.row is not None and "\0" in self.out:
            at = len(self.out) - 1 - self.out[::-1].index("\0")
            self.row.append(" ".join("".join(self.out[at + 1 :]).split()).replace("|", "\\|"))
            del self.out[at:]
        elif tag == "tr" and self.row is not None:
            self.out.append("\n| " + " | ".join(self.row) + " |" + ("\n|" + " --- |" * len(self.row) if self.rows == 0 else ""))
            self.rows += 1
            self.row = None
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href})")
            self.href = None

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def main_content(html: str) -> str:
    """The first of main, article, role=main, .content, .post, .documentation, body; else the whole."""
    for p in (r"<main\b[^>]*>(.*?)</main>", r"<article\b[^>]*>(.*?)</article>", r"<div\b[^>]*role=[\"']main[\"'][^>]*>(.*?)</div>",
              r"<div\b[^>]*class=[\"'][^\"']*\b(?:content|post|documentation)\b[^\"']*[\"'][^>]*>(.*)</div>", r"<body\b[^>]*>(.*?)</body>"):
        m = re.search(p, html, re.S | re.I)
        if m and m[1].strip():
            return m[1]
    return html


def to_markdown(html: str) -> str:
    m = _Markdown()
    m.feed(main_content(html))
    m.close()
    t = re.sub(r"[ \t]+\n", "\n", "".join(m.out).replace("\0", ""))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def html_to_markdown(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, markdown, hash): the hash is that of the Markdown before any cleaning."""
    slim = df.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("h")).where("h is not null")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_markdown(h) for h in b.column(1).to_pylist()], pa.string())], names=["id", "markdown"])

    return slim.mapInArrow(run, "id string, markdown string").withColumn("hash", F.sha2("markdown", 256))


def layout_kinds(items: DataFrame) -> DataFrame:
    """(page, line, text, kind) of positioned pieces of print (page, x, y, size, font, text): pieces of one height form a line.

    heading: larger than the page's usual size by a sixth and short; code: a fixed-width font; table: three or more pieces with wide
    gaps between them; formula: mostly signs of mathematics; else text. The usual size is the page's median by approx percentile.
    """
    usual = items.groupBy("page").agg(F.percentile_approx("size", 0.5).alias("usual"))
    cells = items.where(F.trim("text") != "").withColumn("line", F.round("y", 0).cast("int"))
    lines = cells.groupBy("page", "line").agg(
        F.array_sort(F.collect_list(F.struct("x", "text", "size"))).alias("c"), F.max("size").alias("size"), F.bool_and(F.lower("font").rlike("mono|courier|consol|code")).alias("fixed"))
    text = F.array_join(F.transform("c", lambda z: z["text"]), " ")
    gaps = F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.size("c"), F.lit(2))), lambda i: (i <= F.size("c")) & (F.try_element_at("c", i)["x"] - F.try_element_at("c", i - 1)["x"] > 3 * F.col("size") + F.length(F.try_element_at("c", i - 1)["text"]) * F.col("size") * 0.45)))
    signs = F.length(F.regexp_replace(text, r"[^=+−\-*/^_<>≤≥∑∏∫√∞α-ωΑ-Ω∂∇±×·()\[\]{}|]", ""))
    kind = (
        F.when(F.col("fixed"), "code").when((F.col("size") >= F.col("usual") * 7 / 6) & (F.length(text) <= 200), "heading").when(gaps >= 2, "table")
        .when((F.length(text) <= 200) & (signs * 4 >= F.length(F.regexp_replace(text, r"\s", ""))), "formula").otherwise("text")
    )
    return lines.join(usual, "page").select("page", "line", text.alias("text"), kind.alias("kind"))


def metadata(text: Column) -> Column:
    """A struct of links and licence found in a text; null fields where there are none."""
    def found(p: str, prefix: str = "") -> Column:
        x = F.regexp_extract(text, p, 1)
        return F.when(x != "", F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(x, r"[.,;:)\]]+$", ""), r"\.git$", "")))

    return F.struct(
        found(r"(?i)arxiv(?:\.org/(?:abs|pdf)/|:)\s*(\d{4}\.\d{4,5})", "arxiv:").alias("arxiv"), found(r"(10\.\d{4,}/[^\s\"'<>\]]+)", "doi:").alias("doi"),
        found(r"(?i)github\.com/([\w-]+/[\w.-]+)", "https://github.com/").alias("github"), found(r"(?i)gitlab\.com/([\w-]+/[\w.-]+)", "https://gitlab.com/").alias("gitlab"),
        found(r"(?i)\b(MIT|Apache-2\.0|BSD-[23]-Clause|GPL-[23]\.0|LGPL-3\.0|MPL-2\.0|ISC)\b").alias("license"))


def python_dependencies(text: Column) -> Column:
    """Array of (name, version) of a requirements text."""
    keep = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-") & x.rlike(r"^[a-zA-Z0-9_-]+(\[.*?\])?([=<>~!]+.+)?$"))
    return F.transform(keep, lambda x: F.struct(F.regexp_extract(x, r"^([a-zA-Z0-9_-]+)", 1).alias("name"), F.nullif(F.trim(F.regexp_extract(x, r"[=<>~!]+(.+)$", 1)), F.lit("")).alias("version")))


def parse_model_json(response: Column, schema: str) -> Column:
    """A struct from a model's answer: fenced or bare JSON, then with trailing commas, typographic and single quotes repaired; else null."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    raw = F.when(fenced != "", fenced).otherwise(bare)
    cleaned = F.regexp_replace(F.translate(raw, "“”‘’", "\"\"''"), r",\s*([}\]])", "$1")
    quoted = F.regexp_replace(cleaned, r"'([^']*)'", "\"$1\"")
    ok = lambda x: F.try_parse_json(x).isNotNull() & (x != "")
    return F.when(ok(raw), F.from_json(raw, schema)).when(ok(cleaned), F.from_json(cleaned, schema)).when(ok(quoted), F.from_json(quoted, schema))


# Purpose of a configuration file by substrings of its path, in this order (fixed values).
PURPOSES = (
    ("database_configuration", ("database", "db", "postgres", "mysql", "mongo", "redis")), ("api_configuration", ("api", "rest", "graphql", "endpoint")),
    ("logging_configuration", ("log", "logger", "logging")), ("docker_configuration", ("docker",)),
    ("ci_cd_configuration", (".travis", ".gitlab", ".github", "ci", "cd", "jenkins", "circleci")),
)


def config_purpose(path: Column) -> Column:
    low = F.lower(path)
    out = None
    for name, words in PURPOSES:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general_configuration")


def assignments(files: DataFrame) -> DataFrame:
    """(path, key, value, type) of KEY = value lines at the beginning of a line."""
    rows = files.where("text is not null").select("path", F.explode(F.split(normal_text(F.col("text")), "\n")).alias("line"))
    key, value = F.regexp_extract("line", r"^([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$", 1), F.regexp_extract("line", r"^([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$", 2)
    v = F.trim(value)
    kind = F.when(F.lower(v).isin("true", "false"), "boolean").when(v.rlike(r"^-?\d+$"), "integer").when(v.rlike(r"^-?\d+\.\d+$"), "float").otherwise("string")
    return rows.where(key != "").select("path", key.alias("key"), v.alias("value"), kind.alias("type"))


# Group of configuration keys -> keys, least number of hits (fixed values).
CONFIG_KEYS = {
    "database_config": (("host", "port", "database", "user", "username", "password", "db_name", "db_host", "db_port"), 3),
    "api_config": (("base_url", "api_key", "api_secret", "timeout", "retry", "endpoint", "api_url"), 2),
    "logging_config": (("level", "format", "handler", "file", "console", "log_level", "log_file", "log_format"), 2),
    "cache_config": (("backend", "ttl", "max_size", "redis", "memcached", "cache_timeout", "cache_backend"), 2),
    "email_config": (("smtp_host", "smtp_port", "email", "from_email", "mail_server", "email_backend"), 2),
    "auth_config": (("secret_key", "jwt_secret", "token", "oauth", "authentication", "jwt_expiry"), 1),
    "server_config": (("host", "port", "bind", "workers", "threads", "server_host", "server_port"), 2),
}


def config_patterns(keys: DataFrame) -> DataFrame:
    """(path, pattern, hits): groups of which a file's keys (their last segment) hit enough, either containing the other."""
    last = F.lower(F.regexp_extract("key", r"([^._-]*)$", 1))
    votes = []
    for name, (words, _) in CONFIG_KEYS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | last.contains(w) | ((F.length(last) > 2) & F.lit(w).contains(last))
        votes.append(F.when(hit, F.lit(name)))
    rows = keys.select("path", F.explode(F.filter(F.array(*votes), lambda x: x.isNotNull())).alias("pattern"))
    need = F.element_at(F.create_map(*[F.lit(x) for n, (_, k) in CONFIG_KEYS.items() for x in (n, k)]), F.col("pattern"))
    return rows.groupBy("path", "pattern").agg(F.count("*").alias("hits")).where(F.col("hits") >= need)


TRIVIAL = r"\b(?:Mock|MagicMock)\(\)|(?:jest|vi)\.fn\(\)|sinon\.(?:stub|spy)\(\)|assertTrue\(True\)|assertFalse\(False\)|\bpass\b|\bTODO\b|\bFIXME\b|\bXXX\b|\(\) => \{\}|lambda: None"


def examples(defs_text: DataFrame, least: int = 20, most_per_category: int = 0) -> DataFrame:
    """(path, category, code, complexity, hash): code blocks worth showing, without trivial ones and copies.

    From (path, code). ``most_per_category`` keeps only the simplest of each category, 0 all of them; the limit is one that each task
    applies before the shuffle. Trivial is a token test, so words that merely contain one of the tokens stay.
    """
    cat = (
        F.when(F.col("code").rlike(r"\bassert|expect\("), "assertion").when(F.col("code").rlike(r"(?i)\b(config|settings|options)\b"), "configuration")
        .when(F.col("code").rlike(r"=\s*(new\s+)?[A-Z]\w*\("), "instantiation").when(F.col("code").rlike(r"\.\w+\("), "method_call").otherwise("workflow")
    )
    lines = F.size(F.split("code", "\n"))
    commas = F.length("code") - F.length(F.replace("code", F.lit(","), F.lit("")))
    base = defs_text.where((F.length("code") >= least) & ~F.col("code").rlike(TRIVIAL)).select(
        "path", cat.alias("category"), "code", F.round(F.least(F.lit(1.0), 0.1 * lines + 0.05 * (commas + 1)), 6).alias("complexity"), F.substring(F.md5("code"), 1, 8).alias("hash"))
    once = base.groupBy("hash", "category").agg(F.min(F.struct("path", "code", "complexity")).alias("x")).select("hash", "category", "x.*")
    if most_per_category > 0:
        w = Window.partitionBy("category").orderBy("complexity", "hash")
        once = once.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most_per_category)
    return once.select("path", "category", "code", "complexity", "hash")


def card_chunks(cards: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(card_id, kind, nth, content): one chunk per field value; arrays give one each. ``fields``: kind -> column."""
    items = []
    kinds = dict(cards.dtypes)
    for kind, col in fields.items():
        values = F.col(col) if kinds[col].startswith("array") else F.array(F.col(col))
        items.append(F.transform(F.coalesce(values, F.array().cast("array<string>")), _item(kind)))
    rows = cards.select("card_id", "name", F.explode(F.concat(*items)).alias("x")).where(F.col("x.v").isNotNull() & (F.trim("x.v") != ""))
    return rows.select("card_id", "x.kind", "x.nth", F.concat_ws("\n", F.concat_ws(" - ", "name", "x.kind"), "x.v").alias("content"))


def _item(kind: str):
    return lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), v.cast("string").alias("v"))


CURSOR_HOURS = 24


def encode_cursor(offset: int, tool: str, sort_key: str | None = None, now_ms: int | None = None) -> str:
    state = {"offset": offset, "sortKey": sort_key, "tool": tool, "timestamp": int(time.time() * 1000) if now_ms is None else now_ms}
    return base64.urlsafe_b64encode(json.dumps(state).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, tool: str, now_ms: int | None = None) -> dict | None:
    """The state, or None for a malformed, foreign or expired cursor."""
    try:
        state = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        age = (int(time.time() * 1000) if now_ms is None else now_ms) - state["timestamp"]
        return state if state["tool"] == tool and 0 <= age <= CURSOR_HOURS * 3_600_000 and state["offset"] >= 0 else None
    except (ValueError, KeyError, TypeError):
        return None


def page_of(df: DataFrame, order: list, limit: int, cursor: str | None, tool: str) -> tuple[DataFrame, str]:
    """A page of an ordered frame and the cursor of the next one."""
    state = decode_cursor(cursor, tool) if cursor else {"offset": 0}
    if state is None:
        raise ValueError("invalid or expired cursor")
    return df.orderBy(*order).offset(state["offset"]).limit(limit), encode_cursor(state["offset"] + limit, tool)
