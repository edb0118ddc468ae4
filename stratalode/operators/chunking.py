"""Heading-aware chunking: line states, segments, packing, hierarchy, and HTML to text blocks.

The state machine and the packing are folds over one text; they run per row in Arrow batches (a narrow map). Headings, ids and
parents are relational. Sizes are estimated tokens (a quarter of the characters).
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TOKENS, MIN_TOKENS = 512, 50
KINDS = ("code", "heading", "table", "formula", "figure", "list", "text")

_FENCE = re.compile(r"^\s*(```|~~~)")
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
_LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+\S")
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_FIGURE = re.compile(r"^\s*(?:!\[|\[Figure:)")


def tokens(text: str) -> int:
    return math.ceil(len(text) / 4)


def segments(text: str) -> list[tuple[str, str, str | None, int, int]]:
    """(kind, content, heading, first line, last line), lines from 1. Fences, tables and formulas stay whole."""
    out, lines = [], text.replace("\r\n", "\n").split("\n")
    heading: str | None = None
    kind, start, held = "text", 0, []
    fence = formula = False

    def flush(end: int) -> None:
        nonlocal held
        body = "\n".join(held).strip("\n")
        if body.strip():
            out.append((kind, body, heading, start + 1, end))
        held = []

    for i, line in enumerate(lines):
        if fence:
            held.append(line)
            if _FENCE.match(line):
                flush(i + 1)
                fence, kind, start = False, "text", i + 1
            continue
        if formula:
            held.append(line)
            if line.rstrip().endswith("$$"):
                flush(i + 1)
                formula, kind, start = False, "text", i + 1
            continue
        if _FENCE.match(line):
            flush(i)
            kind, start, held, fence = "code", i, [line], True
            continue
        s = line.strip()
        if s.startswith("$$"):
            flush(i)
            kind, start, held = "formula", i, [line]
            if len(s) > 2 and s.endswith("$$"):
                flush(i + 1)
                kind, start = "text", i + 1
            else:
                formula = True
            continue
        if m := _HEADING.match(line):
            flush(i)
            heading = m[2]
            out.append(("heading", line.strip(), heading, i + 1, i + 1))
            kind, start = "text", i + 1
            continue
        now = "table" if _TABLE.match(line) else "figure" if _FIGURE.match(line) else "list" if _LIST.match(line) else "text"
        if kind == "list" and now == "text" and line.startswith(("  ", "\t")) and s:
            now = "list"
        if now != kind and s:
            flush(i)
            kind, start = now, i
        elif not held:
            start = i
        held.append(line)
    flush(len(lines))
    return out


def _cut_at(text: str, most: int) -> int:
    """The last blank before ``most``; where there is none, ``most`` less the marks that belong to the character before."""
    at = text.rfind(" ", most // 2, most + 1)
    if at > 0:
        return at
    at = most
    while at > 1 and (unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d"):
        at -= 1
    return at


def split_long(text: str, limit: int) -> list[str]:
    """Paragraphs, then sentences, packed up to the limit; a trailing fragment without a full stop is kept."""
    out, held = [], ""
    for para in re.split(r"\n\n+", text):
        units = [para] if tokens(para) <= limit else re.findall(r"[^.!?。！？]+[.!?。！？]*\s*", para) or [para]
        for u in units:
            while tokens(u) > limit:
                out += [held.strip()] if held.strip() else []
                cut = _cut_at(u, limit * 4)
                out.append(u[:cut].rstrip())
                u, held = u[cut:].lstrip(), ""
            if held and tokens(held + u) > limit:
                out.append(held.strip())
                held = ""
            held += u
        if held and not held.endswith("\n\n"):
            held += "\n\n"
    return out + ([held.strip()] if held.strip() else [])


def pack(parts: list[tuple], most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> list[tuple]:
    """Segments joined up to ``most`` tokens; a heading opens a new chunk once the held one has ``least``; code, tables and
    formulas are never cut unless they alone exceed the limit."""
    out: list[tuple] = []
    held: list[tuple] = []

    def size() -> int:
        return sum(tokens(h[1]) for h in held)

    def flush() -> None:
        nonlocal held
        if held:
            kinds = {h[0] for h in held if h[0] != "heading"}
            kind = kinds.pop() if len(kinds) == 1 else "text"
            out.append((kind, "\n\n".join(h[1] for h in held), held[0][2], held[0][3], held[-1][4]))
        held = []

    for p in parts:
        if p[0] == "heading" and size() >= least:
            flush()
        if tokens(p[1]) > most:
            flush()
            out += [(p[0], piece, p[2], p[3], p[4]) for piece in split_long(p[1], most)]
            continue
        if size() + tokens(p[1]) > most:
            flush()
        held.append(p)
    flush()
    return out


SPECIAL = ("code", "table", "formula")


def adaptive(parts: list[tuple], most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> list[tuple]:
    """Segments joined while they are below ``least`` and fit; specials always stand alone and whole, longer texts are split at
    paragraphs and sentences."""
    out: list[tuple] = []
    held: list[tuple] = []

    def flush() -> None:
        nonlocal held
        if held:
            out.append((held[0][0] if len({h[0] for h in held}) == 1 else "text", "\n\n".join(h[1] for h in held), held[0][2], held[0][3], held[-1][4]))
        held = []

    for p in parts:
        if p[0] in SPECIAL:
            flush()
            out.append(p)
        elif tokens(p[1]) > most:
            flush()
            out += [(p[0], piece, p[2], p[3], p[4]) for piece in split_long(p[1], most)]
        else:
            if held and (sum(tokens(h[1]) for h in held) >= least or sum(tokens(h[1]) for h in held) + tokens(p[1]) > most):
                flush()
            held.append(p)
    flush()
    return out


def by_level(text: str, level: int, subs: bool = True, kind: str = "section") -> list[tuple]:
    """(kind, content, heading, heading level, first line, last line, number of the parent or None): the sections whose heading is of
    ``level`` or above, each up to the next such heading; with ``subs`` the specials inside follow their section as chunks of their own."""
    lines = text.replace("\r\n", "\n").split("\n")
    parts = segments(text)
    heads = [(p[3], len(p[1]) - len(p[1].lstrip("#")), p[2]) for p in parts if p[0] == "heading"]
    starts = [h for h in heads if h[1] <= level]
    out: list[tuple] = []
    for k, (line, lv, title) in enumerate(starts):
        end = starts[k + 1][0] - 1 if k + 1 < len(starts) else len(lines)
        while end > line and not lines[end - 1].strip():
            end -= 1
        body = "\n".join(lines[line - 1 : end])
        me = len(out)
        out.append((kind, body, title, lv, line, end, None))
        if subs:
            out += [(p[0], p[1], title, lv, p[3], p[4], me) for p in parts if p[0] in SPECIAL and line <= p[3] <= end]
    return out


def multi_scale(text: str) -> list[tuple]:
    """Sections of levels 1 and 2 with their specials, then paragraphs of level 4; a heading that a coarser level has is not repeated.

    As ``by_level``, with the level as the first field; headings are told apart by their line, so equal titles stay."""
    out: list[tuple] = []
    seen: set[int] = set()
    for level, subs, kind in ((1, True, "section"), (2, True, "section"), (4, False, "paragraph")):
        rows = by_level(text, level, subs, kind)
        keep = {i for i, r in enumerate(rows) if r[6] is None and r[4] not in seen}
        number = {}
        for i, r in enumerate(rows):
            if i in keep or r[6] in keep:
                number[i] = len(out)
                out.append((level, *r[:6], number.get(r[6]) if r[6] is not None else None))
        seen |= {rows[i][4] for i in keep}
    return out


def level_chunks(df: DataFrame, id_col: str, text_col: str, level: int | None = None, paper_col: str | None = None) -> DataFrame:
    """(doc, chunk_id, parent_id, level, kind, heading, first_line, last_line, content) by one level, or by all scales for None.

    Contents start with ``[paper][section][KIND]`` where a paper's name is given; ids are hashes of document, number and content."""
    paper = F.col(paper_col) if paper_col else F.lit(None)
    rows = df.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("t"), paper.cast("string").alias("paper")).where("doc is not null and t is not null")

    def run(frames):
        for f in frames:
            out = []
            for doc, t, name in f.itertuples(index=False):
                found = multi_scale(t) if level is None else [(level, *r) for r in by_level(t, level)]
                ids = ["chunk_" + hashlib.sha256(f"{doc}\0{i}\0{r[2]}".encode()).hexdigest()[:16] for i, r in enumerate(found)]
                for i, (lv, kind, body, title, _, a, b, parent) in enumerate(found):
                    head = f"[{name}][{title or '-'}][{kind.upper()}] " if isinstance(name, str) else ""
                    out.append((doc, ids[i], None if parent is None else ids[parent], lv, kind, title, a, b, head + body))
            yield pd.DataFrame(out, columns=["doc", "chunk_id", "parent_id", "level", "kind", "heading", "first_line", "last_line", "content"])

    return rows.mapInPandas(run, "doc string, chunk_id string, parent_id string, level int, kind string, heading string, first_line int, last_line int, content string")


def semantic_chunks(df: DataFrame, id_col: str, text_col: str, most: int = MAX_TOKENS, least: int = MIN_TOKENS, packing=None) -> DataFrame:
    """(doc, chunk_id, ordinal, kind, heading, first_line, last_line, tokens, content); ids are unique per document and ordinal."""
    rows = df.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("t")).where("doc is not null and t is not null")

    def run(frames):
        for f in frames:
            out = []
            for doc, t in f.itertuples(index=False):
                for i, (kind, body, head, a, b) in enumerate((packing or pack)(segments(t), most, least)):
                    cid = "chunk_" + hashlib.sha256(f"{doc}\0{i}\0{body}".encode()).hexdigest()[:16]
                    out.append((doc, cid, i, kind, head, a, b, tokens(body), body))
            yield pd.DataFrame(out, columns=["doc", "chunk_id", "ordinal", "kind", "heading", "first_line", "last_line", "tokens", "content"])

    return rows.mapInPandas(run, "doc string, chunk_id string, ordinal int, kind string, heading string, first_line int, last_line int, tokens int, content string")


def headings(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(doc, line_no, level, title) of ATX headings; a narrow map."""
    rows = df.select(F.col(id_col).cast("string").alias("doc"), F.posexplode(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")).alias("n", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    return rows.where(level > 0).select("doc", (F.col("n") + 1).alias("line_no"), level.alias("level"), F.trim(F.regexp_replace(F.regexp_replace("line", r"^#+\s+", ""), r"\s*#*\s*$", "")).alias("title"))


def heading_tree(heads: DataFrame) -> DataFrame:
    """(doc, line_no, level, title, parent_line): the last heading above of a lower level, by one window per level."""
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("int")
    for lv in range(2, 7):
        above = F.max(F.when(F.col("level") < lv, F.col("line_no"))).over(w)
        parent = F.when(F.col("level") == lv, above).otherwise(parent)
    return heads.select("doc", "line_no", "level", "title", parent.alias("parent_line"))


def plain_blocks(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(doc, nth, block): paragraphs between blank lines."""
    rows = df.select(F.col(id_col).cast("string").alias("doc"), F.posexplode(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n[ \t]*\n")).alias("nth", "block"))
    return rows.where(F.trim(F.regexp_replace("block", r"\s+", " ")) != "")


def llms_links(df: DataFrame, id_col: str, text: Column, cap: int = 500) -> DataFrame:
    """(doc, url) of Markdown links and bare addresses, without trailing punctuation and fragments, each once, the first ``cap``."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s\])>\"']+)"), F.lit(1))
    clean = F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(u, r"#.*$", ""), r"[.,;:]+$", ""))
    return df.select(F.col(id_col).alias("doc"), F.explode(F.slice(F.array_distinct(clean), 1, cap)).alias("url"))


def sitemap_entries(df: DataFrame, id_col: str, xml: Column) -> DataFrame:
    """(doc, loc, lastmod) of url elements; an invalid time is null."""
    urls = F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("u")
    rows = df.select(F.col(id_col).alias("doc"), urls)
    loc = F.trim(F.regexp_extract("u", r"(?s)<loc>\s*(.*?)\s*</loc>", 1))
    mod = F.trim(F.regexp_extract("u", r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1))
    return rows.select("doc", loc.alias("loc"), F.try_to_timestamp(F.nullif(mod, F.lit(""))).alias("lastmod")).where("loc <> ''")


def page_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(url, change) from (url, hash): added, updated, unchanged or removed, by one full outer join."""
    a, b = now.select("url", F.col("hash").alias("h1"), F.lit(True).alias("a")), before.select("url", F.col("hash").alias("h0"), F.lit(True).alias("b"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("h1").eqNullSafe(F.col("h0")), "unchanged").otherwise("updated")
    return a.join(b, "url", "full").select("url", change.alias("change"))


def classify_urls(sitemap: DataFrame, state: DataFrame) -> DataFrame:
    """(url, status): added, check, unchanged (not modified since it was fetched) or removed; an unknown time means check."""
    s, p = sitemap.select("url", "lastmod", F.lit(True).alias("s")), state.select("url", "fetched_at", F.lit(True).alias("p"))
    fresh = F.col("lastmod").isNotNull() & F.col("fetched_at").isNotNull() & (F.col("lastmod") <= F.col("fetched_at"))
    status = F.when(F.col("p").isNull(), "added").when(F.col("s").isNull(), "removed").when(fresh, "unchanged").otherwise("check")
    return s.join(p, "url", "full").select("url", status.alias("status"))


def should_degrade(changes: DataFrame, changed: float = 0.5) -> bool:
    """Whether so much changed that a full run is cheaper: an aggregate of one row decides."""
    r = changes.agg(F.count("*").alias("n"), F.count_if(F.col("change") != "unchanged").alias("c")).first()
    return bool(r["n"]) and r["c"] / r["n"] > changed


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows as lines of a pipe table, pipes and line ends escaped."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


def hierarchy(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, chunk_id, parent_id, level, kind, section, first_line, content) of three levels: document, section, piece.

    A document's coarse chunk is its first 500 characters; a section is a heading with its line; a piece is a semantic chunk with
    its section and kind in front. Parents are found by position: the last heading at or before a piece's first line, else the document.
    Ids are hashes of document, level and position, so no two of a collection are equal.
    """
    base = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("t")).where("doc is not null and t is not null")
    key = lambda level, pos: F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws("|", "doc", F.lit(level), pos.cast("string")), 256), 1, 16))
    top = base.select("doc", key("l1", F.lit(0)).alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("l1").alias("level"), F.lit("summary").alias("kind"),
                      F.lit(None).cast("string").alias("section"), F.lit(1).alias("first_line"), F.substring("t", 1, 500).alias("content"))
    heads = headings(base, "doc", F.col("t"))
    sections = heads.select("doc", key("l2", F.col("line_no")).alias("chunk_id"), key("l1", F.lit(0)).alias("parent_id"), F.lit("l2").alias("level"), F.lit("section").alias("kind"),
                            F.col("title").alias("section"), F.col("line_no").alias("first_line"), F.col("title").alias("content"))
    pieces = semantic_chunks(base, "doc", "t").select("doc", "ordinal", "kind", "first_line", "content")
    # headings and pieces of a document in one order: each piece takes the last heading above
    both = pieces.select("doc", F.col("first_line").alias("line"), F.lit(1).alias("side"), "ordinal", "kind", "content", F.lit(None).cast("string").alias("title")).unionByName(
        heads.select("doc", F.col("line_no").alias("line"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("kind"),
                     F.lit(None).cast("string").alias("content"), "title"))
    w = Window.partitionBy("doc").orderBy("line", "side").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("hl", F.last(F.when(F.col("side") == 0, F.col("line")), True).over(w)).withColumn("sec", F.last("title", True).over(w)).where("side = 1")
    prefix = F.concat(F.lit("["), F.coalesce("sec", F.lit("-")), F.lit("] ["), F.upper("kind"), F.lit("] "))
    fine = placed.select("doc", key("l3", F.col("ordinal")).alias("chunk_id"), F.when(F.col("hl").isNull(), key("l1", F.lit(0))).otherwise(key("l2", F.col("hl"))).alias("parent_id"),
                         F.lit("l3").alias("level"), "kind", F.col("sec").alias("section"), F.col("line").alias("first_line"), F.concat(prefix, "content").alias("content"))
    return top.unionByName(sections).unionByName(fine)


def html_cells(df: DataFrame, id_col: str, html: Column) -> DataFrame:
    """(id, tbl, row, cells): rows of HTML tables, tags inside cells left out; a narrow map of built-in expressions."""
    tables = df.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("tbl", "t"))
    rows = tables.select("id", "tbl", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", "")))
    return rows.select("id", "tbl", "row", F.array_join(cells, " | ").alias("cells"))


def resolve_links(df: DataFrame, base_col: str, link_col: str) -> DataFrame:
    """The frame with ``resolved``: each link against its base by the standard library, batch by batch."""
    from urllib.parse import urljoin

    @F.pandas_udf("string")
    def join(base: pd.Series, link: pd.Series) -> pd.Series:
        def one(b, u):
            try:
                return urljoin(b, u) if b is not None and u is not None else None
            except ValueError:
                return None

        return pd.Series([one(b, u) for b, u in zip(base, link)])

    return df.withColumn("resolved", join(F.col(base_col), F.col(link_col)))
