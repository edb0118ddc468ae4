"""Relational text repair: repeated page lines, tables in text, column types, titles, metadata, credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of

PAGE_NUMBER = r"^\s*(?:-\s*)?(?:page\s+)?\d{1,5}(?:\s+of\s+\d{1,5})?(?:\s*-)?\s*$"


def line_key(line: Column) -> Column:
    """Lower case, digits masked, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "#"), r"[ \t]+", " "))


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(paper, key, pages): lines of 4 to 160 characters on at least 60 % of a paper's pages (two at least).

    From (paper, page, text). Lines count once per page; the counts are combined before each shuffle, and the pages of a
    paper are counted apart from its lines, so a paper of any size is as many rows as it has different lines.
    """
    lines = pages.select("paper", "page", F.explode(F.split("text", "\n")).alias("line")).where((F.trim("line") != "") & ~F.lower("line").rlike(PAGE_NUMBER))
    keys = lines.select("paper", "page", line_key(F.col("line")).alias("key")).where(F.length("key").between(4, 160)).distinct()
    counts = keys.groupBy("paper", "key").agg(F.count("*").alias("pages"))
    totals = pages.select("paper", "page").distinct().groupBy("paper").agg(F.count("*").alias("n"))
    return counts.join(totals, "paper").where((F.col("n") >= 2) & (F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.6)))).select("paper", "key", "pages")


def value_type(v: Column) -> Column:
    t = F.trim(v)
    return (
        F.when(t == "", None).when(F.lower(t).isin("true", "false", "yes", "no", "1", "0"), "boolean")
        .when(t.rlike(r"^-?\d+(\.\d+)?$|^-?\d{1,3}(,\d{3})*(\.\d+)?$"), "number")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}|^\d{1,2}/\d{1,2}/\d{2,4}"), "date").otherwise("string")
    )


def pipe_cells(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, row, col, value) of pipe tables, rules left out; a narrow map."""
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("row", "line")).where(
        F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    inner = F.regexp_replace(F.regexp_replace("line", r"^\s*\|", ""), r"\|\s*$", "")
    return rows.select("id", "row", F.posexplode(F.split(inner, r"\|")).alias("col", "value")).withColumn("value", F.trim("value"))


def column_types(cells: DataFrame) -> DataFrame:
    """(id, col, type) below the header row: the one type of a column's values, or mixed."""
    head = cells.groupBy("id").agg(F.min("row").alias("head"))
    body = cells.join(head, "id").where(F.col("row") > F.col("head"))
    types = F.array_sort(F.collect_set(value_type(F.col("value"))))
    return body.groupBy("id", "col").agg(types.alias("ts")).select(
        "id", "col", F.when(F.size("ts") == 0, "string").when(F.size("ts") == 1, F.element_at("ts", 1)).otherwise("mixed").alias("type"))


def text_tables(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, first_row, rows, cols): runs of two or more lines of at least two columns apart by tabs or wide gaps.

    Gaps and islands: a running count of the lines that are no table rows numbers the runs of a text.
    """
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("row", "line"))
    cols = F.size(F.split(F.trim("line"), r"\t+| {2,}"))
    w = Window.partitionBy("id").orderBy("row")
    base = lines.withColumn("cols", F.when(F.trim("line") == "", 0).otherwise(cols)).withColumn("is_row", F.col("cols") >= 2)
    runs = base.withColumn("run", F.sum((~F.col("is_row")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("is_row")
    return runs.groupBy("id", "run").agg(F.min("row").alias("first_row"), F.count("*").alias("rows"), F.max("cols").alias("cols")).where("rows >= 2").drop("run")


def title_of(text: Column, fallback: Column) -> Column:
    """The first level-one heading, at most 100 characters, else the file's name."""
    found = F.trim(F.regexp_extract(text, r"(?m)^[ \t]*#[ \t]+(\S.*)$", 1))
    name = F.regexp_replace(F.regexp_replace(fallback, r"\.[^.]+$", ""), r"[-_]", " ")
    return F.when(found != "", F.substring(found, 1, 100)).otherwise(name)


def summary_of(text: Column, limit: int = 200) -> Column:
    """The first sentence of the first line that is neither heading, picture, link, comment nor fence."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(#|!\[|\[!\[|<!--|```|---$)") & ~F.trim(x).rlike(r"^\[.*\)$"))
    first = F.trim(F.get(lines, F.lit(0)))
    sentence = F.regexp_extract(first, r"^[^.!?]+[.!?]", 0)
    return F.substring(F.when(sentence != "", sentence).otherwise(first), 1, limit)


def equation_format(text: Column) -> Column:
    return (
        F.when(text.contains("<math") | text.contains("<mrow"), "mathml")
        .when(text.contains("\\") | text.contains("{") | text.contains("^") | text.contains("_"), "latex").otherwise("text")
    )


# Names and values of credentials (fixed values).
CREDENTIAL_NAME = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth[_-]?token|auth[_-]?key|bearer|credential)"
PLACEHOLDERS = (
    r"(?i)^changeme$", r"(?i)^example", r"(?i)^dummy", r"(?i)^test(?:ing)?$", r"(?i)^your[_-]", r"(?i)^xxx+$", r"(?i)^placeholder",
    r"^\$\{", r"^\{\{", r"^<[^>]+>$", r"(?i)^TODO", r"(?i)^FIXME", r"(?i)^env\.", r"(?i)^process\.env", r"(?i)^os\.environ", r"(?i)^System\.getenv",
)
MIN_CREDENTIAL = 8


def looks_like_credential(value: Column) -> Column:
    kinds = sum((value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")), F.lit(0))
    return (F.length(value) >= MIN_CREDENTIAL) & ~any_of([value.rlike(p) for p in PLACEHOLDERS]) & (kinds >= 2)


def credential_issues(lines: DataFrame) -> DataFrame:
    """(path, line_no, name): assignments of literal secrets; suppressed by a directive on the same line or the one before."""
    assign = r"([A-Za-z_][\w.-]*)[\"']?\s*[:=]+\s*[\"']([^\"']+)[\"']"
    name, value = F.regexp_extract("content", assign, 1), F.regexp_extract("content", assign, 2)
    hits = lines.withColumn("name", name).withColumn("value", value).where(
        (F.col("name") != "") & F.col("name").rlike(CREDENTIAL_NAME) & looks_like_credential(F.col("value")))
    return suppress(hits.select("path", "line_no", "name"), lines)


def suppress(issues: DataFrame, lines: DataFrame) -> DataFrame:
    """Issues without those whose line, or the line before, carries a directive: an anti join on (path, line)."""
    directive = lines.where(F.col("content").rlike(r"(?i)[a-z]+-ignore\b|nosec|eslint-disable")).select(
        "path", F.explode(F.array(F.col("line_no"), F.col("line_no") + 1)).alias("line_no"))
    return issues.join(directive, ["path", "line_no"], "left_anti")


def random_issues(lines: DataFrame) -> DataFrame:
    weak = F.col("content").contains("Math.random()") | (F.col("content").rlike(r"new Random\(|random\w*\.next[A-Z]") & ~F.lower("content").contains("secure"))
    return suppress(lines.where(weak).select("path", "line_no"), lines)
