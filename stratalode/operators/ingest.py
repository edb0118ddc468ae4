"""Ingest: listings, filters, kinds, present versions, line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

MAX_FILE_BYTES = 512 * 1024
MAX_TOTAL_BYTES = 50 * 1024 * 1024

# Folders that a listing leaves out (fixed values).
IGNORED_DIRS = (
    ".git", "node_modules", "dist", "build", "out", ".next", ".turbo", ".cache", "coverage", "__pycache__", ".venv", "venv",
    ".idea", ".vscode", "site", "_site", "_book", "public",
)
# Names, folders and endings of documents (fixed values).
DOC_NAMES = (
    "readme", "readme.md", "license", "contributing", "contributing.md", "code_of_conduct", "code_of_conduct.md", "security",
    "security.md", "changelog", "changelog.md", "llms.txt",
)
DOC_ENDS = (".md", ".markdown", ".rst", ".txt", ".adoc")
# Lock files, test and generated file names that a code index leaves out (fixed values).
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "poetry.lock", "Pipfile.lock", "composer.lock",
    "Gemfile.lock",
)
SKIPPED_DIRS = (
    "node_modules", "dist", "build", "out", ".git", ".svn", ".hg", "__pycache__", ".pytest_cache", ".tox", "venv", ".venv", "vendor",
    "target", "coverage",
)
TEST_FILES = (
    r"(?i)[_.](test|spec)\.[jt]sx?$", r"(?i)_test\.(py|go)$", r"(?i)test_.*\.py$", r"(?i)__tests__/", r"(?i)/tests?/", r"(?i)/spec/",
)
GENERATED_FILES = (r"\.pb\.(go|ts)$", r"[._]generated\.[^.]+$", r"\.(g|freezed)\.dart$", r"\.(min|bundle)\.[jt]s$")
INDEX_MAX_BYTES = 100 * 1024


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot, lower case; empty where the name has none or only a leading one."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def present(files: DataFrame) -> DataFrame:
    """The latest row of each path. The limit of one per path is applied in each task before the shuffle.

    Null paths do not come out; ties by the greatest checksum; a null time is the oldest; copies collapse.
    """
    w = Window.partitionBy("path").orderBy(F.col("updated_at").desc_nulls_last(), F.col("sha256").desc_nulls_last())
    return files.where(F.col("path").isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def is_ignored(path: Column) -> Column:
    dirs = "|".join(d.replace(".", r"\.") for d in IGNORED_DIRS)
    return path.rlike(rf"(^|/)({dirs})/")


def classify_kind(path: Column) -> Column:
    base, ext = F.lower(basename(path)), extension(path)
    doc = (
        base.isin(*DOC_NAMES) | base.startswith("readme.") | base.startswith("license.") | path.contains("/docs/") | path.contains("/doc/")
        | ext.isin(*DOC_ENDS)
    )
    return F.when(doc, "doc").otherwise("code")


def ingest_chain(files: DataFrame, max_file: int = MAX_FILE_BYTES, max_total: int = MAX_TOTAL_BYTES) -> DataFrame:
    """(path, repo, reason, running_bytes): what ingest keeps, and why it leaves out the rest.

    In the order of paths per repository: ``size`` beyond the file limit; ``binary`` for a NUL in the first 8,192 characters;
    ``total`` once the running total passes the limit, which stops the repository; else ``kept``.
    """
    size = F.coalesce(F.col("bytes"), F.lit(0))
    base = files.select("path", "repo", size.alias("bytes"), F.substring("text", 1, 8192).contains("\0").alias("nul"), F.col("text").isNull().alias("missing"))
    first = base.withColumn("own", F.when(F.col("missing"), "unreadable").when(F.col("bytes") > max_file, "size").when(F.col("nul"), "binary"))
    # running totals in two levels, so that a repository that holds a third of all files is not sorted in one task:
    # ranges of (repo, path) are summed, their offsets are a window over few rows, and each range is summed by itself
    counted = F.when(F.col("own").isNull(), F.col("bytes")).otherwise(0)
    ranges = checkpoint(first.withColumn("counted", counted).repartitionByRange("repo", "path").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("repo").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("repo", "part").agg(F.sum("counted").alias("sum")).select("repo", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("repo", "part").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranges.withColumn("inside", F.sum("counted").over(inside))
    same = placed["repo"].eqNullSafe(offsets["repo"]) & (placed["part"] == offsets["part"])
    out = placed.join(offsets, same).select(*[placed[c] for c in placed.columns], (F.col("inside") + F.col("offset")).alias("running_bytes"))
    return out.select(
        "path", "repo", F.coalesce("own", F.when(F.col("running_bytes") > max_total, "total").otherwise("kept")).alias("reason"), "running_bytes")


def normal_text(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, "^﻿", ""), F.lit("\r\n"), F.lit("\n"))


def lines(files: DataFrame) -> DataFrame:
    """(path, repo, kind, line_no, content), all lines, numbered from 1 within the normalised text; a narrow map."""
    return files.select(
        "path", "repo", F.lower(F.trim("kind")).alias("kind"), F.posexplode(F.split(normal_text(F.col("text")), "\n")).alias("at", "content")
    ).select("path", "repo", "kind", (F.col("at") + 1).alias("line_no"), "content")


def should_index(path: Column, size: Column | None = None) -> Column:
    """Whether a code index takes the file."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    skip = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in SKIPPED_DIRS])) | basename(path).isin(*LOCK_FILES)
    for p in (*TEST_FILES, *GENERATED_FILES):
        skip = skip | path.rlike(p)
    if size is not None:
        skip = skip | (F.coalesce(size, F.lit(0)) > INDEX_MAX_BYTES)
    return ~skip


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins per key."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.col("_side").desc())
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return both.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_side")


def choose_codec(size: Column, entropy: Column) -> Column:
    """None below one KiB or for incompressible content, else by how regular it is."""
    return F.when(size < 1024, "none").when(entropy < 3, "br").when(entropy < 6, "gzip").otherwise("none")


def parser_of(path: Column) -> Column:
    e = extension(path)
    return (
        F.when(e.isin(".md", ".markdown", ".mdx"), "markdown").when(e.isin(".html", ".htm", ".xhtml"), "html")
        .when(e == ".pdf", "pdf").when(e.isin(".docx", ".pptx", ".xlsx", ".doc", ".ppt", ".xls", ".odt"), "office")
        .when(e.isin(".txt", ".rst", ".adoc", ".log", ".csv"), "text").otherwise("code")
    )


def file_changes(files: DataFrame, meta: DataFrame) -> DataFrame:
    """(path, change): full outer comparison of present files with the latest stored entry of each path."""
    w = Window.partitionBy("path").orderBy(F.col("indexed_at").desc_nulls_last(), F.col("run_id").desc_nulls_last(), F.col("sha256").desc_nulls_last())
    stored = meta.where("path is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("path", F.col("sha256").alias("stored"), F.lit(True).alias("has"))
    now = present(files.select("path", "sha256", "updated_at")).select("path", "sha256", F.lit(True).alias("is_there"))
    change = (
        F.when(F.col("is_there").isNull(), "removed").when(F.col("has").isNull(), "new")
        .when(F.col("sha256").eqNullSafe(F.col("stored")), "unchanged").otherwise("changed")
    )
    return now.join(stored, "path", "full").select("path", change.alias("change"))
