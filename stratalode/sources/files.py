"""Reading local or remote trees, listings and exports; writing the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest


def read_tree(spark: SparkSession, root: str, repo: str, max_bytes: int = ingest.MAX_FILE_BYTES) -> DataFrame:
    """The ``files`` table of a folder tree on any Hadoop file system: ignored folders, oversized, binary and non-UTF-8 files leave.

    Size and path filters are pushed to the listing: contents of dropped files are not read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9+.-]+:/+", "/"), f"^{_quote(base)}/", "")
    kept = raw.where((F.col("length") <= max_bytes) & ~ingest.is_ignored(F.col("path")))
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    out = kept.select(rel.alias("repo_relative_path"), text.alias("raw"), F.col("length").alias("bytes"), F.col("modificationTime").alias("updated_at"))
    out = out.where(F.col("raw").isNotNull() & ~F.substring("raw", 1, 8192).contains("\0"))
    body = ingest.normal_text(F.col("raw"))
    return out.select(
        F.concat(F.lit(f"repos/{repo}/norm/"), "repo_relative_path").alias("path"), F.lit(repo).alias("repo"), ingest.classify_kind(F.col("repo_relative_path")).alias("kind"),
        "repo_relative_path", F.sha2(body, 256).alias("sha256"), "bytes", body.alias("text"), "updated_at")


def _quote(s: str) -> str:
    import re

    return re.escape(re.sub(r"^[a-z0-9+.-]+:/+", "/", s))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages from JSON lines with an explicit schema; malformed lines are kept apart in ``_corrupt``."""
    schema = "url string, title string, html string, fetched_at timestamp, etag string, last_modified string, _corrupt string"
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_levels(chunks: DataFrame, root: str) -> None:
    """Chunks partitioned by level, so that a search of one level reads its files only."""
    chunks.write.mode("overwrite").partitionBy("level").parquet(root)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
