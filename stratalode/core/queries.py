"""Queries of the general problems, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, workspace
from .manifest import ManifestStore, finished, pending, present


def _store(spark: SparkSession, d: str) -> ManifestStore:
    """A manifest that has taken over what the successful runs processed."""
    store = ManifestStore(spark, workspace(spark, "manifest"))
    store.run(finished(table(spark, d, "file_meta"), table(spark, d, "index_runs")), None)
    return store


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).plan(present(table(spark, d, "files"))).select("path")


def p7_states(spark: SparkSession, d: str) -> DataFrame:
    """Files per state, with those of which nothing is to do."""
    todo = pending(table(spark, d, "files"), table(spark, d, "file_meta"), table(spark, d, "index_runs"))
    return todo.groupBy("state").agg(F.count("*").alias("files"))


def p7_output(spark: SparkSession, d: str) -> DataFrame:
    """What two incremental runs leave: the first meets the oldest row of every file, the second the present ones."""
    files = table(spark, d, "files").where("path is not null")
    oldest = files.groupBy("path").agg(F.min(F.struct("updated_at", "sha256", "bytes")).alias("r")).select("path", "r.bytes", F.col("r.sha256").alias("checksum"))
    store = ManifestStore(spark, workspace(spark, "manifest"))
    texts = files.select("path", F.col("sha256").alias("checksum"), F.length("text").alias("characters"))

    def measure(todo: DataFrame) -> DataFrame:
        same = texts["path"].eqNullSafe(todo["path"]) & texts["checksum"].eqNullSafe(todo["checksum"])
        found = texts.join(todo, same, "left_semi")
        return found.groupBy("path", "checksum").agg(F.max("characters").alias("characters"))

    store.run(oldest, measure)
    store.run(present(files, size="bytes"), measure)
    return store.output().select("path", "checksum", "characters")


_PENDING_SQL = """
WITH present AS (
  SELECT path, sha256 FROM (
    SELECT path, sha256, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST, sha256 DESC NULLS LAST) AS rn
    FROM files WHERE path IS NOT NULL) WHERE rn = 1),
done AS (
  SELECT path, sha256 FROM (
    SELECT m.path, m.sha256,
           row_number() OVER (PARTITION BY m.path ORDER BY m.indexed_at DESC NULLS LAST, m.run_id DESC, m.sha256 DESC NULLS LAST) AS rn
    FROM file_meta m WHERE m.run_id IN (SELECT run_id FROM index_runs WHERE status = 'succeeded')) WHERE rn = 1),
todo AS (
  SELECT p.path, CASE WHEN d.path IS NULL THEN 'new' ELSE 'changed' END AS state
  FROM present p LEFT JOIN done d ON p.path = d.path
  WHERE d.path IS NULL OR d.sha256 IS DISTINCT FROM p.sha256)
"""

QUERIES = {"p7_found": p7_found, "p7_states": p7_states, "p7_output": p7_output}
ORACLES = {
    "p7_found": _PENDING_SQL + "SELECT path FROM todo",
    "p7_states": _PENDING_SQL + "SELECT state, count(*) AS files FROM todo GROUP BY state",
    "p7_output": _PENDING_SQL + """
SELECT f.path, f.sha256 AS checksum, max(length(f.text)) AS characters
FROM files f JOIN present p ON p.path = f.path AND p.sha256 IS NOT DISTINCT FROM f.sha256 GROUP BY f.path, f.sha256""",
}
