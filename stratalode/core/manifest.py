"""Incremental processing against a manifest of what earlier runs finished.

One comparison (:func:`unprocessed`, the anti-join of a listing with a manifest on path, size and checksum) serves two layers:

* :func:`pending` reads the manifest out of a table of entries and a table of runs: what *successful* runs left behind;
* :class:`ManifestStore` keeps it durably: plan -> write under the batch's own folder -> commit.

A run evaluates its listing once: the plan is written to the shared folder first, and the batch's name, its processing and its
commit all read that copy, so a file that arrives meanwhile is left to the next run. A batch's name follows from its content; each
attempt writes its own folder below the batch's, and only the commit, the exclusive creation of one small file, makes an attempt
count. Of two writers that plan on the same version one creates the file and the other fails without having changed anything.
Commits are deltas (the rows of their batch), folded into a snapshot every ``COMPACT`` commits, so a commit costs what changed.

Defined results for dirty input:

* several rows of one key in the listing: the one with the greatest order value counts (ties: greatest checksum,
  a null order value is the oldest); exact copies collapse;
* entries of runs that did not succeed, of unknown runs and of a null run are ignored;
* the latest entry by time counts (ties: greatest run id, then greatest checksum); a null time is the oldest;
* a null checksum on one side never equals a known one: the key is processed again; null on both sides is equal;
  a size that the manifest does not know is not compared;
* rows with a null key are not addressable and never come out;
* empty listing: empty result; empty history: every key comes out as ``new``;
* several states of one path in a listing given to the store: the greatest (checksum, size) counts;
* other columns, whatever their names, are neither read nor carried.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _latest(df: DataFrame, key: Column, checksum: Column, *order: Column) -> DataFrame:
    """One row per key: the checksum of the greatest (order..., checksum). Partial aggregation, one shuffle."""
    slim = df.select(
        key.alias("key"),
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], checksum.alias("sum")).alias("version"),
    ).where(F.col("key").isNotNull())
    return slim.groupBy("key").agg(F.max("version").alias("version"))


def unprocessed(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of the listing (path, bytes, checksum) that the manifest does not hold in this state."""
    seen = manifest.select(F.col("path").alias("_p"), F.col("bytes").alias("_b"), F.col("checksum").alias("_c"))
    same = (
        (F.col("path") == F.col("_p")) & (F.col("_b").isNull() | (F.col("bytes") == F.col("_b"))) & F.col("checksum").eqNullSafe(F.col("_c"))
    )
    return listing.join(seen, same, "left_anti")


def present(listing: DataFrame, *, key="path", checksum="sha256", size: str | None = None, listed_at="updated_at") -> DataFrame:
    """(path, bytes, checksum) of the present row of every key."""
    both = F.struct(F.col(checksum).alias("c"), (F.col(size) if size else F.lit(None)).cast("bigint").alias("b"))
    now = _latest(listing, F.col(key), both, F.col(listed_at))
    return now.select(F.col("key").alias("path"), F.col("version.sum.b").alias("bytes"), F.col("version.sum.c").alias("checksum"))


def finished(
    entries: DataFrame, runs: DataFrame, *, key="path", checksum="sha256", entered_at="indexed_at", run="run_id", status="status", success="succeeded",
) -> DataFrame:
    """(path, bytes, checksum) of the latest entry of a successful run for every key. Sizes are not known here.

    The runs filter is a semi join that Catalyst broadcasts only while the run table is below the session's threshold.
    """
    done_runs = runs.where((F.col(status) == success) & F.col(run).isNotNull()).select(run).distinct()
    done = _latest(
        entries.select(key, checksum, entered_at, run).join(done_runs, run, "left_semi"), F.col(key), F.col(checksum), F.col(entered_at), F.col(run))
    return done.select(F.col("key").alias("path"), F.lit(None).cast("bigint").alias("bytes"), F.col("version.sum").alias("checksum"))


def pending(
    listing: DataFrame, entries: DataFrame, runs: DataFrame, *, key="path", checksum="sha256", listed_at="updated_at", entered_at="indexed_at",
    run="run_id", status="status", success="succeeded",
) -> DataFrame:
    """(key, checksum, state) of the keys that are ``new`` or ``changed`` since the last successful run.

    Both sides are reduced by key with map-side combine before the anti-join, which reuses the aggregation's partitioning.
    """
    done = finished(entries, runs, key=key, checksum=checksum, entered_at=entered_at, run=run, status=status, success=success)
    todo = unprocessed(present(listing, key=key, checksum=checksum, listed_at=listed_at), done)
    known = done.select("path", F.lit(True).alias("_known"))
    state = F.when(F.col("_known"), "changed").otherwise("new")
    return todo.join(known, "path", "left").select(F.col("path").alias(key), F.col("checksum").alias(checksum), state.alias("state"))


class Conflict(RuntimeError):
    """Another run committed first; nothing of this one counts and it may simply be repeated."""


class ManifestStore:
    """Durable manifest in a shared folder, on any Hadoop file system whose ``create`` without overwrite is exclusive.

    Layout: ``root/commits/<n>.json`` what version n adds, named below; ``root/manifest/<name>/`` parquet rows (path, bytes, checksum,
    batch_id, attempt) of a delta or a snapshot; ``root/data/batch_id=<id>/attempt=<uuid>/`` the output of one attempt at a batch.
    """

    SCHEMA = "path string, bytes bigint, checksum string, batch_id string, attempt string"
    COMPACT = 32
    LEASE = 600.0

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- versions

    def _read(self, path: str) -> dict | None:
        p = self._path(path)
        stream = self._fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) if text else None  # empty: its writer is gone or still at it

    def _log(self) -> tuple[list[dict], int]:
        """The commits since the last snapshot, that one included, in order (at most ``COMPACT`` and some), and the next number.

        A commit file without content belongs to a writer that is at it, so its number stays taken, or, ``LEASE`` seconds
        later, to one that died: its number is passed over.
        """
        base = self._path(f"{self.root}/commits")
        if not self._fs.exists(base):
            return [], 1
        files = sorted(((s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(base)), reverse=True)
        out, number = [], None
        for n, changed in files:
            if not n.endswith(".json"):
                continue
            c = self._read(f"{self.root}/commits/{n}")
            if number is None:
                number = int(n[:-5]) + (c is not None or time.time() - changed / 1000 > self.LEASE)
            if c:
                out.append(c | {"version": int(n[:-5])})
                if c["kind"] == "snapshot":
                    break
        return out[::-1], number or 1

    def version(self) -> int:
        log, _ = self._log()
        return log[-1]["version"] if log else 0

    def _state(self) -> tuple[int, DataFrame, int]:
        """(number of the next commit, manifest, deltas since the snapshot), all of one look at the log."""
        log, number = self._log()
        if not log:
            return number, self.spark.createDataFrame([], self.SCHEMA), 0
        parts = [
            self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/manifest/{c['rows']}").withColumn("_v", F.lit(c["version"])) for c in log
        ]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) > 1:
            last = F.max(F.struct("_v", "bytes", "checksum", "batch_id", "attempt")).alias("r")
            rows = rows.groupBy("path").agg(last).select("path", "r.bytes", "r.checksum", "r.batch_id", "r.attempt")
        deltas = sum(c["kind"] == "delta" for c in log)
        return number, rows.select("path", "bytes", "checksum", "batch_id", "attempt"), deltas

    def manifest(self) -> DataFrame:
        return self._state()[1]

    def _claim(self, version: int, kind: str, rows: str) -> None:
        """The commit: exclusive creation of the version's file."""
        path = self._path(f"{self.root}/commits/{version:012d}.json")
        self._fs.mkdirs(path.getParent())
        try:
            stream = self._fs.create(path, False)
        except Exception as e:
            raise Conflict(f"another run committed version {version}") from e
        try:
            stream.write(bytearray(json.dumps({"kind": kind, "rows": rows}).encode()))
        finally:
            stream.close()

    # -- runs

    def plan(self, listing: DataFrame) -> DataFrame:
        """Rows of the listing (path, bytes, checksum) that no committed batch has processed in this state."""
        return self._plan(listing, self.manifest())

    @staticmethod
    def _plan(listing: DataFrame, manifest: DataFrame) -> DataFrame:
        now = listing.select("path", F.col("bytes").cast("bigint"), "checksum").where("path is not null")
        now = now.groupBy("path").agg(F.max(F.struct("checksum", "bytes")).alias("s")).select("path", "s.bytes", "s.checksum")
        return unprocessed(now, manifest)

    @staticmethod
    def batch_id(todo: DataFrame) -> str:
        """Follows from what the batch holds: an order-free sum of row hashes and the count."""
        row = todo.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("path", "bytes", "checksum").cast("decimal(38,0)")).cast("string").alias("h"),
        ).first()
        return hashlib.sha256(json.dumps([row["n"], row["h"]]).encode()).hexdigest()[:24]

    def attempt_path(self, batch: str, attempt: str) -> str:
        return f"{self.root}/data/batch_id={batch}/attempt={attempt}"

    def run(self, listing: DataFrame, process: Callable[[DataFrame], DataFrame] | None) -> str | None:
        """One incremental run; returns the batch's id, or None where nothing was to do.

        ``process`` maps the planned rows (path, bytes, checksum) to output rows that keep ``path``; None takes the rows over as
        processed elsewhere (an import). A failure before the commit leaves the manifest as it was: the next run plans the same
        rows under the same batch id and writes an attempt of its own. A failure after it repeats nothing.
        """
        number, known, deltas = self._state()
        attempt = uuid.uuid4().hex
        plan = f"{self.root}/_plans/{attempt}"
        self._plan(listing, known).write.parquet(plan)  # the only evaluation of the listing
        todo = self.spark.read.schema("path string, bytes bigint, checksum string").parquet(plan)
        try:
            if todo.isEmpty():
                return None
            batch = self.batch_id(todo)
            if process is not None:
                out = process(todo)
                if "path" not in out.columns:
                    raise ValueError("the output must keep the path of the record it comes from")
                out.write.parquet(self.attempt_path(batch, attempt))
            rows = todo.select("*", F.lit(batch).alias("batch_id"), F.lit(attempt).alias("attempt"))
            rows.write.parquet(f"{self.root}/manifest/{attempt}")
            self._claim(number, "delta", attempt)
        finally:
            self._fs.delete(self._path(plan), True)
        if deltas + 1 >= self.COMPACT:
            self.compact()
        return batch

    def compact(self) -> None:
        """Folds the log into one snapshot; given up where another run commits meanwhile."""
        number, rows, deltas = self._state()
        if deltas:
            name = f"snapshot-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/manifest/{name}")
            try:
                self._claim(number, "snapshot", name)
            except Conflict:
                self._fs.delete(self._path(f"{self.root}/manifest/{name}"), True)

    def output(self) -> DataFrame:
        """The output of the present state of every path: superseded rows, lost attempts and uncommitted batches do not count."""
        if not self._fs.exists(self._path(f"{self.root}/data")):
            raise FileNotFoundError("no committed batch")
        data = self.spark.read.option("basePath", f"{self.root}/data").parquet(f"{self.root}/data/*/*")
        return data.join(self.manifest().select("path", "batch_id", "attempt"), ["path", "batch_id", "attempt"], "left_semi").drop("attempt")
