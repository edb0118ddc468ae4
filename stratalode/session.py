"""Session helpers: table loading, shipping the package to executors, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}


def local_session(cores: int | str = 8, app: str = "stratalode", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were started elsewhere.

    Every caller of an Arrow function goes through here; the archive is built once per Spark application.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(), f"stratalode_{app}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("stratalode", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED[app] = path
    else:  # already running from an archive
        _SHIPPED[app] = root


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through reliable storage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) is a folder of our own used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
        _drop_at_exit(spark, sc._jsc.sc().getCheckpointDir().get())
    return df.checkpoint(eager)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables; a folder of this machine only where all of Spark is on it."""
    own = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not own and not spark.sparkContext.master.startswith(("local[", "local-cluster[")) and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    return own or os.path.join(tempfile.gettempdir(), "stratalode-checkpoints")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input that has fewer splits than the cluster has cores, dealt out evenly before a costly row-wise step.

    Large inputs have more splits than cores and stay as they are: no shuffle. Plans that shuffle anyway are left alone.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
