"""Session and table helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidewheel", cores: str | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    """A session tuned for this library: AQE with skew handling, UTC, Arrow transfer."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if checkpoint_dir is not None:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", cores)
            .config("spark.driver.memory", "12g")
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    # Workers that the JVM starts on the driver find the package by this path, those of executors by ship().
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors: functions in its modules are looked up there by name."""
    context = spark.sparkContext
    if getattr(context, "_tidewheel_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()  # executors fetch from it as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "tidewheel"), "zip", root, "tidewheel"))
    context._tidewheel_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results: the one the cluster names in spark.checkpoint.dir,
    else the context's own. A local session, whose tasks all share the driver's disk, may do without;
    on a cluster a missing setting is an error, since a machine's own folder would lose files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


_SETTLED: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, deleted by release()."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _SETTLED.append((spark, path))
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    A result used several times would otherwise be computed once per use, and its lineage with
    it. The written table survives lost executors and gives the planner its true size.
    """
    spark = df.sparkSession
    path = shared_path(spark, "settled")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the session may be gone already
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that nothing will read again; other DataFrames are left alone."""
    for df in settled:
        path = getattr(df, "_settled_path", None)
        if path is not None:
            _delete(df.sparkSession, path)
            _SETTLED[:] = [held for held in _SETTLED if held[1] != path]


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Within it, jobs hand at most so many rows at once to Python: for rows that carry long texts or arrays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(held)) if int(held) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def limit_arrow_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Lower the session's Arrow batches to at most so many rows, for results with long texts that run later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if held <= 0 or held > rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Drop the folders this process wrote, on any file system; results built on them become unreadable."""
    for spark, path in _SETTLED:
        _delete(spark, path)
    _SETTLED.clear()


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, dealt out over all cores; any larger scan as it is.

    For work that costs much per row. Only the plan is inspected; no job runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
