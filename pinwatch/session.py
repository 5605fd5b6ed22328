"""Session settings, the shared scratch folder and its owner, and the package on the workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even when the next operator would need one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash instead of sort where every build partition was measured to be below this size.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}

#: Applications that already ship the package, the scratch folders this process made, and the paths that
#: open scopes have made.
_SHIPPED: set[str] = set()
_SCRATCH: dict[str, SparkSession] = {}
_SCOPES: list[list[str]] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on (time zone) and those skew handling needs; ship the package."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once. Spark serves the archive to
    the executors, so they need neither the driver's folders nor an installation."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pinwatch-package-"), "pinwatch.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine) gets a temporary folder; on a cluster that would
    be another folder on every machine, so there it is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return configured or current.get()
    if not configured and not _one_machine(context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = configured or tempfile.mkdtemp(prefix="pinwatch-")
    context.setCheckpointDir(folder)
    return folder


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the application's own part of the shared folder, removed by
    :func:`release_scratch` or when the driver ends."""
    own = f"{shared_folder(spark).rstrip('/')}/pinwatch/{spark.sparkContext.applicationId}"
    if own not in _SCRATCH:
        _SCRATCH[own] = spark
    path = f"{own}/{label}-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the stored tables that were made inside. What is to stay is written to a path made
    before it."""
    _SCOPES.append(made := [])
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def release_scratch(spark: SparkSession | None = None) -> None:
    """Remove the stored intermediate tables of ``spark``, or of every session still running. Call it
    when results that read them are written; nothing made with them can be read afterwards."""
    for path, owner in list(_SCRATCH.items()):
        if spark is not None and owner.sparkContext is not spark.sparkContext:
            continue
        del _SCRATCH[path]
        _remove(owner, path)


@atexit.register
def _release_at_exit() -> None:
    try:
        release_scratch()
    except Exception:  # the JVM may be gone already; its folder is then the cluster's to clean
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never recomputes an iterative job from its start."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each execution inside are removed when it ends, not when the driver happens to collect its
    garbage. For writes: what they shuffle is theirs alone, so nothing reads it again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    previous = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, previous)


def write_compact(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """``df`` as Parquet files that take little disk, with nothing of the way there left behind."""
    with released_shuffles(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)


def stored_table(df: DataFrame, label: str, compact: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe against lost executors,
    and of known size, so that Spark decides on broadcasts from the facts. ``compact`` is for the large ones."""
    path = scratch_path(df.sparkSession, label)
    if compact:
        write_compact(df, path)
    else:
        with released_shuffles(df.sparkSession):
            df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
