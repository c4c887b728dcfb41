"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# bars with nanosecond timestamps are refused without it; a cluster that reads such files sets it too
NANOS_AS_LONG = "spark.sql.legacy.parquet.nanosAsLong"

# with it, what a query shuffled is deleted when it ends
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[str] = []
_cleaning: list[str | None] = []
_lock = threading.Lock()


def local_session(app: str = "barloom", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config(NANOS_AS_LONG, "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's `spark.checkpoint.dir`.

    Only a local session that names none gets a temporary folder; on a cluster that would
    not be shared by the executors.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="barloom-")
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process wrote so far; returns how many there were.

    Call it when the frames made so far are no longer read: they keep no other copy of what is deleted.
    """
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What queries that start inside shuffle is deleted when each ends, not when the driver next collects garbage.

    Meant for writes, whose plans nobody runs again. The session's own setting is back once the last thread has left.
    """
    with _lock:
        _cleaning.append(None if _cleaning else spark.conf.get(SHUFFLE_CLEANUP, "false"))
        if len(_cleaning) == 1:
            spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            if len(_cleaning) == 1:
                spark.conf.set(SHUFFLE_CLEANUP, _cleaning[0])
                _cleaning.clear()
            else:
                _cleaning.pop()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back, which also cuts its lineage."""
    return materialize_parts([df], name)


def materialize_parts(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """Like `materialize` for the rows of all parts; what one part shuffles is deleted before the next one is written."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = scratch_path(spark, name)
    for part in parts:
        with shuffles_deleted(spark):
            part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def rewrite(df: DataFrame, name: str, old: str | None = None) -> tuple[DataFrame, str]:
    """Like `materialize`, with the folder; `old`, which only `df` still reads, is deleted when `df` is written."""
    found, path = materialize(df, name), _written[-1]
    discard(df.sparkSession, old)
    return found, path


def discard(spark: SparkSession, folder: str | None) -> None:
    """Delete an intermediate table that this process wrote and nothing reads any more."""
    if folder in _written:
        _written.remove(folder)
        _delete(spark, folder)
