"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Jobs that run beside each other; small ones leave most cores idle.
AT_ONCE = 4
_LOCK = threading.Lock()
_WRITING = 0
_BEFORE = "false"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes in here go when each ends; the setting comes back with the last one."""
    global _WRITING, _BEFORE
    with _LOCK:
        if not _WRITING:
            _BEFORE = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _WRITING += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITING -= 1
            if not _WRITING:
                spark.conf.set(_CLEANUP, _BEFORE)


def beside(jobs: list[Callable[[], object]]) -> list:
    """The results of jobs that don't need each other, run at the same time."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in this process alone, a temporary folder of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="glyphmine-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is removed when the application ends."""
    sc = spark.sparkContext
    path = f"{shared_root(spark)}/glyphmine-{sc.applicationId}/{label}-{uuid.uuid4().hex}"
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written as a table and read again: a lost executor costs a read, not a recomputation. The write's own shuffle files go when it ends."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stage_path = path
    return table


def materialize_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """materialize() of tables that don't need each other."""
    return dict(zip(tables, beside([lambda n=n, df=df: materialize(df, n) for n, df in tables.items()]), strict=True))


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize() that nothing reads any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.stage_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers that one task takes. Spark sizes tasks and broadcasts by compressed bytes, of which sorted keys have next to none.
ROWS_AT_ONCE = 500_000
#: Rows of a written table that may be broadcast.
BROADCAST_ROWS = 100_000


def spread(rows: int) -> int:
    """Into how many partitions rows go; adaptive execution leaves a number that is given."""
    return max(1, -(-rows // ROWS_AT_ONCE))


def shuffled(table: DataFrame, rows: int) -> DataFrame:
    """A table that a join may broadcast only if it has few rows, however small its file is."""
    return table if rows <= BROADCAST_ROWS else table.hint("merge")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, on whatever file system the path names."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


_open = pyarrow.fs.FileSystem.from_uri


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that Hadoop names, and the path in it; tasks use it for files of their own."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        return _open(f"s3:{rest}")
    if scheme == "dbfs":
        return pyarrow.fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return _open(uri)
