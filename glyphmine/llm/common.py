"""Pieces that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..stage import discard, materialize, shared_path, shared_root

__all__ = ["discard", "file_system", "join_checked", "lean", "materialize", "shared_path", "shared_root", "small_enough", "tuned", "whole"]

#: Largest table, in estimated bytes, that is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of an Arrow batch between the JVM and Python, whatever the texts' lengths.
BATCH_BYTES = 4 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def tuned(df: DataFrame) -> DataFrame:
    """df, after bounding its session's Arrow batches in bytes where that is as Spark sets it: many long texts in a batch wouldn't fit a task."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df


def _release() -> None:
    gc.collect()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map function whose worker gives its memory back when the task ends; idle workers wait beside those of later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from f(batches)
        finally:
            _release()

    return run


def small_enough(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast, by its row count (read from the Parquet footers)."""
    return table.count() * row_bytes <= limit


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a written table: by broadcast up to limit bytes, by shuffle beyond."""
    return big.join(F.broadcast(small) if small_enough(small, row_bytes, limit) else small, on, how)


def whole(df: DataFrame, name: str) -> Column:
    """An id column as a long. A value that isn't a whole number of 64 bits raises an error, whatever spark.sql.ansi.enabled says, as a null would lose its row."""
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, IntegralType):
        return column.cast("long")
    number = column.try_cast("long")
    same = number.cast("string") == column if isinstance(kind, StringType) else number == column
    wrong = F.raise_error(F.concat(F.lit(f"{name} must hold whole numbers of 64 bits, not "), column.cast("string")))
    return F.when(column.isNull(), F.lit(None).cast("long")).when(F.coalesce(same, F.lit(False)), number).otherwise(wrong.cast("long"))


_open = pyarrow.fs.FileSystem.from_uri


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that Hadoop names, and the path in it; tasks use it for spilled pieces."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        return _open(f"s3:{rest}")
    if scheme == "dbfs":
        return pyarrow.fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return _open(uri)
