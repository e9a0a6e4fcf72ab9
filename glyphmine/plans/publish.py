"""Staged builds: tables are sorted and written beside the current ones, checked, and then a one-line pointer moves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..stage import beside

POINTER = "CURRENT"
#: What each table is sorted by: the column its lookups give, so that Parquet's statistics leave most row groups unread.
SORTED = {
    "files": "relative_path", "types": "full_name", "methods": "type_id", "fields": "type_id", "properties": "type_id", "inheritance": "target_type_id", "strings": "value",
    "symbol_references": "target_id", "method_calls": "callee_method_id", "type_references": "target_type_id",
}


class BuildError(RuntimeError):
    """A build that didn't pass its checks; what was published before stays."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def current(spark: SparkSession, root: str) -> str | None:
    """The folder that the pointer names, None without one."""
    jvm, fs, pointer = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    name = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    stream.close()
    return f"{root}/{name}"


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], problems: DataFrame | None = None, keep: int = 2, files: int | None = None) -> str:
    """Write tables as <root>/build-<id>/<name>, refuse if problems has rows, move the pointer, drop all builds but the last keep."""
    name = f"build-{uuid.uuid4().hex}"

    def laid_out(table: str) -> DataFrame:
        df = tables[table]
        if files:
            return df.coalesce(files)
        return df.repartitionByRange(SORTED[table]).sortWithinPartitions(SORTED[table]) if table in SORTED else df

    beside([lambda t=table: laid_out(t).write.parquet(f"{root}/{name}/{t}") for table in tables])
    if problems is not None:
        found = problems.take(20)
        if found:
            _, fs, path = _fs(spark, f"{root}/{name}")
            fs.delete(path, True)
            raise BuildError("; ".join(" ".join(str(v) for v in r) for r in found))
    jvm, fs, pointer = _fs(spark, f"{root}/{POINTER}")
    held = jvm.org.apache.hadoop.fs.Path(f"{root}/.{POINTER}-{name}")
    out = fs.create(held, True)
    out.write(bytearray(name.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(held, pointer, overwrite)
    builds = sorted((s for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(root)) if s.getPath().getName().startswith("build-")), key=lambda s: -s.getModificationTime())
    for old in [s.getPath() for s in builds if s.getPath().getName() != name][max(0, keep - 1) :]:
        fs.delete(old, True)
    return f"{root}/{name}"
