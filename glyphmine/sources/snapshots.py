"""Source snapshots as DataFrames: one row for each file, read in parallel."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_count
from ..stage import materialize


@dataclass
class SourceSpec:
    """A snapshot to index: its source, kind, version, identifier and folder of .cs files."""

    source_id: str
    path: str
    kind: str = "loader"
    version: str | None = None
    snapshot_id: str | None = None
    meta: dict[str, str] = field(default_factory=dict)


def relative_path(path: str, root: str):
    """The column of paths below a root folder."""
    bare = root.rstrip("/").removeprefix("file:").replace("//", "/")
    return F.regexp_replace(F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))), rf"^[a-z0-9]*:?/*{bare.lstrip('/')}/", "")


def scan(spark: SparkSession, spec: SourceSpec, pattern: str = "*.cs") -> DataFrame:
    """(source_id, relative_path, filename, extension, size, sha256, line_count, content) of all files below a folder."""
    root = local_folder(spark, spec.path)
    if root is None or re.search(r"[\[\]{}\\^]", pattern):
        raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(spec.path)
        rows = raw.select(relative_path("path", spec.path).alias("relative_path"), F.col("length").alias("size"), "content")
    else:
        named = re.escape(pattern).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        rows = contents(root, listing(spark, root).filter(F.col("relative_path").rlike(rf"(?s)(\A|/){named}\z")))
    return fingerprinted(rows.select(F.lit(spec.source_id).alias("source_id"), "relative_path", "size", "content"))


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that a path without wildcards names, where it is one of the local file system (or of a mount that all machines share)."""
    sc = spark.sparkContext
    if re.search(r"[*?\[\]{}\\]", path):
        return None
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(sc._jsc.hadoopConfiguration())
    folder = fs.makeQualified(jpath).toUri().getPath()
    return folder if fs.getUri().getScheme() == "file" and os.path.isdir(folder) else None


#: Files and bytes that one task reads, and may parse, and rows of one Arrow batch. Spark's own reader gives a task 32 small files and opens each anew.
FILES_AT_ONCE, BYTES_AT_ONCE, BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20, 1000, 4 << 20
_LISTED = "name binary, relative_path string, is_folder boolean, size long, modified long"


def _hidden(name: bytes) -> bool:
    """What Spark's readers leave out."""
    return name.startswith(b".") or (name.startswith(b"_") and b"=" not in name and not name.startswith((b"_metadata", b"_common_metadata"))) or name.endswith(b"._COPYING_")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(name, relative_path, is_folder, size, modified) of the files below a local folder that Spark's readers would find, so none that is empty; modified in milliseconds. A task lists a folder, all folders of a depth at once; the driver sees no file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            for above in batch[0].to_pylist():
                with os.scandir(os.path.join(os.fsencode(root), above)) as entries:
                    for entry in entries:
                        if _hidden(entry.name):
                            continue
                        try:
                            at = entry.stat()
                        except FileNotFoundError:
                            continue
                        name = os.path.join(above, entry.name)
                        found.append((name, name.decode("utf-8", "replace"), entry.is_dir(), at.st_size, at.st_mtime_ns // 1_000_000))
                        if len(found) == 10 * BATCH_ROWS:
                            yield _batch(found)
                            found = []
        if found:
            yield _batch(found)

    folders, levels, n = spark.createDataFrame([(bytearray(),)], "name binary"), [], 1
    while n:
        level = materialize(folders.repartition(min(n, 1000)).mapInArrow(run, _LISTED), "listing")
        levels.append(level.filter("not is_folder and size > 0"))
        folders = level.filter("is_folder").select("name")
        n = folders.count()
    return reduce(DataFrame.unionByName, levels)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["name", "relative_path", "is_folder", "size", "modified"])


def contents(root: str, files: DataFrame) -> DataFrame:
    """(relative_path, size, content) of files of listing()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((paths, sizes, read), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["relative_path", "size", "content"])

        paths, sizes, read, held = [], [], [], 0
        for batch in batches:
            for name, path, size in zip(*(batch[k].to_pylist() for k in range(3)), strict=True):
                with open(os.path.join(os.fsencode(root), name), "rb") as file:
                    content = file.read()
                paths.append(path)
                sizes.append(size)
                read.append(content)
                held += len(content)
                if len(paths) == BATCH_ROWS or held > BATCH_BYTES:
                    yield made()
                    paths, sizes, read, held = [], [], [], 0
        if paths:
            yield made()

    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(n, max(files.sparkSession.sparkContext.defaultParallelism, -(-n // FILES_AT_ONCE), -(-size // BYTES_AT_ONCE))))
    return files.select("name", "relative_path", "size").repartition(tasks, "name").mapInArrow(run, "relative_path string, size long, content binary")


def fingerprinted(files: DataFrame) -> DataFrame:
    """Rows (source_id, relative_path, size, content) with filename, extension, sha256 and line_count."""
    name = F.element_at(F.split("relative_path", "/"), -1)
    return files.select(
        "source_id", "relative_path", name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"),
        "size", F.sha2("content", 256).alias("sha256"), line_count(F.decode("content", "ISO-8859-1")).alias("line_count"), "content",
    )


def scan_all(spark: SparkSession, specs: list[SourceSpec]) -> DataFrame:
    """All snapshots; a folder without files is an error."""
    parts = [scan(spark, s) for s in specs]
    for spec, part in zip(specs, parts, strict=True):
        if part.select("relative_path").isEmpty():
            raise FileNotFoundError(f"no source files for {spec.source_id} under {spec.path}")
    return reduce(DataFrame.unionByName, parts)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """One row about a folder, .git aside: file_count, total_size, latest_mtime, csharp_file_count, project_files, assembly_files."""
    root = local_folder(spark, path)
    if root is None:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    else:
        raw = listing(spark, root).select(F.concat(F.lit(root.rstrip("/") + "/"), "relative_path").alias("path"), F.col("size").alias("length"), F.timestamp_millis("modified").alias("modificationTime"))
    raw = raw.filter(~F.col("path").contains("/.git/"))
    ends = lambda *names: F.count_if(F.lower("path").rlike(rf"\.({'|'.join(names)})$"))
    return raw.agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_size"), F.date_format(F.max("modificationTime"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("latest_mtime"),
        ends("cs").alias("csharp_file_count"), ends("csproj", "sln").alias("project_files"), ends("dll").alias("assembly_files"),
    )


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of all .md files below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    return raw.select(relative_path("path", path).alias("file"), F.decode("content", "UTF-8").alias("text"))


def json_documents(spark: SparkSession, path: str, required: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """Rows of a JSON document or array; rows that are damaged or lack a required field are left out."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.dropna("any", subset=list(required)) if required else df


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)
