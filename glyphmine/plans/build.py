"""Index builds: scan, parse once, deduplicate, resolve, check, publish."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..csharp.parser import parse_source
from ..functions.text import classify_string
from ..model import CodeIndex
from ..operators.quality import validate_index
from ..operators.resolve import Rules, first_wins, resolve_inheritance
from ..schemas import TABLES
from ..sources.snapshots import SourceSpec, scan_all
from ..stage import materialize, materialize_all
from .publish import BuildError, current, publish
from .references import NODE, REFERENCES, Named, build_references, name_types

SCHEMA_VERSION = 2
_STRUCTS = {
    "types": "ordinal int, parent int, namespace string, name string, full_name string, kind string, visibility string, is_abstract int, is_static int, is_sealed int, is_compiler_generated int, start_line int, end_line int",
    "methods": "ordinal int, type int, name string, signature string, return_type string, visibility string, is_static int, is_virtual int, is_override int, is_abstract int, start_line int, end_line int",
    "fields": "type int, name string, field_type string, visibility string, is_static int, is_readonly int, is_const int, start_line int",
    "properties": "type int, name string, property_type string, visibility string, has_getter int, has_setter int, is_static int, start_line int, end_line int",
    "strings": "type int, method int, value string, line int",
    "inheritance": "type int, relation string, target_name string",
    "nodes": NODE,
}
_FILE = "source_id string, relative_path string, filename string, extension string, size long, sha256 string, line_count long"
_PARSED = _FILE + ", parse_status string, parse_error string, usings array<string>, " + ", ".join(f"{k} array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in v.split(','))}>>" for k, v in _STRUCTS.items())


#: Files and bytes of text whose declarations one Arrow batch holds, at most; a larger file is alone.
FILES_AT_ONCE, BYTES_AT_ONCE = 64, 1 << 18


def parse_files(files: DataFrame) -> DataFrame:
    """One row for each of files (see sources.snapshots.fingerprinted) with all that its text declares, nested; read and parsed once, kept as a table."""
    schema = T._parse_datatype_string(_PARSED)
    arrow = _arrow(schema)
    about = [c.strip().split(" ")[0] for c in _FILE.split(",")]
    declared = [f for f in arrow if f.name not in about]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows, read = [], 0
                while at + len(rows) < batch.num_rows and len(rows) < FILES_AT_ONCE and read < BYTES_AT_ONCE:
                    content = batch[len(about)][at + len(rows)].as_py() or b""
                    read += len(content)
                    rows.append(parse_source(content))
                known = [batch[k].slice(at, len(rows)).cast(arrow.field(c).type) for k, c in enumerate(about)]
                yield pa.RecordBatch.from_arrays(known + [pa.array([r[f.name] for r in rows], f.type) for f in declared], schema=arrow)
                at += len(rows)

    return materialize(files.select(*about, "content").mapInArrow(run, schema), "parsed")


def _arrow(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def _id(*parts: str | Column) -> Column:
    return F.xxhash64(*parts)


def declarations(spark: SparkSession, specs: list[SourceSpec], parsed: DataFrame, rules: Rules) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables of declarations, nodes with their keys). Identifiers hash what identifies a row, so rebuilds give the same ones.

    Of types with one full name in a source the first by file wins. Members of the others go with it, as parts of one type; with rules.parity they are lost.
    """
    file_id = _id(F.lit("file"), "source_id", "relative_path")
    source_key = _id(F.lit("source"), "source_id")
    sources = spark.createDataFrame([(s.source_id, s.kind, s.version, s.snapshot_id) for s in specs], "source_id string, source_kind string, version string, snapshot_id string")
    sources = sources.select(source_key.alias("id"), "source_id", "source_kind", "version", F.lit(None).cast("string").alias("content_hash"), "snapshot_id")
    file_table = parsed.select(
        file_id.alias("id"), source_key.alias("source_id"), "relative_path", "filename", "extension", "size", "sha256", "line_count", "parse_status", "parse_error", F.lit("OK").alias("reference_status"), F.lit(None).cast("string").alias("reference_error")
    )
    named = lambda full_name: F.when(full_name.isNotNull(), _id(F.lit("type"), F.col("source_id"), full_name))

    def nested(name: str, owner: str, *more: str) -> DataFrame:
        """Rows of an array with the type_id and namespace of the type whose ordinal is in owner; types stand in the order of their ordinals, so nothing is joined."""
        rows = parsed.select("source_id", "relative_path", *more, F.col("types.full_name").alias("full_names"), F.col("types.namespace").alias("namespaces"), F.posexplode(name).alias("nth", "x"))
        at = F.col(f"x.{owner}")
        return rows.select("source_id", "relative_path", *more, "nth", named(F.get("full_names", at)).alias("type_id"), F.get("namespaces", at).alias("type_namespace"), "x.*")

    all_types = nested("types", "parent").withColumnRenamed("type_id", "parent_type_id").withColumn("type_id", named(F.col("full_name")))
    kept, _ = first_wins(all_types, ["source_id", "full_name"], ["relative_path", "ordinal"])
    type_table = kept.select(
        F.col("type_id").alias("id"), source_key.alias("source_id"), file_id.alias("file_id"), "namespace", "name", "full_name", "kind", "visibility", "is_abstract", "is_static", "is_sealed", "is_compiler_generated", "parent_type_id", "start_line", "end_line"
    )

    def owned(name: str, *more: str) -> DataFrame:
        """nested() rows of members; with rules.parity those of types that were left out have no type_id."""
        rows = nested(name, "type", *more)
        if rules.parity:
            keys = ["source_id", "relative_path", "type"]
            rows = rows.join(kept.select("source_id", "relative_path", F.col("ordinal").alias("type"), F.lit(True).alias("is_kept")), keys, "left").withColumn("type_id", F.when(F.col("is_kept"), F.col("type_id"))).drop("is_kept")
        return rows

    def members(name: str, *columns: str) -> DataFrame:
        return owned(name).filter("type_id is not null").select(_id(F.lit(name), "source_id", "relative_path", "nth").alias("id"), source_key.alias("source_id"), "type_id", file_id.alias("file_id"), *columns)

    methods = members("methods", "name", "signature", "return_type", "visibility", "is_static", "is_virtual", "is_override", "is_abstract", "start_line", "end_line")
    fields = members("fields", "name", "field_type", "visibility", "is_static", "is_readonly", "is_const", "start_line")
    properties = members("properties", "name", "property_type", "visibility", "has_getter", "has_setter", "is_static", "start_line", "end_line")
    strings = owned("strings").select(
        _id(F.lit("string"), "source_id", "relative_path", "nth").alias("id"), source_key.alias("source_id"), file_id.alias("file_id"), "type_id", F.when(F.col("method").isNotNull() & F.col("type_id").isNotNull(), _id(F.lit("methods"), "source_id", "relative_path", "method")).alias("method_id"),
        "value", classify_string(F.col("value")).alias("classification"), F.col("line").alias("start_line"),
    )
    edges = owned("inheritance").filter("type_id is not null").withColumn("edge_id", _id(F.lit("edge"), "source_id", "relative_path", "nth"))
    known = kept.select("type_id", F.col("source_id").alias("source"), "full_name", "name", "namespace")
    targets = resolve_inheritance(edges.select("edge_id", "type_id", F.col("source_id").alias("source"), F.col("type_namespace").alias("namespace"), "target_name"), known, rules)
    inheritance = edges.join(targets, "edge_id", "left").select(F.col("edge_id").alias("id"), source_key.alias("source_id"), "type_id", "relation", "target_name", "target_type_id")
    nodes = owned("nodes", "usings").select(
        _id(F.lit("node"), "source_id", "relative_path", "node").alias("nid"), F.when(F.col("recv") >= 0, _id(F.lit("node"), "source_id", "relative_path", "recv")).alias("recv_nid"), "op", "name", "recv", "level", "kind", "argc", "hint", "namespace", "usings",
        F.col("source_id").alias("source"), source_key.alias("source_key"), file_id.alias("file_id"), "type_id", F.when(F.col("method").isNotNull() & F.col("type_id").isNotNull(), _id(F.lit("methods"), "source_id", "relative_path", "method")).alias("method_id"), "line", "column", "end_line", "end_column",
    )
    return dict(sources=sources, files=file_table, types=type_table, methods=methods, fields=fields, properties=properties, strings=strings, inheritance=inheritance), nodes


class Tables(dict):
    """An index's tables by name, written once in the shared folder: each when it is first asked for, those of the reference graph as far as they are asked for."""

    def __init__(self, spark: SparkSession, declared: dict[str, DataFrame], nodes: DataFrame, rules: Rules):
        super().__init__()
        self.idx, self.declared, self.nodes, self.rules = CodeIndex(spark, self), declared, nodes, rules
        self.named: Named | None = None

    def get(self, name: str, default: DataFrame | None = None) -> DataFrame | None:
        if name not in self:
            self.update(self._written(name))
        return super().get(name, default)

    def _written(self, name: str) -> dict[str, DataFrame]:
        if name in self.declared:
            return {name: materialize(self.declared[name], name)}
        if name not in REFERENCES:
            return {}
        if self.named is None:
            self.named = name_types(self.idx, self.nodes, self.rules)
        if name == "type_references":
            return {name: materialize(self.named.type_references, name)}
        found = build_references(self.idx, self.named, self.rules)
        return materialize_all({"symbol_references": found.symbol_references, "method_calls": found.method_calls})

    def fill(self) -> None:
        """Write all."""
        self.update(materialize_all({name: df for name, df in self.declared.items() if name not in self}))
        for name in REFERENCES:
            self.get(name)


def index_sources(spark: SparkSession, specs: list[SourceSpec], rules: Rules) -> CodeIndex:
    """The whole index of some snapshots; its tables are written once in the shared folder."""
    idx = index_files(spark, specs, scan_all(spark, specs), rules)[0]
    idx.tables.fill()
    return idx


def index_files(spark: SparkSession, specs: list[SourceSpec], files: DataFrame, rules: Rules) -> tuple[CodeIndex, DataFrame]:
    """(index, parsed files) of rows as sources.snapshots.fingerprinted gives them; the index's tables are made when they are asked for."""
    parsed = parse_files(files)
    declared, nodes = declarations(spark, specs, parsed, rules)
    return Tables(spark, declared, nodes, rules).idx, parsed


def parse_statistics(parsed: DataFrame) -> DataFrame:
    """(source_id, n_ok, n_partial, n_failed, n_types, n_duplicate_types): files by parse status, types kept, and types left out as an earlier file has their full name."""
    status = lambda s: F.count_if(F.col("parse_status") == s)
    files = parsed.groupBy("source_id").agg(status("OK").alias("n_ok"), status("PARTIAL").alias("n_partial"), status("FAILED").alias("n_failed"))
    named = parsed.select("source_id", F.explode("types.full_name").alias("full_name")).groupBy("source_id", "full_name").agg(F.count("*").alias("n"))
    types = named.groupBy("source_id").agg(F.count("*").alias("n_types"), F.sum(F.col("n") - 1).alias("n_duplicate_types"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.join(types, "source_id", "left").select("source_id", "n_ok", "n_partial", "n_failed", zero("n_types"), zero("n_duplicate_types"))


def identity(specs: list[SourceSpec]) -> dict[str, str]:
    """What an index is built from, as its meta table keeps it."""
    found = {"schema_version": str(SCHEMA_VERSION), "versions": ";".join(sorted(f"{s.source_id}={s.version}" for s in specs))}
    return found | {f"snapshot:{s.source_id}": s.snapshot_id or "" for s in specs} | {f"{s.source_id}:{k}": v for s in specs for k, v in s.meta.items()}


def build_index(spark: SparkSession, specs: list[SourceSpec], path: str, rules: Rules | None = None, validate: dict | None = None, built_at: str | None = None) -> str:
    """Build and publish under path; CREATED, or UNCHANGED if what is there has the same identity. A build that fails its rules leaves what was there."""
    rules = rules or Rules(primary=specs[0].source_id)
    wanted = identity(specs)
    where = current(spark, path)
    if where is not None:
        meta = {r.key: r.value for r in spark.read.schema(TABLES["meta"]).parquet(f"{where}/meta").collect()}
        if {k: v for k, v in meta.items() if k != "built_at"} == wanted:
            return "UNCHANGED"
    idx = index_sources(spark, specs, rules)
    report = validate_index(idx, **(validate or {}))
    stamp = spark.sql("SELECT date_format(to_utc_timestamp(current_timestamp(), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").first()[0]
    meta = spark.createDataFrame([*wanted.items(), ("built_at", built_at or stamp)], TABLES["meta"])
    publish(spark, path, {**idx.tables, "meta": meta}, report.filter("not ok").select("rule", "subject", "detail"))
    return "CREATED"


__all__ = ["BuildError", "build_index", "declarations", "identity", "index_files", "index_sources", "parse_files", "parse_statistics"]
