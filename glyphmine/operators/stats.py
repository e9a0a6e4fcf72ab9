"""Counts and shares over an index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CodeIndex
from ..schemas import STATUSES, TABLES

ENTITIES = tuple("files types methods fields properties strings".split())


def row_counts(idx: CodeIndex) -> DataFrame:
    """(table, n) of every table but meta."""
    return reduce(DataFrame.unionByName, (getattr(idx, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t in TABLES if t != "meta"))


def status_counts(idx: CodeIndex) -> DataFrame:
    """(what, status, n): parse and reference status of files, resolution status of calls and member references."""
    parts = [("parse", idx.files, "parse_status"), ("reference", idx.files, "reference_status"), ("call", idx.method_calls, "resolution_status"), ("member", idx.symbol_references, "resolution_status")]
    return reduce(DataFrame.unionByName, (df.groupBy(F.col(c).alias("status")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "status", "n") for what, df, c in parts))


def resolution_shares(calls: DataFrame) -> DataFrame:
    """One row: total and, for each status, its count and its per mille of the total; 0 where there are none."""
    counts = calls.agg(F.count("*").alias("total"), *(F.count_if(F.col("resolution_status") == s).alias(s) for s in STATUSES))
    whole = F.greatest(F.col("total"), F.lit(1))
    return counts.select("total", *STATUSES, *(F.floor(F.col(s) * 1000 / whole).cast("long").alias(f"{s}_per_mille") for s in STATUSES))


def per_source(idx: CodeIndex) -> DataFrame:
    """(source_id, files, types, methods, fields, properties, strings), zeros where a source has none."""
    out = idx.sources.select("id", "source_id")
    for name in ENTITIES:
        counts = getattr(idx, name).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias(name))
        out = out.join(counts, "id", "left")
    return out.select("source_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ENTITIES))


def cross_source(idx: CodeIndex) -> DataFrame:
    """(from_source, to_source, kind, n): resolved edges between different sources; kinds are type, call and member."""
    origin = idx.files.select(F.col("id").alias("file_id"), F.col("source_id").alias("from_key"))
    owner = idx.types.select(F.col("id").alias("type_id"), F.col("source_id").alias("to_key"))
    done = F.col("resolution_status") == "resolved"
    types = idx.type_references.filter(done).select(F.col("from_file_id").alias("file_id"), F.col("target_type_id").alias("type_id"), F.lit("type").alias("kind"))
    calls = idx.method_calls.filter(done).join(idx.methods.select(F.col("id").alias("callee_method_id"), "type_id"), "callee_method_id").select("file_id", "type_id", F.lit("call").alias("kind"))
    members = [
        idx.symbol_references.filter(done & (F.col("target_kind") == kind)).join(table.select(F.col("id").alias("target_id"), "type_id"), "target_id").select(F.col("from_file_id").alias("file_id"), "type_id", F.lit("member").alias("kind"))
        for kind, table in (("field", idx.fields), ("property", idx.properties))
    ]
    edges = reduce(DataFrame.unionByName, (types, calls, *members)).join(origin, "file_id").join(owner, "type_id").filter("from_key != to_key")
    counts = edges.groupBy("from_key", "to_key", "kind").agg(F.count("*").alias("n"))
    a = idx.sources.select(F.col("id").alias("from_key"), F.col("source_id").alias("from_source"))
    b = idx.sources.select(F.col("id").alias("to_key"), F.col("source_id").alias("to_source"))
    return counts.join(a, "from_key").join(b, "to_key").select("from_source", "to_source", "kind", "n")
