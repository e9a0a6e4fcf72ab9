"""Navigation along references and calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import location
from ..model import CodeIndex
from ..stage import materialize
from .graph import reachable

LIMIT = 50
TREE = "ord long, parent_ord long, level int, call string, status string, location string"


def _origin(idx: CodeIndex, from_source: str | None) -> DataFrame:
    s = idx.sources.select(F.col("id").alias("origin_key"), F.col("source_id").alias("from_source"))
    s = s.filter(F.col("from_source") == from_source) if from_source else s
    return idx.files.select(F.col("id").alias("file_key"), "relative_path", F.col("source_id").alias("origin_key")).join(s, "origin_key")


def _listed(hits: DataFrame, limit: int, kind: str | None = None) -> DataFrame:
    order = ["relative_path", "line", *(c for c in ("column",) if c in hits.columns), "id"]
    kinds = F.lit(kind) if kind else F.col("reference_kind")
    return hits.orderBy(*order).limit(limit).select(location(F.col("relative_path"), F.col("line")).alias("location"), kinds.alias("kind"), F.col("resolution_status").alias("status"), "from_source")


def refs_type(idx: CodeIndex, type_id: int, limit: int = LIMIT, include_all: bool = False, from_source: str | None = None, name: str | None = None) -> DataFrame:
    """(location, kind, status, from_source) of a type's uses. include_all adds unresolved uses that give the name, which carry no id."""
    r = idx.type_references
    hit = F.col("target_type_id") == type_id
    r = r.filter(hit | (F.col("target_type_id").isNull() & (F.col("target_name") == name)) if name else hit) if include_all else r.filter(hit & (F.col("resolution_status") == "resolved"))
    return _listed(r.drop("source_id").join(_origin(idx, from_source), F.col("from_file_id") == F.col("file_key")), limit)


def refs_member(idx: CodeIndex, kind: str, member_id: int, limit: int = LIMIT, include_all: bool = False, from_source: str | None = None, name: str | None = None) -> DataFrame:
    """Uses of a field or property."""
    r = idx.symbol_references
    hit = (F.col("target_id") == member_id) & (F.col("target_kind") == kind)
    r = r.filter(hit | (F.col("target_id").isNull() & (F.col("target_name") == name)) if name else hit) if include_all else r.filter(hit & (F.col("resolution_status") == "resolved"))
    r = r.withColumnRenamed("start_line", "line").withColumnRenamed("start_column", "column").drop("source_id")
    return _listed(r.join(_origin(idx, from_source), F.col("from_file_id") == F.col("file_key")), limit)


def refs_method(idx: CodeIndex, method_id: int, limit: int = LIMIT, include_all: bool = False, from_source: str | None = None, name: str | None = None) -> DataFrame:
    """Calls of a method."""
    r = idx.method_calls
    hit = F.col("callee_method_id") == method_id
    r = r.filter(hit | (F.col("callee_method_id").isNull() & (F.col("callee_name") == name)) if name else hit) if include_all else r.filter(hit & (F.col("resolution_status") == "resolved"))
    return _listed(r.drop("source_id").join(_origin(idx, from_source), F.col("file_id") == F.col("file_key")), limit, "call")


def callers(idx: CodeIndex, method_id: int, limit: int = LIMIT, include_all: bool = False, source: str | None = None, name: str | None = None, parity: bool = False) -> DataFrame:
    """(caller, status): who calls a method; calls outside methods have caller ?. source: of the caller, or, unless parity, of the file where there is none."""
    r = idx.method_calls
    hit = F.col("callee_method_id") == method_id
    r = r.filter(hit | (F.col("callee_method_id").isNull() & (F.col("callee_name") == name)) if name else hit) if include_all else r.filter(hit & (F.col("resolution_status") == "resolved"))
    m = idx.methods.select(F.col("id").alias("caller_method_id"), "signature", F.col("type_id").alias("caller_type"))
    t = idx.types.select(F.col("id").alias("caller_type"), F.col("source_id").alias("caller_key"))
    s = idx.sources.select(F.col("id").alias("caller_key"), F.col("source_id").alias("caller_source"))
    hits = r.drop("source_id").join(m, "caller_method_id", "left").join(t, "caller_type", "left").join(s, "caller_key", "left").join(_origin(idx, None), F.col("file_id") == F.col("file_key"))
    if source:
        hits = hits.filter((F.col("caller_source") if parity else F.coalesce("caller_source", "from_source")) == source)
    text = F.concat(F.when(F.col("caller_source").isNull(), "").otherwise(F.concat(F.lit("["), "caller_source", F.lit("] "))), F.coalesce("signature", F.lit("?")), F.lit("  ("), location(F.col("relative_path"), F.col("line")), F.lit(")"))
    return hits.orderBy("relative_path", "line", "column", "id").limit(limit).select(text.alias("caller"), F.col("resolution_status").alias("status"))


def call_edges(idx: CodeIndex, limit: int | None = None) -> DataFrame:
    """(src, dst): from caller to callee; limit keeps each caller's first calls by place."""
    calls = idx.method_calls.filter("caller_method_id is not null")
    if limit is not None:
        f = idx.files.select(F.col("id").alias("file_id"), "relative_path")
        place = Window.partitionBy("caller_method_id").orderBy("relative_path", "line", "column", "id")
        calls = calls.join(f, "file_id").withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= limit)
    return calls.filter("callee_method_id is not null").select(F.col("caller_method_id").alias("src"), F.col("callee_method_id").alias("dst"))


def callees_within(idx: CodeIndex, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): methods reached within 1 to 5 calls."""
    return reachable(call_edges(idx), roots, max(1, min(5, depth)))


def call_tree(idx: CodeIndex, method_id: int, depth: int = 3, limit: int = LIMIT, parity: bool = False) -> DataFrame:
    """(ord, parent_ord, level, call, status, location): calls in preorder; every method is expanded once, where the walk first meets it above the last level."""
    depth = max(1, min(5, depth))
    spark = idx.spark
    m = idx.methods.select(F.col("id").alias("callee_method_id"), F.col("type_id").alias("callee_type"))
    t = idx.types.select(F.col("id").alias("callee_type"), F.col("source_id").alias("callee_key"))
    s = idx.sources.select(F.col("id").alias("callee_key"), F.col("source_id").alias("callee_source"))
    f = idx.files.select(F.col("id").alias("file_id"), "relative_path")
    place = Window.partitionBy("caller_method_id").orderBy("relative_path", "line", "column", "id")
    frontier, parts = spark.createDataFrame([(method_id,)], "caller_method_id long"), []
    seen = frontier
    for _ in range(depth):
        calls = idx.method_calls.join(frontier, "caller_method_id", "left_semi").join(f, "file_id").withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= limit)
        part = materialize(calls.select("caller_method_id", "nth", "callee_method_id", "callee_name", "callee_signature_hint", "declaring_type_hint", "resolution_status", location(F.col("relative_path"), F.col("line")).alias("location")), "calls")
        parts.append(part)
        frontier = part.filter("callee_method_id is not null").select(F.col("callee_method_id").alias("caller_method_id")).distinct().join(seen, "caller_method_id", "left_anti")
        seen = seen.unionByName(frontier)
    calls = parts[0]
    for part in parts[1:]:
        calls = calls.unionByName(part)
    calls = calls.join(m, "callee_method_id", "left").join(t, "callee_type", "left").join(s, "callee_key", "left")
    bare = F.coalesce("callee_signature_hint", F.concat("callee_name", F.lit("()")))
    named = bare if parity else F.when(F.col("callee_method_id").isNull() & bare.startswith("("), F.concat("callee_name", bare)).otherwise(bare)
    text = F.concat(F.when(F.col("callee_source").isNull(), "").otherwise(F.concat(F.lit("["), "callee_source", F.lit("] "))), F.coalesce("declaring_type_hint", F.lit("?")), F.lit("."), named)
    # identifiers go as text: pandas would turn a column of long integers and nulls to floats, which lose digits
    rows = calls.select(F.lit(0).alias("g"), F.col("caller_method_id").cast("string").alias("src"), "nth", F.col("callee_method_id").cast("string").alias("dst"), text.alias("call"), F.col("resolution_status").alias("status"), "location")

    def walk(edges: pd.DataFrame) -> pd.DataFrame:
        below: dict[str, list] = {}
        for r in edges.sort_values(["src", "nth"]).itertuples():
            below.setdefault(r.src, []).append(r)
        out, met = [], set()

        def expand(node: str, level: int, parent: int) -> Iterator[None]:
            if level >= depth or node in met:
                return
            met.add(node)
            for r in below.get(node, []):
                out.append((len(out), parent, level, r.call, r.status, r.location))
                if not pd.isna(r.dst):
                    expand(r.dst, level + 1, len(out) - 1)

        expand(str(method_id), 0, -1)
        return pd.DataFrame(out, columns=["ord", "parent_ord", "level", "call", "status", "location"])

    return rows.groupBy("g").applyInPandas(walk, TREE)
