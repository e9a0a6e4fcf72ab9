"""The reference graph from all files' expression nodes, level by level.

Nodes without a receiver are resolved first, all at once; then those whose receiver is one level below, and so on, so a chain a.b().c takes three rounds over
the whole corpus. Every round is joins on small keys: distinct (type, member) and (type, method, arguments) lookups are resolved once however
many places ask. Nothing is broadcast by hand.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_external_name, logical_key, strip_generics
from ..model import CodeIndex
from ..operators.resolve import Rules, Scope, declared_types, resolve_members, resolve_methods, resolve_types, scope, type_names
from ..stage import materialize, materialize_all

NODE = "node int, op string, name string, recv int, level int, kind string, argc int, hint string, namespace string, type int, method int, line int, column int, end_line int, end_column int"


@dataclass
class References:
    symbol_references: DataFrame
    method_calls: DataFrame
    type_references: DataFrame


def _results(df: DataFrame) -> DataFrame:
    return df.select("nid", F.col("type_id").cast("long").alias("res_type"), F.col("ext").cast("string").alias("res_ext"))


#: Index tables of the graph.
REFERENCES = ("symbol_references", "method_calls", "type_references")


@dataclass
class Named:
    """Nodes whose types and bare names have been sought: what the rest of the graph needs, and the references to types."""

    looked: Scope
    nodes: DataFrame
    direct: DataFrame
    as_type: DataFrame
    lost: DataFrame
    type_references: DataFrame


def _base() -> Column:
    return F.regexp_replace(strip_generics(F.col("name")), r"(\?|\*|\[[,\s]*\])+$", "")


def _place() -> list:
    return ["source_key", F.col("file_id").alias("from_file_id"), F.col("type_id").alias("from_type_id"), F.col("method_id").alias("from_method_id")]


def _owners(types: DataFrame) -> DataFrame:
    return types.select(F.col("type_id").alias("owner_id"), F.col("full_name").alias("owner_full"), F.col("source").alias("owner_source"))


def name_types(idx: CodeIndex, nodes: DataFrame, rules: Rules) -> Named:
    """The types and bare names of nodes: the columns of NODE with nid, recv_nid, source (name), source_key, file_id, usings, type_id and method_id."""
    types = type_names(idx)
    looked = scope(idx, rules)
    looked.chain, nodes = materialize_all({"chain": looked.chain, "nodes": nodes}).values()

    # types and bare names
    asking = nodes.filter(F.col("op").isin("type", "type_if_known", "ident")).withColumn("req", F.xxhash64("source", "namespace", F.array_join("usings", "|"), F.coalesce("type_id", F.lit(0)), "name"))
    requests = asking.select("req", "source", "namespace", "usings", F.col("type_id").alias("current_type"), F.col("name").alias("text")).dropDuplicates(["req"])
    answers = materialize(resolve_types(requests, types, looked.chain, rules).select("req", F.col("status").alias("t_status"), F.col("type_id").alias("t_id")), "types")
    named = asking.join(answers, "req").join(_owners(types).withColumnRenamed("owner_id", "t_id"), "t_id", "left")
    direct = named.filter("op != 'ident'")
    seen = direct.filter((F.col("op") == "type") | F.col("t_status").isin("resolved", "external"))
    bare = named.filter("op = 'ident'")
    as_type = bare.filter("t_status = 'resolved'")
    type_refs = seen.unionByName(as_type).select(
        F.col("nid").alias("id"), F.col("source_key").alias("source_id"), *_place()[1:], F.col("t_id").alias("target_type_id"), F.coalesce("owner_full", _base()).alias("target_name"), F.when(F.col("op") == "ident", "type_use").otherwise(F.col("kind")).alias("reference_kind"), "line", F.col("t_status").alias("resolution_status")
    )
    return Named(looked, nodes, direct, as_type, bare.filter("t_status != 'resolved'"), type_refs)


def build_references(idx: CodeIndex, named: Named, rules: Rules) -> References:
    """The whole graph of named nodes."""
    none = F.lit(None)
    types = type_names(idx)
    names = _owners(types)
    looked, nodes, direct, as_type, lost = named.looked, named.nodes, named.direct, named.as_type, named.lost
    mine = lost.filter("t_status = 'unresolved' and type_id is not null")
    members = resolve_members(mine.select("type_id", "name"), idx, looked).filter("status = 'resolved'")
    implicit = materialize(lost.join(members.drop("status").withColumnRenamed("kind", "m_kind"), ["type_id", "name"], "left"), "implicit")
    used = F.exists("usings", lambda u: is_external_name(u, rules.roots))
    declared = declared_types(implicit.filter("member_id is not null").select("owner_id", F.col("member_type").alias("text")), types, rules)
    typed = implicit.join(declared.withColumnRenamed("text", "member_type").withColumnRenamed("type_id", "d_id").withColumnRenamed("external", "d_ext"), ["owner_id", "member_type"], "left")
    outside = F.when(F.col("member_id").isNotNull(), F.col("d_ext")).when((F.col("t_status") == "external") | used, F.col("name"))
    own = nodes.filter("op = 'this'").select("nid", "type_id", none.alias("ext"))
    parents = looked.chain.filter("pos = 1").select(F.col("root").alias("type_id"), F.col("node").alias("parent"))
    above = nodes.filter("op = 'base'").join(parents, "type_id", "left").select("nid", F.col("parent").alias("type_id"), none.alias("ext"))
    foreign = nodes.filter("op = 'external'").select("nid", none.alias("type_id"), F.col("name").alias("ext"))
    first = [
        direct.select("nid", F.col("t_id").alias("type_id"), F.when(F.col("t_status") == "external", _base()).alias("ext")), as_type.select("nid", F.col("t_id").alias("type_id"), none.alias("ext")),
        typed.select("nid", F.col("d_id").alias("type_id"), outside.alias("ext")), own, above, foreign,
    ]
    results = materialize(reduce(DataFrame.unionByName, map(_results, first)), "results")
    place = _place()
    span = [F.col("line").alias("start_line"), F.col("column").alias("start_column"), "end_line", "end_column"]
    owner = names.withColumnRenamed("owner_id", "of_id")
    symbols = [
        implicit.filter("member_id is not null").withColumn("of_id", F.col("owner_id")).drop("owner_full", "owner_source").join(owner, "of_id").select(
            "nid", *place, F.col("m_kind").alias("target_kind"), F.col("name").alias("target_name"), "name", F.col("member_id").alias("target_id"), F.col("kind").alias("reference_kind"), *span, F.lit("resolved").alias("resolution_status"), "owner_full", "owner_source"
        )
    ]
    calls = []

    # members and calls, by level
    deepest = nodes.filter(F.col("op").isin("member", "call", "ctor")).agg(F.max("level")).first()[0]
    for level in range(0 if deepest is None else deepest + 1):
        here = nodes.filter((F.col("level") == level) & F.col("op").isin("member", "call", "ctor"))
        got = here.join(results.withColumnRenamed("nid", "recv_nid"), "recv_nid", "left").withColumn("on", F.when(F.col("recv") == -2, F.col("type_id")).otherwise(F.col("res_type")))
        got = materialize(got.withColumn("lookup", F.when(F.col("on").isNotNull(), "type").when(F.col("res_ext").isNotNull(), "external").otherwise("unknown")), "level")
        found_members = resolve_members(got.filter("op = 'member' and on is not null").select(F.col("on").alias("type_id"), "name"), idx, looked)
        found_methods = resolve_methods(got.filter("op != 'member' and on is not null").select(F.col("on").alias("type_id"), "name", "argc"), idx, looked, rules)
        fallback = F.when(F.col("lookup") == "external", "external").otherwise("unresolved")
        m = got.filter("op = 'member'").join(found_members.select(F.col("type_id").alias("on"), "name", F.col("status").alias("f_status"), F.col("kind").alias("f_kind"), "member_id", "owner_id", F.col("member_type").alias("text")), ["on", "name"], "left")
        c = got.filter("op != 'member'").join(found_methods.select(F.col("type_id").alias("on"), "name", "argc", F.col("status").alias("f_status"), "method_id", "owner_id", "signature", F.col("return_type").alias("text")).withColumnRenamed("method_id", "callee"), ["on", "name", "argc"], "left")
        m = m.withColumn("status", F.coalesce("f_status", fallback)).join(names, "owner_id", "left")
        c = c.withColumn("status", F.coalesce("f_status", fallback)).join(names, "owner_id", "left")
        m, c = materialize_all({"members": m, "calls": c}).values()
        wanted = m.select("owner_id", "text").unionByName(c.filter("op = 'call'").select("owner_id", "text")).filter("owner_id is not null and text is not null")
        gives = declared_types(wanted, types, rules).select("owner_id", "text", F.col("type_id").alias("d_id"), F.col("external").alias("d_ext"))
        both = m.select("nid", "owner_id", "text").unionByName(c.filter("op = 'call'").select("nid", "owner_id", "text"))
        results = results.unionByName(materialize(_results(both.join(gives, ["owner_id", "text"]).select("nid", F.col("d_id").alias("type_id"), F.col("d_ext").alias("ext"))), "results"))
        shown = F.when(F.col("lookup") == "external", F.concat_ws(".", "res_ext", "name")).otherwise(F.col("name"))
        symbols.append(m.select("nid", *place, F.coalesce("f_kind", F.lit("unknown")).alias("target_kind"), shown.alias("target_name"), "name", F.col("member_id").alias("target_id"), F.col("kind").alias("reference_kind"), *span, F.col("status").alias("resolution_status"), "owner_full", "owner_source"))
        placeholder = F.concat(F.lit("("), F.array_join(F.array_repeat(F.lit("?"), F.col("argc")), ", "), F.lit(")"))
        current = types.select(F.col("type_id"), F.col("full_name").alias("current_full"))
        receiver = F.when(F.col("recv") == -2, F.col("current_full")).when(F.col("lookup") == "external", F.col("res_ext")).otherwise(F.col("hint"))
        calls.append(c.join(current, "type_id", "left").filter("op = 'call' or on is not null").select(
            "nid", "source_key", F.col("method_id").alias("caller_method_id"), F.col("callee").alias("callee_method_id"), F.col("name").alias("callee_name"), F.coalesce("signature", placeholder).alias("callee_signature_hint"),
            F.coalesce("owner_full", receiver).alias("declaring_type_hint"), "file_id", "line", "column", F.col("status").alias("resolution_status"),
        ))
    confidence = F.when(F.col("resolution_status") == "resolved", 1.0).when(F.col("resolution_status") == "external", 0.5).otherwise(0.0)
    key = logical_key(F.col("resolution_status"), F.col("target_kind"), F.col("owner_source"), F.col("owner_full"), none.cast("string"), F.col("name"))
    symbol_table = reduce(DataFrame.unionByName, symbols).select(
        F.col("nid").alias("id"), F.col("source_key").alias("source_id"), "from_file_id", "from_type_id", "from_method_id", "target_kind", "target_name", key.alias("target_logical_key"), "target_id", "reference_kind",
        "start_line", "start_column", "end_line", "end_column", "resolution_status", confidence.alias("resolution_confidence"),
    )
    empty = idx.spark.createDataFrame([], "id long, source_id long, caller_method_id long, callee_method_id long, callee_name string, callee_signature_hint string, declaring_type_hint string, file_id long, line int, column int, resolution_status string")
    call_table = reduce(DataFrame.unionByName, (x.withColumnRenamed("nid", "id").withColumnRenamed("source_key", "source_id") for x in calls), empty)
    return References(symbol_table, call_table, named.type_references)
