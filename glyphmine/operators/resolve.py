"""Set-based name resolution: every lookup is a ranked candidate join, and ambiguity is a count.

Outcomes are resolved, ambiguous, unresolved or external; nothing is guessed. parity keeps known quirks: an arity that is half the
parameter text, methods of base types that compete with overriding ones, and inheritance targets whose qualification is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import arity, is_external_name, simple_name, strip_generics
from ..model import CodeIndex
from ..schemas import EXTERNAL_ROOTS
from ..stage import shuffled, spread
from .graph import ordered_reachable


@dataclass
class Rules:
    """primary: the source that others fall back to; roots: first name parts that lie outside all sources."""

    primary: str | None = None
    roots: frozenset[str] = field(default_factory=lambda: EXTERNAL_ROOTS)
    parity: bool = False


def type_names(idx: CodeIndex) -> DataFrame:
    """(type_id, source, full_name, name, namespace) of all types."""
    s = idx.sources.select(F.col("id").alias("source_id"), F.col("source_id").alias("source"))
    return idx.types.select(F.col("id").alias("type_id"), "source_id", "full_name", "name", "namespace").join(s, "source_id").drop("source_id")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first row of each key in an order."""
    numbered = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter("__nth = 1").drop("__nth"), numbered.filter("__nth > 1").drop("__nth")


def namespace_prefixes(namespace: Column) -> Column:
    """a.b.c, a.b and a of a.b.c; nothing of an empty one."""
    parts = F.split(namespace, r"\.")
    return F.when(F.coalesce(F.length(namespace), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    )


def resolve_inheritance(edges: DataFrame, types: DataFrame, rules: Rules) -> DataFrame:
    """(edge_id, target_type_id) for edges (edge_id, type_id, source, namespace, target_name); null where nothing fits.

    The target is sought in each enclosing namespace from the inside, then outside any, in the same source; then by simple name where only one type has it.
    """
    flat = strip_generics(F.col("target_name"))
    base = F.element_at(F.split(F.split("target_name", "<").getItem(0), r"\."), -1) if rules.parity else simple_name(F.col("target_name"))
    wanted = edges.withColumn("base", base).withColumn("flat", flat)
    names = F.concat(F.transform(namespace_prefixes(F.col("namespace")), lambda p: F.concat(p, F.lit("."), F.col("base"))), F.array("base"))
    if not rules.parity:
        names = F.concat(F.array("flat"), F.transform(namespace_prefixes(F.col("namespace")), lambda p: F.concat(p, F.lit("."), F.col("flat"))), names)
    tries = wanted.select("edge_id", "type_id", "source", F.posexplode(names).alias("rank", "full_name"))
    known = types.select(F.col("type_id").alias("found"), "source", "full_name")
    hits = tries.join(known, ["source", "full_name"])
    hits = hits if rules.parity else hits.filter("found != type_id")
    by_name = hits.groupBy("edge_id").agg(F.min_by("found", F.struct("rank", "found")).alias("in_scope"))
    alone = types.groupBy("source", "name").agg(F.count("*").alias("n"), F.min("type_id").alias("only")).filter("n = 1").select("source", F.col("name").alias("base"), "only")
    out = wanted.join(by_name, "edge_id", "left").join(alone.withColumnRenamed("only", "here"), ["source", "base"], "left")
    there = alone.filter(F.col("source") == F.lit(rules.primary)).select("base", F.col("only").alias("primary_only"))
    out = out.join(there, "base", "left").withColumn("abroad", F.when(F.lit(rules.primary).isNotNull() & (F.col("source") != F.lit(rules.primary)), F.col("primary_only")))
    order = [F.col("in_scope"), F.col("abroad"), F.col("here")] if rules.parity else [F.col("in_scope"), *(F.when(F.col(c) != F.col("type_id"), F.col(c)) for c in ("here", "abroad"))]
    return out.select("edge_id", F.coalesce(*order).alias("target_type_id"))


def textual_bases(idx: CodeIndex, rules: Rules) -> DataFrame:
    """Inheritance edges (type_id, ordinal, target): the resolved target, else a type of the bare name in the namespace, in no namespace, or in the primary source."""
    types = type_names(idx)
    edges = idx.inheritance.select("id", "type_id", "target_name", "target_type_id").join(types.select("type_id", "source", "namespace"), "type_id")
    base = simple_name(F.col("target_name"))
    tries = edges.filter("target_type_id is null").select(
        "id", F.posexplode(F.array(F.struct(F.col("source").alias("source"), F.concat_ws(".", F.when(F.col("namespace") != "", F.col("namespace")), base).alias("full_name")), F.struct(F.col("source"), base.alias("full_name")), F.struct(F.lit(rules.primary).alias("source"), base.alias("full_name")))).alias("rank", "c")
    )
    known = types.select(F.col("type_id").alias("found"), "source", "full_name")
    hits = tries.select("id", "rank", "c.source", "c.full_name").join(known, ["source", "full_name"]).groupBy("id").agg(F.min_by("found", "rank").alias("found"))
    listed = Window.partitionBy("type_id").orderBy("id")
    out = edges.withColumn("ordinal", F.row_number().over(listed)).join(hits, "id", "left")
    return out.select("type_id", "ordinal", F.coalesce("target_type_id", "found").alias("target"), "target_name", F.col("target_type_id").isNull().alias("unresolved"))


@dataclass
class Scope:
    """What member lookups share: chains (root, node, pos) and types with an external base."""

    chain: DataFrame
    external: DataFrame


def scope(idx: CodeIndex, rules: Rules, roots: DataFrame | None = None) -> Scope:
    bases = textual_bases(idx, rules)
    edges = bases.filter("target is not null").select(F.col("type_id").alias("src"), F.col("target").alias("dst"), "ordinal")
    chain = ordered_reachable(edges, roots if roots is not None else idx.types.select("id"))
    outside = bases.filter(F.col("unresolved") & is_external_name(F.col("target_name"), rules.roots)).select(F.col("type_id").alias("root")).distinct().withColumn("outside", F.lit(True))
    return Scope(chain, outside)


def resolve_types(requests: DataFrame, types: DataFrame, chain: DataFrame, rules: Rules) -> DataFrame:
    """(req, status, type_id) for requests (req, source, namespace, usings, current_type, text).

    A dotted name is exact, in the source and then in the primary one. A bare name is sought inside each type of the current type's chain, in the namespace, in each using and
    outside any namespace; the first source that has any decides, and two finds are ambiguous.
    """
    text = strip_generics(F.trim("text"))
    base = text if rules.parity else F.regexp_replace(text, r"(\?|\[[,\s]*\]|\*|\s)+$", "")
    r = requests.withColumn("base", base).withColumn("dotted", F.col("base").contains("."))
    scopes = chain.join(types.select(F.col("type_id").alias("node"), "full_name"), "node").groupBy(F.col("root").alias("current_type")).agg(F.collect_set("full_name").alias("within"))
    r = r.join(scopes, "current_type", "left").withColumn("within", F.coalesce("within", F.array().cast("array<string>")))
    under = lambda prefixes: F.transform(prefixes, lambda p: F.concat(p, F.lit("."), F.col("base")))
    space = F.when(F.coalesce(F.length("namespace"), F.lit(0)) > 0, F.array("namespace")).otherwise(F.array().cast("array<string>"))
    bare = F.array_distinct(F.concat(under(F.col("within")), under(space), under(F.coalesce("usings", F.array().cast("array<string>"))), F.array("base")))
    names = F.when(F.col("dotted"), F.array("base")).otherwise(bare)
    places = F.array(F.struct(F.lit(0).alias("rank"), F.col("source").alias("at")), F.struct(F.lit(1).alias("rank"), F.lit(rules.primary).alias("at")))
    tries = r.select("req", F.explode(names).alias("full_name"), places.alias("places")).select("req", "full_name", F.explode("places").alias("p"))
    hits = tries.select("req", "full_name", "p.rank", F.col("p.at").alias("source")).join(types.select("source", "full_name", "type_id"), ["source", "full_name"])
    first = hits.groupBy("req", "rank").agg(F.countDistinct("type_id").alias("n"), F.min("type_id").alias("found")).groupBy("req").agg(F.min_by(F.struct("n", "found"), "rank").alias("best"))
    out = r.select("req", "base").join(first, "req", "left")
    status = F.when(F.col("best.n") == 1, "resolved").when(F.col("best.n") > 1, "ambiguous").when(is_external_name(F.col("base"), rules.roots), "external").otherwise("unresolved")
    return out.select("req", status.alias("status"), F.when(F.col("best.n") == 1, F.col("best.found")).alias("type_id"))


def _seen_by(chain: DataFrame, own: DataFrame, asked: DataFrame, tasks: int) -> DataFrame:
    """Members own (node, name, ...) with each type_id that asks for any and has their type in its chain, and its pos; in tasks, or more, by type_id and name.

    Members go to the types below theirs, not each request to every type above: few types have a member of a name. Tasks are sized by rows, counted first, as sorted keys
    have too few compressed bytes to tell.
    """
    rows = chain.count()
    chain = shuffled(chain, rows).select(F.col("root").alias("type_id"), "node", "pos").join(asked.select("type_id").distinct(), "type_id", "left_semi")
    by_node = chain.groupBy("node").agg(F.count("*").alias("below")).join(own.groupBy("node").agg(F.count("*").alias("n")), "node")
    hits = by_node.agg(F.coalesce(F.sum(F.col("below") * F.col("n")), F.lit(0))).first()[0]
    return shuffled(chain.repartition(spread(rows), "node"), rows).join(own, "node").repartition(max(tasks, spread(hits)), "type_id", "name")


def _requested(requests: DataFrame, scope_: Scope, *keys: str) -> tuple[DataFrame, int]:
    """(distinct requests with outside, into how many partitions their rows go)."""
    tasks = spread(requests.count())
    return requests.select(*keys).repartition(tasks, "type_id").distinct().join(scope_.external.withColumnRenamed("root", "type_id"), "type_id", "left"), tasks


def resolve_members(requests: DataFrame, idx: CodeIndex, scope_: Scope) -> DataFrame:
    """(type_id, name, status, kind, member_id, owner_id, member_type): the nearest type of the chain that has a field or property of the name; both there is ambiguous."""
    own = idx.fields.groupBy("type_id", "name").agg(F.max_by(F.struct("id", F.col("field_type").alias("type")), "id").alias("m")).withColumn("kind", F.lit("field"))
    own = own.unionByName(idx.properties.groupBy("type_id", "name").agg(F.max_by(F.struct("id", F.col("property_type").alias("type")), "id").alias("m")).withColumn("kind", F.lit("property")))
    asked, tasks = _requested(requests, scope_, "type_id", "name")
    hits = _seen_by(scope_.chain, own.withColumnRenamed("type_id", "node"), asked, tasks)
    at = hits.groupBy("type_id", "name", "pos").agg(F.count("*").alias("n"), F.first("kind").alias("kind"), F.first("m").alias("m"), F.first("node").alias("node"))
    best = at.groupBy("type_id", "name").agg(F.min_by(F.struct("n", "kind", "m", "node"), "pos").alias("b"))
    out = asked.join(best.repartition(tasks, "type_id", "name"), ["type_id", "name"], "left")
    one = F.col("b.n") == 1
    status = F.when(one, "resolved").when(F.col("b.n") > 1, "ambiguous").when(F.col("outside"), "external").otherwise("unresolved")
    return out.select("type_id", "name", status.alias("status"), F.when(one, F.col("b.kind")).alias("kind"), F.when(one, F.col("b.m.id")).alias("member_id"), F.when(one, F.col("b.node")).alias("owner_id"), F.when(one, F.col("b.m.type")).alias("member_type"))


def resolve_methods(requests: DataFrame, idx: CodeIndex, scope_: Scope, rules: Rules) -> DataFrame:
    """(type_id, name, argc, status, method_id, owner_id, signature, return_type): methods of the name over the whole chain, of a signature the nearest,
    narrowed by the number of arguments unless that leaves none; one is resolved, more are ambiguous."""
    keys, keyed = ["type_id", "name", "argc"], ["type_id", "name", "argc_key"]
    asked, tasks = _requested(requests, scope_, *keys)
    asked = asked.withColumn("argc_key", F.coalesce("argc", F.lit(-1)))
    own = idx.methods.select(F.col("type_id").alias("node"), "name", F.col("id").alias("method_id"), "signature", "return_type", arity(F.col("signature"), rules.parity).alias("arity"))
    hits = _seen_by(scope_.chain, own, asked, tasks)
    if not rules.parity:
        near = Window.partitionBy("type_id", "name", "signature").orderBy("pos", "method_id")
        hits = hits.withColumn("nth", F.row_number().over(near)).filter("nth = 1").drop("nth")
    fits = F.coalesce(F.col("arity") == F.col("argc"), F.lit(False))
    found, order = F.struct("method_id", F.col("node").alias("owner_id"), "signature", "return_type"), F.struct("pos", "method_id")
    best = hits.join(asked.select(*keys, "argc_key"), ["type_id", "name"]).groupBy(*keyed).agg(
        F.count("*").alias("n_all"), F.count_if(fits).alias("n_fit"), F.min_by(found, order).alias("of_all"), F.min_by(found, F.when(fits, order)).alias("of_fit")
    )
    narrow = (F.col("n_all") > 1) & (F.col("n_fit") > 0)
    best = best.select(*keyed, F.when(narrow, F.col("n_fit")).otherwise(F.col("n_all")).alias("n"), F.when(narrow, F.col("of_fit")).otherwise(F.col("of_all")).alias("m"))
    out = asked.join(best.repartition(tasks, *keyed), keyed, "left")
    one = F.col("n") == 1
    status = F.when(one, "resolved").when(F.col("n") > 1, "ambiguous").when(F.col("outside"), "external").otherwise("unresolved")
    return out.select(*keys, status.alias("status"), *(F.when(one, F.col(f"m.{c}")).alias(c) for c in ("method_id", "owner_id", "signature", "return_type")))


def declared_types(requests: DataFrame, types: DataFrame, rules: Rules) -> DataFrame:
    """(owner_id, text, type_id, external) for requests (owner_id, text): a member's declared type, sought in its owner's namespace, outside any, then in the primary source."""
    asked = requests.select("owner_id", "text").distinct().withColumn("base", F.regexp_replace(strip_generics(F.trim("text")), r"(\?|\*|\s)+$", ""))
    owners = types.select(F.col("type_id").alias("owner_id"), "source", "namespace")
    r = asked.join(owners, "owner_id")
    space = F.concat_ws(".", F.when(F.col("namespace") != "", F.col("namespace")), F.col("base"))
    tries = r.select("owner_id", "text", F.posexplode(F.array(F.struct(F.col("source").alias("source"), space.alias("full_name")), F.struct(F.col("source"), F.col("base").alias("full_name")), F.struct(F.lit(rules.primary).alias("source"), F.col("base").alias("full_name")))).alias("rank", "c"))
    hits = tries.select("owner_id", "text", "rank", "c.source", "c.full_name").join(types.select("source", "full_name", "type_id"), ["source", "full_name"])
    best = hits.groupBy("owner_id", "text").agg(F.min_by("type_id", "rank").alias("type_id"))
    outside = F.when(is_external_name(F.col("base"), rules.roots), F.col("base"))
    return r.join(best, ["owner_id", "text"], "left").select("owner_id", "text", F.when(outside.isNull(), F.col("type_id")).alias("type_id"), outside.alias("external"))
