"""Recursion over edges by semi-naive rounds; every round is a written table, so lineage stays short and lost executors cost a read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from ..model import CodeIndex
from ..stage import ROWS_AT_ONCE, discard, materialize, shuffled, spread


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): nodes within max_depth of each root over edges (src, dst), roots at depth 0, each node at its least depth."""
    edges = edges.select("src", "dst").distinct()
    frontier = materialize(roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct(), "frontier")
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def ordered_reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth, pos): nodes in the order of a breadth-first walk; edges (src, dst, ordinal), pos from 0.

    From most nodes of a graph without a limit, each node's walk is put together from those of the nodes that its edges lead to; from few, or where there are cycles, walks go on in rounds.
    """
    kind = roots.schema["id"].dataType
    roots = roots.select("id").distinct()
    edges = materialize(edges.select("src", "dst", F.col("ordinal").cast("int").alias("ordinal")).filter("src != dst"), "edges")
    if max_depth is not None or not isinstance(kind, IntegralType):
        return _rounds(edges, roots, max_depth)
    long = lambda df, name, to: df.select(F.col(name).cast("long").alias(to))
    roots = materialize(roots, "roots")
    nodes = materialize(long(roots, "id", "id").unionByName(long(edges, "src", "id")).unionByName(long(edges, "dst", "id")).distinct(), "nodes")
    n_roots, n_nodes = roots.count(), nodes.count()
    if 2 * n_roots < n_nodes:
        return _rounds(edges, roots)
    walks, left = _walks(edges, nodes)
    found = walks.select("root", "depths", F.posexplode("nodes").alias("pos", "node"))
    node_kind = kind if edges.schema["dst"].dataType == kind else LongType()
    found = found.select(F.col("root").cast(kind).alias("root"), F.col("node").cast(node_kind).alias("node"), F.get("depths", F.col("pos")).alias("depth"), "pos")
    if left is not None:
        found = found.unionByName(_rounds(edges, left.select(F.col("id").cast(kind).alias("id"))))
    return found if n_roots == n_nodes else found.join(roots.withColumnRenamed("id", "root"), "root", "left_semi").select("root", "node", "depth", "pos")


def _rounds(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """ordered_reachable() from each root outwards, one depth a round; what was seen is left out."""
    frontier = materialize(roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path")).distinct(), "walk")
    edges = shuffled(edges, edges.count())
    rows = frontier.count()
    seen, depth, total = frontier, 0, rows
    first = Window.partitionBy("root", "dst").orderBy("way")
    while rows and (max_depth is None or depth < max_depth):
        depth += 1
        step = shuffled(frontier, rows).join(edges, F.col("node") == F.col("src")).select("root", "dst", F.concat("path", F.array("ordinal")).alias("way"))
        step = step.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("root", F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.col("way").alias("path"))
        frontier = materialize(step.join(shuffled(seen.select("root", "node"), total), ["root", "node"], "left_anti"), "walk")
        rows = frontier.count()
        if rows:
            seen, total = seen.unionByName(frontier), total + rows
    tasks = -(-total // ROWS_AT_ONCE)
    if tasks <= 1:
        return seen.select("root", "node", "depth", (F.row_number().over(Window.partitionBy("root").orderBy("depth", "path")) - 1).alias("pos"))
    # a root may have more nodes than one task can number, so ranges are numbered, each after those before it
    ranges = materialize(seen.repartitionByRange(tasks, "root", "depth", "path").withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("root", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("root", "part").orderBy("depth", "path")) - 1
    return ranges.withColumn("nth", nth).join(starts, ["root", "part"]).select("root", "node", "depth", (F.col("start") + F.col("nth")).cast("int").alias("pos"))


_WALK = "root long, size int, nodes array<long>, depths array<int>"


def _walks(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows of _WALK: a node's whole walk in its order; the nodes (id) from which a cycle can be reached, which have none, or None).

    A round takes the nodes all of whose edges lead to nodes that have walks. In a walk nodes come by depth, at one depth by the edge and then by their order in the walk behind
    it, so no paths are kept, and each walk is written once.
    """
    none = F.array().cast("array<int>")
    open_ = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "ordinal", F.lit(None).cast("int").alias("size"))
    ends = nodes.join(open_.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    new = materialize(ends.select(F.col("id").alias("root"), F.lit(1).alias("size"), F.array("id").alias("nodes"), F.concat(none, F.array(F.lit(0))).alias("depths")), "walks")
    n_new, n_open = new.count(), edges.count()
    done, cells = new, n_new
    last = None
    while n_open:
        # an edge that leads to a node with a walk knows its size
        reached = shuffled(new.select(F.col("root").alias("dst"), F.col("size").alias("got")), n_new)
        known = shuffled(open_, n_open).join(reached, "dst", "left").select("src", "dst", "ordinal", F.coalesce("size", "got").alias("size"))
        lacking = F.count_if(F.col("size").isNull()).over(Window.partitionBy("src"))
        step = materialize(known.repartition(spread(n_open), "src").withColumn("ready", lacking == 0), "open")
        if last is not None:
            discard(last)
        open_, last = step.filter("not ready").drop("ready"), step
        ready = step.filter("ready")
        n_ready, most = ready.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not n_ready:
            break
        n_open -= n_ready
        behind = ready.drop("size").repartition(spread(cells + most), "dst").join(done.hint("merge"), F.col("dst") == F.col("root")).select("src", F.struct("ordinal", "nodes", "depths").alias("walk"))
        gathered = behind.repartition(spread(most), "src").groupBy("src").agg(F.collect_list("walk").alias("walks"))
        new = materialize(gathered.mapInArrow(_merge, _WALK), "walks")
        n_new, done, cells = new.count(), done.unionByName(new), cells + most
    left = materialize(open_.select(F.col("src").alias("id")).distinct(), "left") if n_open else None
    return done, left


#: Cells of walks that are merged at once.
CELLS_AT_ONCE = 1 << 19


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _WALK from rows (src, walks), the walks (ordinal, nodes, depths) behind a node's edges."""
    for batch in batches:
        lengths = pc.list_value_length(batch[1]).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(batch[1].flatten().field("nodes")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.concatenate(([0], sizes)))[np.cumsum(lengths)]
        at = 0
        while at < batch.num_rows:
            began = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, began + CELLS_AT_ONCE, "right")))
            yield _merged(batch[0].slice(at, to - at).to_numpy(), batch[1].slice(at, to - at))
            at = to


def _merged(src: np.ndarray, lists: pa.ListArray) -> pa.RecordBatch:
    n, walks = len(src), lists.flatten()
    nodes, depths = walks.field("nodes"), walks.field("depths")
    sizes = pc.list_value_length(nodes).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    row = np.concatenate((np.arange(n), np.repeat(owner, sizes)))
    edge = np.concatenate((np.zeros(n, np.int64), np.repeat(walks.field("ordinal").to_numpy(zero_copy_only=False), sizes)))
    depth = np.concatenate((np.zeros(n, np.int64), depths.flatten().to_numpy(zero_copy_only=False) + 1))
    node = np.concatenate((src, nodes.flatten().to_numpy(zero_copy_only=False)))
    order = np.lexsort((edge, depth, row))
    row, depth, node = row[order], depth[order], node[order]
    same = np.lexsort((node, row))
    again = np.concatenate(([False], (row[same][1:] == row[same][:-1]) & (node[same][1:] == node[same][:-1])))
    kept = np.ones(len(row), bool)
    kept[same[again]] = False
    row, depth, node = row[kept], depth[kept], node[kept]
    counts = np.bincount(row, minlength=n)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    columns = [pa.array(src), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(node)), pa.ListArray.from_arrays(offsets, pa.array(depth, pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["root", "size", "nodes", "depths"])


def subtype_edges(idx: CodeIndex) -> DataFrame:
    return idx.inheritance.filter("target_type_id is not null").select(F.col("target_type_id").alias("src"), F.col("type_id").alias("dst"))


def derived(idx: CodeIndex, roots: DataFrame, source: str | None = None, *, recursive: bool = False) -> DataFrame:
    """(root, depth, pos, source_id, full_name): subtypes in breadth-first order, within a parent by source and name; a source hides others but they are still walked."""
    names = idx.types.select(F.col("id").alias("dst"), "full_name", F.col("source_id").alias("source_key")).join(idx.sources.select(F.col("id").alias("source_key"), "source_id"), "source_key")
    within = Window.partitionBy("src").orderBy("source_id", "full_name", "dst")
    edges = subtype_edges(idx).distinct().join(names, "dst").withColumn("ordinal", F.row_number().over(within))
    walked = ordered_reachable(edges, roots, None if recursive else 1).filter("depth > 0")
    found = walked.join(names.withColumnRenamed("dst", "node"), "node").select("root", "depth", "pos", "source_id", "full_name")
    return found.filter(F.col("source_id") == source) if source else found


def overrides(idx: CodeIndex, roots: DataFrame, name: str, signature: str | None = None) -> DataFrame:
    """(full_name, signature): overriding methods of a name in the root types and all their subtypes; signature narrows further."""
    within = reachable(subtype_edges(idx), roots).select(F.col("node").alias("type_id")).distinct()
    m = idx.methods.filter((F.col("name") == name) & (F.col("is_override") == 1))
    m = m.filter(F.col("signature") == signature) if signature else m
    types = idx.types.select(F.col("id").alias("type_id"), "full_name")
    return m.join(within, "type_id", "left_semi").join(types, "type_id").select("full_name", "signature").distinct().orderBy("full_name", "signature")


def type_chain(idx: CodeIndex, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, depth, pos): each type and its bases, breadth first in the order they are listed; all types without roots."""
    listed = Window.partitionBy("type_id").orderBy("id")
    edges = idx.inheritance.withColumn("ordinal", F.row_number().over(listed)).filter("target_type_id is not null")
    edges = edges.select(F.col("type_id").alias("src"), F.col("target_type_id").alias("dst"), "ordinal")
    return ordered_reachable(edges, roots if roots is not None else idx.types.select("id"))
