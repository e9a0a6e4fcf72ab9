"""Ordered walks against a plain breadth-first search, on trees, diamonds and cycles; what they write and what they send to the driver."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmine import stage
from glyphmine.operators import graph, resolve


def walked(edges, roots):
    following, out = defaultdict(list), set()
    for s, d, o in edges:
        following[s].append((o, d))
    for root in roots:
        seen, layer, depth = {root}, [root], 0
        out.add((root, root, 0, 0))
        while layer:
            depth, before, layer = depth + 1, layer, []
            for x in before:
                for _, y in sorted(following[x]):
                    if y not in seen:
                        out.add((root, y, depth, len(seen)))
                        seen.add(y)
                        layer.append(y)
    return out


def drawn(n: int, cycles: bool, seed: int):
    r = random.Random(seed)
    return [(s, r.randrange(n) if cycles and r.random() < 0.2 else r.randrange(s), o) for s in range(1, n) for o in range(1, r.randint(0, 3) + 1)]


def frames(spark, edges, roots):
    return spark.createDataFrame(edges, "src long, dst long, ordinal int"), spark.createDataFrame([(r,) for r in roots], "id long")


@pytest.mark.parametrize(("cycles", "roots"), [(False, range(60)), (True, range(60)), (False, range(0, 60, 40)), (True, range(20, 60))])
def test_walks_agree_with_search(spark, monkeypatch, cycles, roots):
    monkeypatch.setattr(graph, "ROWS_AT_ONCE", 50, raising=False)
    edges = drawn(60, cycles, 4)
    got = [tuple(r) for r in graph.ordered_reachable(*frames(spark, edges, roots)).collect()]
    assert set(got) == walked(edges, roots) and len(set(got)) == len(got)


def test_a_walk_is_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, label: written.append((label, stage.materialize(df, label))) or written[-1][1])
    edges = [(k, k // by, nth) for nth, by in ((1, 3), (2, 2)) for k in range(1, 300)]
    assert graph.ordered_reachable(*frames(spark, edges, range(300))).count() == len(walked(edges, range(300)))
    assert sum(t.count() for label, t in written if label in ("walk", "walks")) == 300


def test_rounds_broadcast_few_rows(spark, monkeypatch):
    """Files of walks are small for their rows, so their size must not decide about broadcasts."""
    monkeypatch.setattr(stage, "BROADCAST_ROWS", 0, raising=False)
    plans = []
    monkeypatch.setattr(graph, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage.materialize(df, label))
    edges = [(k // 3, k, k) for k in range(1, 50)]
    assert graph.ordered_reachable(*frames(spark, edges, [0])).count() == 50
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_resolution_is_spread_by_rows(spark, monkeypatch):
    """Sorted keys have next to no compressed bytes, by which adaptive execution would give all rows to one task."""
    from glyphmine.views import index

    from .compare import SF

    monkeypatch.setattr(stage, "ROWS_AT_ONCE", 200, raising=False)
    idx = index(spark, SF)
    rules = resolve.Rules()
    asked = idx.types.select(F.col("id").alias("type_id")).crossJoin(idx.methods.select("name").distinct())
    looked = resolve.scope(idx, rules)
    for found in (resolve.resolve_members(asked, idx, looked), resolve.resolve_methods(asked.withColumn("argc", F.lit(1)), idx, looked, rules)):
        counts = found.select("type_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(counts) == asked.count() and max(counts) < 600
