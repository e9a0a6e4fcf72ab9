"""Differencing: balance against greedy dealing, whole groups, every level of the hierarchy."""

from __future__ import annotations

import heapq
import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmine.llm import sharding

from ..compare import SF
from . import cases


def loads(weights, shards, k) -> np.ndarray:
    return np.bincount(shards, weights, k)


def single(weights, k) -> np.ndarray:
    vectors = np.zeros((len(weights), k), np.int64)
    vectors[:, 0] = weights
    return sharding.difference(vectors)[:, 0]


def reference_spread(weights, k) -> int:
    """Spread by differencing of tuples, one merge after the other."""
    heap = [(-w, n, (w, *[0] * (k - 1))) for n, w in enumerate(weights)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        c = tuple(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
        heapq.heappush(heap, (c[-1] - c[0], n, c))
        n += 1
    return heap[0][2][0] - heap[0][2][-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=60), st.integers(2, 7))
def test_spread_is_that_of_differencing(weights, k):
    load = loads(weights, single(weights, k), k)
    assert load.sum() == sum(weights) and load.max() - load.min() == reference_spread(weights, k)


def test_known_case():
    weights = [8, 7, 6, 5, 4]
    load = loads(weights, single(weights, 2), 2)
    assert sorted(load.tolist()) == [14, 16]


def test_tighter_than_greedy():
    draw = np.random.default_rng(6)
    weights = draw.integers(1, 1 << 20, 600)
    k = 8
    load = loads(weights, single(weights, k), k)
    greedy = np.zeros(k)
    for w in sorted(weights.tolist(), reverse=True):
        greedy[greedy.argmin()] += w
    assert load.max() - load.min() < greedy.max() - greedy.min()


def test_parts_are_differenced_in_turn(spark):
    draw = random.Random(9)
    rows = [(k, "x" * draw.randrange(1, 2000)) for k in range(1500)]
    df = sharding.shard(cases.table(spark, rows, "doc_id long, text string"), F.col("doc_id"), shards=6, part_groups=50, fan=4)
    found = df.collect()
    size = dict((k, len(t)) for k, t in rows)
    assert sorted(r.doc_id for r in found) == sorted(size)
    load = defaultdict(int)
    for r in found:
        assert r.n_bytes == size[r.doc_id]
        load[r.shard] += r.n_bytes
    assert len(load) == 6 and max(load.values()) - min(load.values()) < 0.01 * max(load.values())


def test_documents(spark):
    rows = sharding.op10_sharding(spark, SF).collect()
    text = {r.doc_id: r.text for r in cases.documents(spark).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    home = {}
    for r in rows:
        assert 0 <= r.shard < sharding.SHARDS and home.setdefault(text[r.doc_id], r.shard) == r.shard


def test_awkward_rows(spark):
    rows = sharding.shard(cases.awkward(spark), F.md5(F.col("text").cast("binary")), shards=3).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in cases.ROWS)
    assert len({r.shard for r in rows if r.doc_id in (4, 5)}) == 1
    assert {r.n_bytes for r in rows if r.doc_id in (1, 2)} == {0}


def test_empty_table(spark):
    assert sharding.shard(cases.empty(spark), F.col("text")).count() == 0
