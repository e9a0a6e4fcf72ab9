"""Packing: every token once, no sequence too full, waste close to the least possible."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmine.llm import packing, vocabulary

from ..compare import SF
from . import cases


def check(lengths: Counter, rows, capacity: int) -> int:
    """Asserts that rows hold each document's tokens once; how many sequences there are."""
    spans, packs, slots = defaultdict(list), defaultdict(int), set()
    for r in rows:
        assert 0 < r.n_tokens <= capacity
        spans[r.doc_id].append((r.first_token, r.n_tokens))
        packs[r.pack_id] += r.n_tokens
        slots.add((r.pack_id, r.slot))
    assert len(slots) == len(rows) and max(packs.values(), default=0) <= capacity
    assert sorted(packs) == list(range(len(packs)))
    want = defaultdict(list)
    for (i, n), times in lengths.items():
        want[i] += [(at, min(capacity, n - at)) for at in range(0, n, capacity)] * times
    assert {k: sorted(v) for k, v in spans.items()} == {k: sorted(v) for k, v in want.items() if v}
    return len(packs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=8, max_size=8))
def test_plan_takes_every_item_once(histogram):
    packs = packing.plan(np.array(histogram), depth=3)
    taken = Counter()
    for repeat, steps in packs:
        assert repeat > 0 and sum(steps) <= 8
        for s in steps:
            taken[s] += repeat
    assert taken == Counter({k + 1: n for k, n in enumerate(histogram) if n})


def fewest(items: tuple[int, ...], capacity: int) -> int:
    """The least number of sequences for a few items, by trying every place for each."""
    best = len(items)

    def place(k: int, room: tuple[int, ...]) -> None:
        nonlocal best
        if len(room) >= best:
            return
        if k == len(items):
            best = len(room)
            return
        for at in {r: j for j, r in enumerate(room) if r >= items[k]}.values():
            place(k + 1, tuple(sorted(room[:at] + (room[at] - items[k],) + room[at + 1 :])))
        place(k + 1, tuple(sorted((*room, capacity - items[k]))))

    place(0, ())
    return best


def first_fit_decreasing(items: list[int], capacity: int) -> int:
    room: list[int] = []
    for x in sorted(items, reverse=True):
        for j, r in enumerate(room):
            if r >= x:
                room[j] -= x
                break
        else:
            room.append(capacity - x)
    return len(room)


def test_plan_against_all_packings_of_a_few_items():
    draw, over = random.Random(7), 0
    for _ in range(150):
        items = tuple(sorted((draw.randrange(1, 17) for _ in range(draw.randrange(1, 10))), reverse=True))
        packs = sum(repeat for repeat, _ in packing.plan(np.bincount(items, minlength=17)[1:], depth=3))
        least = fewest(items, 16)
        assert least <= packs <= least + 1, items
        over += packs > least
    assert over <= 7


def test_plan_is_about_as_good_as_first_fit_decreasing():
    draw = random.Random(8)
    for kind in (lambda: draw.randrange(1, 33), lambda: draw.choice([3, 5, 11, 16, 21]), lambda: min(32, 1 + int(draw.expovariate(0.15)))):
        items = [kind() for _ in range(4000)]
        packs = sum(repeat for repeat, _ in packing.plan(np.bincount(items, minlength=33)[1:], depth=4))
        assert packs <= 1.01 * first_fit_decreasing(items, 32) + 1


def test_nnls_meets_its_optimality_conditions():
    draw = np.random.default_rng(0)
    for _ in range(20):
        a, b = draw.normal(size=(12, 30)), draw.normal(size=12)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gain <= 1e-6).all() and np.abs(gain[x > 0]).max(initial=0) < 1e-6


def test_patterns_are_those_that_fit():
    rows = {tuple(r) for r in packing.patterns(5, 2).tolist()}
    want = {tuple(np.bincount(s, minlength=6)[1:].tolist()) for s in [(a,) for a in range(1, 6)] + [(a, b) for a in range(1, 6) for b in range(a, 6) if a + b <= 5]}
    assert rows == want


def test_random_lengths(spark):
    draw = random.Random(2)
    rows = [(k, draw.choice([draw.randrange(0, 300), draw.randrange(0, 60), 256, 64])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    n = check(Counter(rows), packing.pack(df, capacity=256, bins=32, group_docs=200).collect(), 256)
    least = -(-sum(x for _, x in rows) // 256)
    assert n <= 1.08 * least


def test_documents(spark):
    docs = cases.documents(spark)
    encode = tiktoken.Encoding.encode_ordinary
    bpe = vocabulary.byte_bpe()
    lengths = Counter((r.doc_id, len(encode(bpe, r.text))) for r in docs.collect() if r.text)
    n = check(lengths, packing.op1_best_fit_packing(spark, SF).collect(), packing.CAPACITY)
    assert n <= 1.1 * -(-sum(x * c for (_, x), c in lengths.items()) // packing.CAPACITY) + 1


def test_awkward_rows(spark):
    bpe = vocabulary.byte_bpe()
    lengths = Counter((i, len(bpe.encode_ordinary(t or ""))) for i, t, *_ in cases.ROWS)
    check(lengths, packing.pack_documents(cases.awkward(spark)).collect(), packing.CAPACITY)


def test_long_runs_of_one_character(spark):
    rows = [(1, "a" * 300_000), (2, " " * 300_000), (3, "\n" * 100_000), (4, "é" * 100_000)]
    found = packing.token_counts(cases.table(spark, rows, "doc_id long, text string")).collect()
    assert len(found) == 4 and all(r.n_tokens > 0 for r in found)


def test_empty_table(spark):
    assert packing.pack_documents(cases.empty(spark)).count() == 0
