"""The join against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from glyphmine.llm import ngram_join

from . import cases


def grams(text: str, n: int = ngram_join.N) -> set:
    w = re.sub(r"[^\w]+", " ", text.lower()).split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute(rows, t: float = ngram_join.THRESHOLD) -> dict:
    sets = {i: g for i, x, *_ in rows if i is not None and x is not None and (g := grams(x))}
    may = lambda a, b: min(len(a), len(b)) >= t * max(len(a), len(b)) - 1e-9
    return {(a, b): j for a, b in combinations(sorted(sets), 2) if may(sets[a], sets[b]) and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= t - 1e-12}


def roots(nodes, pairs) -> dict:
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in nodes}


def expected(rows) -> dict:
    """(class_id, links) of every id; ids occur once."""
    nodes = [i for i, *_ in rows if i is not None]
    pairs = brute(rows)
    links = Counter(i for p in pairs for i in p)
    root = roots(nodes, pairs)
    return {i: (root[i], links[i]) for i in nodes}


def result(df) -> dict:
    rows = df.collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: (r.class_id, r.links) for r in rows}


def unlike(rows, pairs: dict) -> dict:
    """Of all pairs, those between the least ids of classes."""
    least = {}
    for i, x, *_ in rows:
        if i is not None and x is not None and (g := frozenset(grams(x))):
            least[g] = min(i, least.get(g, i))
    kept = set(least.values())
    return {p: j for p, j in pairs.items() if j < 1 and set(p) <= kept}


def edited(draw: random.Random, families: int, copies: int, words: int = 120) -> list:
    rows = []
    for _ in range(families):
        base = [f"w{draw.randrange(9000)}" for _ in range(words)]
        for _ in range(copies):
            mine = list(base)
            for _ in range(draw.randrange(0, 10)):
                mine[draw.randrange(words)] = f"v{draw.randrange(9000)}"
            rows.append((len(rows), " ".join(mine), None, None, None))
    return rows


def test_all_documents(spark):
    docs = cases.documents(spark, "0.01")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    found = ngram_join.similar_pairs(docs).collect()
    assert {(r.doc_id_a, r.doc_id_b): round(r.jaccard, 12) for r in found} == {p: round(j, 12) for p, j in unlike(rows, want).items()} != {}
    assert result(ngram_join.similar_documents(docs)) == expected(rows)


@pytest.mark.parametrize("how", [{}, {"limit": 200, "part": 1000, "block": 2000, "table": 64}])
def test_no_link_is_lost_near_the_threshold(spark, how):
    rows = edited(random.Random(11), 40, 6)
    want = brute(rows)
    found = ngram_join.similar_pairs(cases.table(spark, rows), **how).collect()
    assert {(r.doc_id_a, r.doc_id_b) for r in found} == set(unlike(rows, want)) and len(found) > 100


def test_trees_have_inner_nodes_and_lose_nothing(spark, monkeypatch):
    rows = edited(random.Random(5), 2, 60)
    sets = {i: np.unique(s) for (i, *_), s in zip(rows, ngram_join.gram_sets(__import__("pyarrow").array([r[1] for r in rows]), 3), strict=True)}
    members = {(i, len(s)): (ngram_join.pack_counts(ngram_join.group_counts(s, 256)), 1) for i, s in sets.items()}
    points = np.stack([ngram_join.unpack_counts(d, 256, n) for (_, n), (d, _) in members.items()])
    tree = ngram_join.CountRTree(points, np.array([n for _, n in members]))
    assert [len(top) for top, _, _ in tree.levels] == [8]
    every = list(combinations(sorted(members), 2))
    kept = ngram_join.surviving(members, every, 256, 0.6)
    full = {k: (sets[k[0]].astype("<u8").tobytes(), 1) for k in members}
    assert {(p[0], q[0]) for p, q, _, _ in ngram_join.verified(full, kept, 0.6)} == set(brute(rows)) and len(kept) < len(every)


def test_bound_never_prunes_a_partner():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: draw.integers(100, 400)], draw.integers(0, 2**63, draw.integers(0, 150), dtype=np.uint64)])) for _ in range(200)]
    points = np.stack([ngram_join.group_counts(s, 64) for s in sets])
    tree = ngram_join.CountRTree(points, np.array([len(s) for s in sets]))
    for a in range(len(sets)):
        found = set(tree.partners(a, 0.6).tolist())
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.6 * (len(sets[a]) + len(sets[b]) - both):
                assert b in found


def test_full_groups_never_prune_a_partner():
    a = np.arange(70_000, dtype=np.uint64) * np.uint64(8)
    sets = [a, a[:66_000]]
    sizes = np.array([len(s) for s in sets])
    points = np.stack([ngram_join.unpack_counts(ngram_join.pack_counts(ngram_join.group_counts(s, 8)), 8, len(s)) for s in sets])
    assert ngram_join.CountRTree(points, sizes).partners(0, 0.9).tolist() == [0, 1]
    small = np.array([3, 65_534, 0, 0])
    assert (ngram_join.unpack_counts(ngram_join.pack_counts(small), 4, 65_537) == small).all()
    few = np.array([3, 15, 0, 7])
    assert len(ngram_join.pack_counts(few)) == 2 and (ngram_join.unpack_counts(ngram_join.pack_counts(few), 4, 25) == few).all()


def test_points_fold_to_fewer_groups():
    s = np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.uint64)
    assert ngram_join.n_groups(5000) == 4096 and ngram_join.n_groups(1) == 256 and ngram_join.n_groups(10**7) == 1 << 16
    assert (ngram_join.fold(ngram_join.group_counts(s, 8192), 512) == ngram_join.group_counts(s, 512)).all()


def test_a_split_part_meets_every_pair_once():
    draw = np.random.default_rng(1)
    p = np.zeros(300, ngram_join._FIELDS)
    p["tag"], p["n"], p["at"], p["x"] = draw.integers(0, 3, 300), 10, 0, np.arange(300)
    p["one"], p["two"] = draw.integers(0, 2**32, 300), draw.integers(0, 2**32, 300)
    want = {(int(a), int(b)) for a in range(300) for b in range(a + 1, 300) if p["tag"][a] == p["tag"][b]}

    def met(part, sided, depth):
        found = Counter()
        if depth == 0:
            for _, ax, _, bx, _ in ngram_join.meets(np.concatenate([b for _, b in sided]), np.concatenate([np.full(len(b), s, np.int8) for s, b in sided]), part, 0.6, 4000):
                found.update(zip(ax.tolist(), bx.tolist(), strict=True))
            return found
        smaller = {}
        for s, b in sided:
            for name, side, blob in ngram_join.split_part(part, s, b):
                smaller.setdefault(name, []).append((side, ngram_join._unpack([blob])))
        for name, parts in smaller.items():
            found.update(met(name, parts, depth - 1))
        return found

    for depth in range(3):
        assert met(7, [(0, p)], depth) == Counter(dict.fromkeys(want, 1))


def test_rows_of_one_id_are_one_document(spark):
    draw = random.Random(4)
    a, b, c = (" ".join(f"w{draw.randrange(9000)}" for _ in range(60)) for _ in range(3))
    rows = [(3, f"{a} x", None, None, None), (5, a, None, None, None), (5, b, None, None, None), (4, f"{b} y", None, None, None), (7, c, None, None, None), (7, f"{c} {a} {b}", None, None, None)]
    assert {r.doc_id for r in ngram_join.keep_one(cases.table(spark, rows)).collect()} == {3, 7}
    assert result(ngram_join.similar_documents(cases.table(spark, rows))) == {3: (3, 1), 5: (3, 2), 4: (3, 1), 7: (7, 0)}
    rows = [(3, f"{a} x", None, None, None), (5, a, None, None, None), (5, b, None, None, None), (9, f"{b} y", None, None, None)]
    assert {r.doc_id for r in ngram_join.keep_one(cases.table(spark, rows)).collect()} == {3}


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    assert result(ngram_join.similar_documents(docs)) == {i: (4, 1) if i in (4, 5) else (i, 0) for i in range(1, 10)}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 6, 7, 8, 9]


def test_ids_of_other_kinds(spark):
    rows = [("5", cases.PLAIN), ("12", cases.PLAIN), (None, cases.PLAIN)]
    assert result(ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id string, text string"))) == {5: (5, 1), 12: (5, 1)}
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(Exception, match="whole numbers"):
                ngram_join.similar_documents(spark.createDataFrame([("a-1", cases.PLAIN)], "doc_id string, text string")).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")


def test_chains_keep_their_least(spark):
    words = [f"t{k}" for k in range(60)]
    rows = [(9 - k, " ".join(words[4 * k : 4 * k + 40]), None, None, None) for k in range(6)] + [(50, "something else altogether here", None, None, None)]
    assert {r.doc_id for r in ngram_join.keep_one(cases.table(spark, rows)).collect()} == {4, 50}


def test_large_group_of_near_copies(spark):
    rows = [(k, f"{cases.PLAIN} {cases.PLAIN} {cases.PLAIN} extra{k}", None, None, None) for k in range(300)]
    assert [r.doc_id for r in ngram_join.keep_one(cases.table(spark, rows)).collect()] == [0]
    assert result(ngram_join.similar_documents(cases.table(spark, rows))) == {k: (0, 299) for k in range(300)}


@pytest.mark.parametrize("left", [0, 70])
def test_kin_is_counted_as_all_pairs_are(monkeypatch, left):
    for name, value in (("_ROWS", 32), ("_COLUMNS", 16), ("_MEETS", 50), ("_DENSE", 0.2)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = edited(random.Random(8), 3, 50, 60) + [(150 + k, f"lone w{k} w{k + 1}", None, None, None) for k in range(9)]
    sets = [np.unique(s) for s in ngram_join.gram_sets(__import__("pyarrow").array([r[1] for r in rows]), 3)]
    left = left or len(sets)
    want = {p: j for p, j in brute(rows).items() if left == len(sets) or p[0] < left <= p[1]}
    found = {}
    for lo, begin, shared, similar in ngram_join.near(sets, left, 0.6):
        for i, j in zip(*np.nonzero(similar), strict=True):
            a, b, s = int(i) + lo, int(j) + begin, float(shared[i, j])
            assert (a, b) not in found
            found[a, b] = s / (len(sets[a]) + len(sets[b]) - s)
    assert found == pytest.approx(want) and len(want) > 100
    copies = np.arange(len(sets)) % 3 + 1
    links, root = ngram_join.kin_links(sets, copies, left, 0.6)
    assert links.tolist() == [sum(copies[q if p == k else p] for p, q in want if k in (p, q)) for k in range(len(sets))]
    assert root.tolist() == list(roots(range(len(sets)), want).values())


def test_cells_leave_out_pairs_of_one_kin():
    draw = np.random.default_rng(6)
    p = np.zeros(200, ngram_join._FIELDS)
    p["tag"], p["n"], p["x"], p["kin"] = draw.integers(0, 3, 200), 10, np.arange(200), draw.integers(0, 4, 200)
    p["one"], p["two"] = draw.integers(0, 2**32, 200), draw.integers(0, 2**32, 200)
    want = {(a, b) for a, b in combinations(range(200), 2) if p["tag"][a] == p["tag"][b] and not p["kin"][a] == p["kin"][b] > 0}
    found = Counter()
    for _, ax, _, bx, _ in ngram_join.meets(p, np.zeros(200, np.int8), 7, 0.6, 4000):
        found.update(zip(ax.tolist(), bx.tolist(), strict=True))
    assert found == Counter(dict.fromkeys(want, 1))


def test_near_copies_of_a_text_make_no_rows_of_pairs(spark):
    draw = random.Random(12)
    rows = edited(draw, 2, 150) + [(300 + k, " ".join(f"w{draw.randrange(9000)}" for _ in range(80)), None, None, None) for k in range(100)]
    rows += [(400, rows[0][1], None, None, None), (401, rows[7][1], None, None, None)]
    docs = cases.table(spark, rows)
    want = brute(rows)
    assert ngram_join.Join(docs, "doc_id", "text").survivors.count() < len(want) / 50
    for how in ({"kin": 40}, {"sample": 30}):
        assert result(ngram_join.similar_documents(docs, **how)) == expected(rows)
    assert {(r.doc_id_a, r.doc_id_b) for r in ngram_join.similar_pairs(docs, kin=40).collect()} == set(unlike(rows, want))


def test_similar_pairs_meet_twice_and_chance_ones_do_not():
    rows = edited(random.Random(3), 12, 6, 50) + [(72 + k, " ".join(f"u{k}x{j}" for j in range(40)) + " one same end", None, None, None) for k in range(30)]
    sets = [np.unique(s) for s in ngram_join.gram_sets(__import__("pyarrow").array([r[1] for r in rows]), 3)]
    name = {ngram_join._identity(s): k for k, s in reversed(list(enumerate(sets)))}
    for seed in range(5):
        ranks = np.random.default_rng(seed).integers(0, 255, 512).astype(np.uint8)
        full = np.concatenate([ngram_join.prefix(sets[k], x, 0, ranks, 0.6) for x, k in name.items()])
        p = np.empty(len(full), ngram_join._FIELDS)
        for f in ngram_join._FIELDS.names:
            p[f] = full[f]
        met = Counter()
        for _, ax, _, bx, _ in ngram_join.meets(p, np.zeros(len(p), np.int8), 7, 0.6, 4000):
            met.update(tuple(sorted((name[a], name[b]))) for a, b in zip(ax.tolist(), bx.tolist(), strict=True))
        twice = {q for q, c in met.items() if c >= ngram_join.meetings(0.6)}
        assert set(unlike(rows, brute(rows))) <= twice and not any(a >= 72 for a, _ in twice)
    assert ngram_join.meetings(0.5) == 1


def test_empty_table(spark):
    assert ngram_join.similar_documents(cases.empty(spark)).count() == 0
    assert ngram_join.similar_pairs(cases.empty(spark)).count() == 0
    assert ngram_join.keep_one(cases.empty(spark)).count() == 0
