"""Positional index against scans of every text."""

from __future__ import annotations

import random

import numpy as np

from glyphmine.llm import decontaminate

from ..compare import SF, same
from . import cases

ITEM = "item_id long, text string, source string"


def tokens(text: str) -> list[str]:
    import re

    return re.sub(r"[^\w]+", " ", text.lower()).split()


def brute(docs, items, n=decontaminate.N, slop=decontaminate.SLOP, near_terms=decontaminate.NEAR_TERMS) -> dict:
    """(doc, item) with the number of phrase places, and whether there is a proximity match."""
    found = {}
    for i, body, *_ in docs:
        words = tokens(body or "")
        have = set(words)
        for k, text, *_ in items:
            w = tokens(text or "")
            phrases, near = 0, False
            for at in range(max(1, len(w) - n + 1)) if w else ():
                window = w[at : at + n]
                if not have.issuperset(window):
                    continue
                phrases += sum(words[p : p + len(window)] == window for p in range(len(words) - len(window) + 1))
                terms = set(window)
                if len(terms) >= near_terms:
                    reach = len(window) + slop
                    near |= any(terms <= set(words[p : p + reach]) for p in range(len(words)))
            if i is not None and k is not None and (phrases or near):
                old = found.get((i, k), (0, False))
                found[i, k] = (max(old[0], phrases), old[1] or near)
    return found


def got(df) -> dict:
    return {(r.doc_id, r.item_id): (r.n_phrase, r.n_near > 0) for r in df.collect()}


def test_agrees_with_sql(spark):
    assert same(decontaminate.op9_decontamination(spark, SF), decontaminate.ORACLE_SQL)


def test_random_texts(spark):
    draw = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(draw.choices(vocabulary, k=draw.randrange(0, 300)))) for k in range(40)]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.randrange(1, 9)))) for k in range(20)]
    for k in range(20, 30):
        body = docs[k][1].split()
        piece = body[10:26]
        if k % 2:
            draw.shuffle(piece)
        items.append((k, " ".join(piece)))
    for n, slop, near in ((13, 4, 8), (3, 2, 2)):
        found = decontaminate.find_leaks(cases.table(spark, docs, "doc_id long, text string"), cases.table(spark, items, "item_id long, text string"), n=n, slop=slop, near_terms=near)
        assert got(found) == brute(docs, items, n, slop, near)


def test_benchmark_in_several_passes(spark):
    docs, items = cases.documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {tuple(r) for r in decontaminate.find_leaks(docs, items).collect()}
    assert one and {tuple(r) for r in decontaminate.find_leaks(docs, items, benchmark_bytes=2000).collect()} == one


def test_one_index_serves_several_benchmarks(spark):
    docs, items = cases.documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    index = decontaminate.build_index(docs)
    for half in (items.filter("item_id % 2 = 0"), items.filter("item_id % 2 = 1")):
        assert {tuple(r) for r in decontaminate.probe(index, half).collect()} == {tuple(r) for r in decontaminate.find_leaks(docs, half).collect()}


def test_a_large_benchmark_is_found(spark):
    """A megabyte of items: each fifth one is copied from a document, the others' terms occur but not in that order."""
    draw = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs = [(k, " ".join(draw.choices(vocabulary, k=200))) for k in range(300)]
    items, want = [], set()
    for k in range(4000):
        words = draw.choices(vocabulary, k=45)
        if k % 5 == 0:
            d, at = draw.randrange(300), draw.randrange(150)
            words[20:40] = docs[d][1].split()[at : at + 20]
            want.add((d, k))
        items.append((k, " ".join(words)))
    assert sum(len(x) for _, x in items) > 900_000
    found = got(decontaminate.find_leaks(cases.table(spark, docs, "doc_id long, text string"), cases.table(spark, items, "item_id long, text string")))
    assert {p for p, (phrases, _) in found.items() if phrases} == want


def test_postings_survive_coding():
    draw = np.random.default_rng(1)
    for top in (1 << 20, 1 << 34):
        places = np.unique(draw.integers(0, top, 5000))
        of = draw.integers(-50, 50, len(places))
        terms, ends, back = decontaminate.decode(*decontaminate.encode(of, places))
        assert terms.tolist() == np.unique(of).tolist()
        assert all((back[a:b] == places[of == t]).all() for t, a, b in zip(terms, [0, *ends[:-1]], ends, strict=True))
    assert [len(x) for x in decontaminate.decode(*decontaminate.encode(places[:0], places[:0]))] == [0, 0, 0]


def test_every_term_is_stored(spark):
    rows = decontaminate.build_index(cases.table(spark, [(1, "a b a c", None, None, None), (2, "d a", None, None, None)]).coalesce(1)).collect()
    terms, ends, _ = decontaminate.decode(bytes(rows[0].terms), bytes(rows[0].counts), bytes(rows[0].places))
    assert len(rows) == 1 and len(terms) == 4 and ends[-1] == 6


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    piece = " ".join(cases.LONG.split()[70_000:70_020])
    items = [(1, cases.PLAIN, "q"), (1, cases.PLAIN, "q"), (2, None, "q"), (3, "", "q"), (None, cases.PLAIN, "q"), (4, piece.upper(), "q"), (5, "?!", "q"), (6, "no such words anywhere", "q")]
    benchmark = cases.table(spark, items, ITEM)
    found = got(decontaminate.find_leaks(docs, benchmark))
    assert found == brute(cases.ROWS, items) and found.keys() == {(4, 1), (5, 1), (6, 4)}
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, -1, 1, 2, 3, 7, 8, 9]


def test_phrase_across_two_documents_is_none(spark):
    words = cases.PLAIN.split()
    docs = cases.table(spark, [(1, " ".join(words[:8])), (2, " ".join(words[8:]))], "doc_id long, text string").coalesce(1)
    assert decontaminate.find_leaks(docs, cases.table(spark, [(1, " ".join(words[2:15]), None)], ITEM)).count() == 0


def test_empty_tables(spark):
    items = cases.table(spark, [(1, cases.PLAIN, None)], ITEM)
    assert decontaminate.find_leaks(cases.empty(spark), items).count() == 0
    assert decontaminate.find_leaks(cases.awkward(spark), cases.table(spark, [], ITEM)).count() == 0
    assert decontaminate.keep_clean(cases.awkward(spark), cases.table(spark, [], ITEM)).count() == len(cases.ROWS)
