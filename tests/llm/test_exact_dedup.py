"""Patricia-trie owners against grouping by text."""

from __future__ import annotations

import random
from collections import Counter

from glyphmine.llm import common, exact_dedup

from ..compare import SF, same
from . import cases


def brute(rows) -> Counter:
    least: dict = {}
    for i, t, *_ in rows:
        if t is not None and i is not None:
            least[t] = min(least.get(t, i), i)
    return Counter((i, i if t is None else least.get(t)) for i, t, *_ in rows)


def got(df) -> Counter:
    return Counter((r.doc_id, r.owner_id) for r in df.collect())


def test_agrees_with_sql(spark):
    assert same(exact_dedup.op7_exact_dedup(spark, SF), exact_dedup.ORACLE_SQL)


def test_awkward_rows(spark):
    assert got(exact_dedup.exact_owners(cases.awkward(spark))) == brute(cases.ROWS)


def test_empty_table(spark):
    assert exact_dedup.exact_owners(cases.empty(spark)).count() == 0
    assert exact_dedup.keep_owners(cases.empty(spark)).count() == 0


def test_spilled_subtrees_give_the_same_owners(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices("ab", k=draw.randrange(60))) for _ in range(400)]
    rows = [(k, draw.choice(texts), None, None, None) for k in range(3000)]
    assert got(exact_dedup.exact_owners(cases.table(spark, rows), trie_bytes=4000)) == brute(rows)


def test_trie_spills_and_reads_back(spark):
    draw = random.Random(5)
    trie = exact_dedup.PatriciaTrie(2000, common.shared_path(spark, "trie"))
    want: dict[bytes, list[int]] = {}
    for k in range(2000):
        key = bytes(draw.choices(b"xyz", k=draw.randrange(9)))
        trie.insert(key, k)
        want.setdefault(key, []).append(k)
    assert trie.runs
    assert dict(trie.items()) == {key: min(m) for key, m in want.items()}


def test_a_million_copies_fit_a_small_budget():
    trie = exact_dedup.PatriciaTrie(1 << 20, "nowhere://")
    text = b"one text " * 100
    for k in range(1_000_000, 0, -1):
        trie.insert(text, k)
    assert trie.used < 2000 and list(trie.items()) == [(text, 1)]


def test_spills_know_the_names_of_hadoop(monkeypatch):
    monkeypatch.setattr(common, "_open", lambda uri: (None, uri))
    assert [common.file_system(u)[1] for u in ("s3a://bucket/x", "hdfs://name/x", "dbfs:/tmp/x")] == ["s3://bucket/x", "hdfs://name/x", "/dbfs/tmp/x"]


def test_keys_that_are_prefixes_of_each_other():
    trie = exact_dedup.PatriciaTrie()
    for k, key in enumerate([b"abc", b"ab", b"", b"abcd", b"b", b"ab"]):
        trie.insert(key, k)
    assert list(trie.items()) == [(b"", 2), (b"ab", 1), (b"abc", 0), (b"abcd", 3), (b"b", 4)]


def test_colliding_hashes_stay_apart(spark):
    rows = spark.createDataFrame([(3, 7, 1, "abc"), (3, 7, 2, "abd"), (3, 7, 3, "abc")], "len long, hash long, id long, text string")
    assert {(r.id, r.owner) for r in exact_dedup._owners(rows, 1 << 20).collect()} == {(1, 1), (3, 1), (2, 2)}


def test_keep_owners(spark):
    docs = cases.awkward(spark)
    kept = exact_dedup.keep_owners(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, 1, 2, 3, 4, 6, 7, 8, 9])


def test_keep_owners_of_null_ids(spark):
    kept = exact_dedup.keep_owners(cases.table(spark, [(None, "t", "a", None, 1), (None, "t", "b", None, 2), (None, None, "c", None, 3)]))
    assert sorted((r.text or "", r.lang) for r in kept.collect()) == [("", "c"), ("t", "a")]
