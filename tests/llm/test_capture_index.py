"""The capture index against one global sort."""

from __future__ import annotations

import heapq
import random

from pyspark.sql import functions as F

from glyphmine.llm import capture_index

from ..compare import SF, same
from . import cases

PAGES = "page_id long, url string, html string"


def test_agrees_with_sql(spark):
    assert same(capture_index.op6_capture_index(spark, SF), capture_index.ORACLE_SQL)


def test_loser_tree_merges():
    draw = random.Random(8)
    for k in range(12):
        runs = [sorted(draw.choices(range(50), k=draw.randrange(20))) for _ in range(k)]
        assert list(capture_index.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


def test_url_keys(spark):
    want = {
        "http://www.Example.com/A/b/": "com,example)/a/b",
        "https://user@sub.example.com:8080?b=2&a=1#top": "com,example,sub)/?a=1&b=2",
        "example.com": "com,example)/",
        "HTTP://WWW2.x.org/?": "org,x)/",
        "": ")/",
    }
    rows = cases.table(spark, [(u,) for u in want], "url string").select("url", capture_index.url_key(F.col("url")).alias("k")).collect()
    assert {r.url: r.k for r in rows} == want


def test_histories_with_a_hot_key(spark):
    draw = random.Random(1)
    rows = [(k, "http://hot.example/" if draw.random() < 0.7 else f"http://h{draw.randrange(30)}.example/p{draw.randrange(4)}", f"<p>{draw.randrange(3)}") for k in range(4000)]
    draw.shuffle(rows)
    found = capture_index.capture_index(cases.table(spark, rows, PAGES).repartition(7)).collect()
    assert sorted(r.global_no for r in found) == list(range(4000))
    found.sort(key=lambda r: r.global_no)
    assert [(r.urlkey, r.timestamp, r.page_id) for r in found] == sorted((r.urlkey, r.timestamp, r.page_id) for r in found)
    before = {}
    for r in found:
        n, digest = before.get(r.urlkey, (-1, None))
        assert r.capture_no == n + 1 and r.revisit == (digest == r.digest)
        before[r.urlkey] = (r.capture_no, r.digest)


def test_history_crosses_ranges(spark):
    """Ranges are forced small, so that the hot key fills several."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(k, "http://hot.example/", "<p>same" if k % 50 else f"<p>{k}") for k in range(900)] + [(k, f"http://a{k}.example/", "x") for k in range(900, 1000)]
        df = capture_index.capture_index(cases.table(spark, rows, PAGES).repartition(5))
        found = sorted(df.collect(), key=lambda r: r.global_no)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    hot = [r for r in found if r.urlkey == "example,hot)/"]
    assert [r.capture_no for r in hot] == list(range(900)) == [r.page_id for r in hot]
    assert [r.revisit for r in hot] == [k > 0 and a.digest == r.digest for k, (a, r) in enumerate(zip([hot[0], *hot], hot, strict=False))]
    assert [r.global_no for r in found] == list(range(1000))


def test_ids_of_any_size(spark):
    ids = [2**62, 2**40, 5_000_000_000, 3, -1, -(2**62), 4_190_000_000, -1_060_000_000]
    found = sorted(capture_index.capture_index(cases.table(spark, [(i, "http://a.b/", "x") for i in ids], PAGES)).collect(), key=lambda r: r.global_no)
    timed = [i for i in ids if capture_index._FIRST <= i <= capture_index._LAST]
    assert [r.page_id for r in found] == sorted(set(ids) - set(timed)) + sorted(timed)
    assert [r.page_id for r in found if r.timestamp] == sorted(timed) == [-1_060_000_000, -1, 3, 4_190_000_000]
    assert all(len(r.timestamp) == 14 for r in found if r.timestamp)


def test_ranges_beyond_the_held_bytes_are_merged_from_runs(spark):
    draw = random.Random(3)
    rows = [(k, f"http://h{draw.randrange(30)}.example/p{draw.randrange(4)}", f"<p>{draw.randrange(3)}") for k in range(3000)]
    docs = cases.table(spark, rows, PAGES).repartition(6)
    small = sorted(map(tuple, capture_index.capture_index(docs, held_bytes=20_000).collect()))
    assert small == sorted(map(tuple, capture_index.capture_index(docs).collect())) and len(small) == 3000


def test_awkward_rows(spark):
    rows = [(None, "http://a.b/", "x"), (1, None, "x"), (2, "http://a.b/", None), (3, "http://a.b/", "x"), (3, "http://a.b/", "x"), (4, "", ""), (5, "http://a.b/", "y" * 2_000_000)]
    df = cases.table(spark, rows, PAGES).withColumns({c: F.lit("!") for c in ("urlkey", "timestamp", "digest", "n_bytes", "range", "start", "n", "first")})
    found = sorted(capture_index.capture_index(df).collect(), key=lambda r: r.global_no)
    assert [(r.page_id, r.capture_no, r.n_bytes, r.revisit) for r in found] == [(4, 0, 0, False), (None, 0, 1, False), (2, 1, 0, False), (3, 2, 1, False), (3, 3, 1, True), (5, 4, 2_000_000, False)]
    assert found[1].timestamp is None and found[2].digest is None
    assert capture_index.capture_index(cases.table(spark, [], PAGES)).count() == 0


def test_named_time_column(spark):
    df = cases.table(spark, [(1, "http://a/", "x", "2024-05-01 00:00:00"), (2, "http://a/", "x", "2023-05-01 00:00:00")], f"{PAGES}, seen string")
    assert [r.page_id for r in sorted(capture_index.capture_index(df, time_col="seen").collect(), key=lambda r: r.global_no)] == [2, 1]
