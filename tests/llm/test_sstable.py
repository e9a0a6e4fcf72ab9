"""Round trips, lookups and the layout of sorted string tables."""

from __future__ import annotations

from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmine.llm import sstable

from ..compare import SF
from . import cases


def build(rows, **how) -> bytes:
    writer, out = sstable.Writer(**how), []
    for i, v in rows:
        out += writer.add(i, v)
    out += writer.finish()
    assert [r[4] for r in out] == [sum(len(x[5]) for x in out[:k]) for k in range(len(out))]
    return b"".join(r[5] for r in out)


def files(rows) -> dict[int, bytes]:
    parts = defaultdict(list)
    for r in rows:
        parts[r.shard].append((r.seq, bytes(r.payload)))
    return {k: b"".join(p for _, p in sorted(v)) for k, v in parts.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(1 << 63), (1 << 63) - 1), st.binary(max_size=40)), max_size=80), st.integers(1, 200), st.integers(1, 5))
def test_round_trip(rows, block_bytes, restart):
    rows = sorted(rows)
    table = sstable.Table(build(rows, block_bytes=block_bytes, restart=restart))
    assert list(table.scan()) == rows and table.n_records == len(rows)
    for i in {i for i, _ in rows}:
        assert table.may_hold(i) and table.get(i) == [v for k, v in rows if k == i]


def test_absent_keys_and_the_filter():
    table = sstable.Table(build([(2 * k, bytes([k % 256])) for k in range(5000)], block_bytes=500))
    assert all(table.get(2 * k + 1) == [] for k in range(2000))
    assert sum(table.may_hold(2 * k + 1) for k in range(5000)) < 150
    assert len(table.blocks) > 10 and table.last == sorted(table.last)


def test_prefixes_are_compressed():
    one = len(build([(k, b"") for k in range(1000)]))
    assert len(build([(k, b"") for k in range(2000)])) - one < 1000 * 7


def test_damage_is_found():
    data = bytearray(build([(k, b"value") for k in range(100)]))
    data[20] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Table(bytes(data)).scan())
    with pytest.raises(ValueError):
        sstable.Table(bytes(data[:-1]) + b"?")


def test_documents(spark):
    docs = cases.documents(spark)
    want = {r.doc_id: r.text for r in docs.collect()}
    got, last = {}, None
    for _, data in sorted(files(sstable.tables(docs, shard_docs=40).collect()).items()):
        table = sstable.Table(data)
        ids = [i for i, _ in table.scan()]
        assert ids == sorted(ids) and (last is None or ids[0] > last)
        last = ids[-1]
        for i in ids:
            (value,) = table.get(i)
            got[i] = sstable.decode_value(value)
    assert got == want
    assert sstable.op5_sorted_string_tables(spark, SF).filter("kind = 'footer'").count() >= 1


def test_shards_are_cut_without_a_list(spark):
    """One shard a document: nothing in the plan, on the driver or in a task grows with their number."""
    docs = spark.range(5000).selectExpr("id - 2500 as doc_id", "'x' as text")
    rows = sstable.tables(docs, shard_docs=1).filter("n_records > 0 and first_id is not null").orderBy("shard").select("first_id", "n_records").collect()
    assert [r.first_id for r in rows] == list(range(-2500, 2500)) and {r.n_records for r in rows} == {1}


def test_one_identifier_stays_in_one_shard(spark):
    docs = cases.table(spark, [(k // 50, f"text {k}", None, None, None) for k in range(500)])
    found = files(sstable.tables(docs, shard_docs=20).collect())
    assert sorted(len({i for i, _ in sstable.Table(d).scan()}) for d in found.values()) == [1] * 10


def test_awkward_rows(spark):
    (data,) = files(sstable.tables(cases.awkward(spark)).collect()).values()
    found = [(i, sstable.decode_value(v)) for i, v in sstable.Table(data).scan()]
    assert sorted(found, key=str) == sorted([(i, t) for i, t, *_ in cases.ROWS if i is not None], key=str)
    table = sstable.Table(data)
    assert len(table.get(5)) == 2 and sstable.decode_value(table.get(1)[0]) is None and sstable.decode_value(table.get(2)[0]) == ""
    assert sstable.decode_value(table.get(6)[0]) == cases.LONG


def test_written_files(spark, tmp_path):
    docs = cases.documents(spark)
    manifest = sstable.write_tables(sstable.tables(docs, shard_docs=60), tmp_path.as_uri()).collect()
    assert sum(r.n_bytes for r in manifest) == sum(p.stat().st_size for p in tmp_path.glob("*.sst"))
    held = {i for p in tmp_path.glob("*.sst") for i, _ in sstable.Table(p.read_bytes()).scan()}
    assert held == {r.doc_id for r in docs.select("doc_id").collect()} and len(manifest) == len(list(tmp_path.glob("*")))


def test_empty_table(spark):
    assert sstable.tables(cases.empty(spark)).count() == 0
