"""Work is spread over tasks by what it makes, not by the bytes of the table that it starts from; nothing is made that isn't asked for."""

from __future__ import annotations

import pytest

from glyphmine.operators.resolve import Rules
from glyphmine.plans import build, code_queries
from glyphmine.sources.snapshots import SourceSpec


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A folder with a small Parquet file of 6000 parts."""
    folder = tmp_path_factory.mktemp("parts")
    spark.range(6000).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_rendered_files_are_spread_over_tasks(spark, parts):
    counts = code_queries.source_files(spark, parts).select("relative_path").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(counts) == 6000 + 600 + 60 + 60
    assert max(counts) <= 4000


def test_index_tables_are_made_when_asked_for(spark, tmp_path):
    rows = [("game", "a.cs", "a.cs", ".cs", 9, "h", 1, b"class A { int f; B b; void M() { b.N(); } }"), ("game", "b.cs", "b.cs", ".cs", 9, "h", 1, b"class B { void N() { } }")]
    files = spark.createDataFrame(rows, "source_id string, relative_path string, filename string, extension string, size long, sha256 string, line_count long, content binary")
    idx, parsed = build.index_files(spark, [SourceSpec("game", "", "game", "1", "game-1")], files, Rules(primary="game"))
    assert parsed.count() == 2 and not idx.tables
    assert idx.files.count() == 2 and idx.fields.count() == 2 and set(idx.tables) == {"files", "fields"}
    assert idx.type_references.filter("resolution_status = 'resolved'").count() == 1 and "method_calls" not in idx.tables
    assert [r.resolution_status for r in idx.method_calls.collect()] == ["resolved"]
    idx.tables.fill()
    assert {"types", "strings", "inheritance", "symbol_references"} <= set(idx.tables)
