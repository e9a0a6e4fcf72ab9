"""Source windows of the query against DuckDB, on texts whose lines end in odd ways and on ids that come twice."""

from __future__ import annotations

from glyphmine.operators import symbol
from glyphmine.plans.queries import QUERIES, SQL

from .compare import same

TEXTS = ["", "\n", "\n\n\n", "a", "a\n", "a\n\n", "\na\n\n", "a\r\nb\rc\n", "a\x0bb\x0cc\x1cd\x85e f g\nh", "one\n\n\ntwo\n" * 9, "twice\n" * 30, "twice again\n" * 5]


def test_show_window_on_odd_texts(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(10, "another of id 10\n" * 25), (33, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert same(QUERIES["show_window"](spark, str(tmp_path)), SQL["show_window"], str(tmp_path))


def test_window_keeps_pythons_lines(spark):
    files = spark.createDataFrame([(str(k), t) for k, t in enumerate(TEXTS)], "path string, content string")
    places = spark.createDataFrame([(str(k), 1) for k in range(len(TEXTS))], "path string, line int")
    got = {(r.path, r.no): r.text for r in symbol.window(files, places, 100).collect()}
    assert got == {(str(k), no): line for k, t in enumerate(TEXTS) for no, line in enumerate(t.splitlines(), 1)}
