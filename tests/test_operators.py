"""Column functions, closures and catalog rules on small inputs."""

from __future__ import annotations

import random
from collections import deque
from pathlib import Path

from pyspark.sql import functions as F

from glyphmine import stage
from glyphmine.functions import text as T
from glyphmine.model import CodeIndex
from glyphmine.operators import catalog, graph, quality, symbol
from glyphmine.schemas import TABLES


def apply(spark, function, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", function(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.k)]


def test_normalized_names(spark):
    want = {"Better Farms": "better-farms", "big_map_v1.2": "big-map", "Tools 2.0 beta": "tools", "v3": "v3", "ALL CAPS": "all-caps", "city-1.0.4-final": "city", "大地图": "大地图", "x_": "x"}
    assert apply(spark, T.normalize_name, list(want)) == list(want.values())


def test_classes_of_literals(spark):
    want = {"": "other", "a/b": "path_like", "a\\b": "path_like", "two words": "localization_like", "a b": "localization_like", "name_1": "possible_identifier", "1.png": "possible_asset_id", "a-b": "other", "a-b.c": "possible_asset_id", "é": "other", None: "other"}
    assert apply(spark, T.classify_string, list(want)) == list(want.values())


def test_generics_and_arity(spark):
    assert apply(spark, T.strip_generics, ["List<Dict<int,string>>", "A<B>.C<D>", "x"]) == ["List", "A.C", "x"]
    signatures = ["F()", "F(int)", "F(int,string)", "F(Map<int,string>)", "F((int,int),int[,])"]
    assert apply(spark, T.arity, signatures) == [0, 1, 2, 1, 2]
    assert apply(spark, lambda c: T.arity(c, parity=True), signatures[:3]) == [0, 1, 5]


def test_substrings_ignore_ascii_case_alone(spark):
    assert apply(spark, lambda c: T.has_substring(c, "ÉA_%"), ["xÉa_%", "xéa_%", "xÉab"]) == [True, False, False]
    assert apply(spark, lambda c: T.like_unescaped(c, "a_b"), ["a_b", "a\\xb", "A\\?B"]) == [False, True, True]


def test_closure_is_a_breadth_first_search(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(40), draw.randrange(40)) for _ in range(70)]
    below: dict[int, list[int]] = {}
    for a, b in edges:
        below.setdefault(a, []).append(b)
    want = set()
    for root in (0, 7):
        depth, todo = {root: 0}, deque([root])
        while todo:
            x = todo.popleft()
            for y in below.get(x, []):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    todo.append(y)
        want |= {(root, x, d) for x, d in depth.items()}
    roots = spark.createDataFrame([(0,), (7,)], "id int")
    found = graph.reachable(spark.createDataFrame(edges, "src int, dst int"), roots).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_pattern_rules(spark):
    fields = "id string, category string, tier string, status string, references array<string>, file string"
    patterns = spark.createDataFrame([("a", "ui", "S", "Verified", ["m1"], "a.md"), ("b", "odd", "Z", "Inferred", ["m2"], "b.md"), ("b", "ui", "A", "Strong Verified", [], "c.md")], fields)
    texts = spark.createDataFrame([("a.md", "# Goal\nsee X.cs:12"), ("c.md", "# Goal"), ("d.md", "x")], "file string, text string")
    known = spark.createDataFrame([("m1",)], "source_id string")
    found = {tuple(r) for r in catalog.pattern_problems(patterns, texts, known, ("# Goal",), ("ui",), expected=3).collect()}
    assert {("duplicate id", "b"), ("section", "b"), ("evidence", "b"), ("inferred", "b"), ("tier", "b"), ("category", "b"), ("reference", "b"), ("files", "b.md"), ("files", "d.md")} <= found
    assert not any(s == "a" for _, s in found) and not any(r == "cardinality" for r, _ in found)


def test_symmetric_difference_takes_nulls_as_equal_or_apart_alike(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([1, 1, 2], [2, 3]))
    assert {tuple(r) for r in quality.symmetric_difference(a, b, ["k"]).collect()} == {(1, "left"), (3, "right")}


def test_lookups_reach_beyond_a_hundred_candidates(spark):
    def table(name, rows):
        return spark.createDataFrame(rows, "id long, source_id long, type_id long, name string, full_name string, signature string, is_compiler_generated int").selectExpr(*(f"CAST({c} AS {t}) AS {c}" if c in ("id", "source_id", "type_id", "name", "full_name", "signature", "is_compiler_generated") else f"CAST(NULL AS {t}) AS {c}" for c, t in (x.split()[:2] for x in TABLES[name].split(", "))))

    types = [(k, 1, None, "Many", f"N{k}.Many", None, 0) for k in range(130)] + [(500, 1, None, "One", "N.One", None, 0)]
    methods = [(k, 1, 500, "Do", None, f"Do(T{k:03d})", None) for k in range(130)]
    sources = spark.createDataFrame([(1, "game")], "id long, source_id string")
    idx = CodeIndex(spark, {"types": table("types", types), "methods": table("methods", methods), "sources": sources})
    assert symbol.lookup(idx, "One.Do(T120)")["row"].signature == "Do(T120)"
    assert len(symbol.lookup(idx, "N.One.Do")["candidates"]) == len(symbol.lookup(idx, "Many")["candidates"]) == len(symbol.symbol(idx, "Many")["candidates"]) == 130


def test_extractions_need_a_type_of_the_loader(spark):
    def verdict(loader, **changed):
        files = {f"a/F{k:02d}.cs": "using X;\nclass Y { }" for k in range(50)} | {"a/a.csproj": "<x/>", "b.txt": "1"} | {k.replace("__", "/") + ".cs": v for k, v in changed.items()}
        df = spark.createDataFrame([(k, v.encode()) for k, v in files.items()], "relative_path string, content binary")
        return quality.validate_extraction(df, loader).first()

    found = verdict(False)
    assert (found.ok, found.csharp_files, found.total_files, found.total_bytes, found.project_files, found.problems) == (True, 50, 52, 50 * 20 + 5, 1, [])
    found = verdict(True)
    assert not found.ok and found.namespace_hits == 0 and found.problems == ["no NeoModLoader-namespace types found in output"]
    found = verdict(True, a__F07="using X;\n  namespace NeoModLoader.api { }")
    assert found.ok and found.namespace_hits == 1 and found.problems == []
    found = verdict(False, a__F00=" \n", a__F10="class \x00", a__F20="text", a__F21="")
    assert not found.ok and found.problems == ["empty sample F00.cs", "binary content in sample F10.cs", "no C# syntax in sample F20.cs"]
    none = quality.validate_extraction(spark.createDataFrame([], "relative_path string, content binary"), True).first()
    assert not none.ok and none.problems == ["no .cs files produced", "no NeoModLoader-namespace types found in output"] and none.total_bytes == 0


def test_tables_are_written_side_by_side_and_dropped(spark):
    before = spark.conf.get(stage._CLEANUP, "false")
    tables = stage.materialize_all({f"t{k}": spark.range(k * 10).repartition(3) for k in range(6)})
    assert {n: t.count() for n, t in tables.items()} == {f"t{k}": k * 10 for k in range(6)} and spark.conf.get(stage._CLEANUP, "false") == before
    stage.discard(tables["t1"])
    folder = stage.file_system(tables["t2"].stage_path)[1]
    assert Path(folder).is_dir() and not Path(stage.file_system(tables["t1"].stage_path)[1]).exists()


def test_names_of_file_systems(monkeypatch):
    monkeypatch.setattr(stage, "_open", lambda uri: (None, uri))
    assert [stage.file_system(u)[1] for u in ("s3a://bucket/x", "hdfs://name/x", "dbfs:/tmp/x")] == ["s3://bucket/x", "hdfs://name/x", "/dbfs/tmp/x"]
