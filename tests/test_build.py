"""Builds from source files: declarations, references, publishing, and the verbs over the result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphmine.model import open_index
from glyphmine.operators import graph, nav, search, stats, symbol
from glyphmine.operators.resolve import Rules
from glyphmine.plans.build import BuildError, build_index
from glyphmine.sources.snapshots import SourceSpec, fingerprint, scan

from .fixtures import ADDON, BROKEN, HERBS, NOTHING, SHAPES, write

VALID = dict(core_types=("Bed",), primary="garden", failed_per_cent={"garden": 40})


@pytest.fixture(scope="module")
def specs(tmp_path_factory):
    root = tmp_path_factory.mktemp("snapshots")
    garden = write(root / "garden", {"Shapes.cs": SHAPES, "more/Herbs.cs": HERBS, "zz/Half.cs": BROKEN, "zz/Nothing.cs": NOTHING, "notes.txt": "no source"})
    addon = write(root / "addon", {"Addon.cs": ADDON})
    return [SourceSpec("garden", garden, "game", "1.0", "garden-1"), SourceSpec("addon", addon, "loader", "2.0", "addon-2")]


@pytest.fixture(scope="module")
def built(spark, specs, tmp_path_factory):
    path = tmp_path_factory.mktemp("index").as_uri()
    assert build_index(spark, specs, path, Rules(primary="garden"), VALID) == "CREATED"
    return path, open_index(spark, path)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def calls(idx, caller: str):
    m = idx.methods.select(F.col("id").alias("caller_method_id"), "signature", F.col("type_id"))
    t = idx.types.select(F.col("id").alias("type_id"), "full_name")
    owned = idx.method_calls.join(m, "caller_method_id").join(t, "type_id").filter(F.concat_ws(".", "full_name", "signature") == caller)
    return rows(owned, "callee_name", "declaring_type_hint", "callee_signature_hint", "resolution_status")


def test_files(built):
    _, idx = built
    status = dict(rows(idx.files, "relative_path", "parse_status"))
    assert status == {"Shapes.cs": "OK", "more/Herbs.cs": "OK", "zz/Half.cs": "PARTIAL", "zz/Nothing.cs": "FAILED", "Addon.cs": "OK"}
    assert dict(rows(idx.files, "relative_path", "line_count"))["Shapes.cs"] == SHAPES.count("\n") + 1


def test_inheritance_within_and_across(built):
    _, idx = built
    t = {r.id: r.full_name for r in idx.types.collect()}
    edges = {(t[r.type_id], r.relation, r.target_name): t.get(r.target_type_id) for r in idx.inheritance.collect()}
    assert edges["Garden.Beds.HerbBed", "base", "Bed"] in (None, "Garden.Beds.Bed")
    assert edges["Garden.Beds.Bed", "base", "Plot"] == "Garden.Beds.Plot"
    assert edges["Addon.Greenhouse", "base", "Garden.Beds.Bed"] == "Garden.Beds.Bed"


def test_calls_are_resolved_by_static_type(built):
    _, idx = built
    found = calls(idx, "Garden.Beds.HerbBed.Water(int)")
    by = {(n, s) for n, _, _, s in found}
    assert ("Find", "resolved") in by and ("Area", "resolved") in by and ("Ping", "resolved") in by and ("Log", "external") in by and ("Water", "resolved") in by
    assert any(n == "Go" and s in ("unresolved", "external") for n, s in by)
    assert ("Area", "Garden.Beds.Plot", "Area()", "resolved") in found
    assert ("Water", "Garden.Beds.Bed", "Water(int)", "resolved") in found
    assert ("Water", "Garden.Beds.Bed", "Water(int)", "resolved") in calls(idx, "Garden.Beds.Bed.Water(string,int)")
    assert ("Water", "Addon.Greenhouse", "Water(int)", "resolved") in calls(idx, "Addon.Greenhouse.Open(Garden.Beds.Plot)")


def test_member_uses(built):
    _, idx = built
    found = rows(idx.symbol_references.filter("resolution_status = 'resolved'"), "target_logical_key", "reference_kind")
    for want in (("property:garden:Garden.Beds.Bed.Moisture", "read_write"), ("field:garden:Garden.Beds.Plot.size", "write"), ("field:garden:Garden.Beds.Plot.size", "read_write"), ("field:garden:Garden.Beds.HerbBed.planted", "read_write"), ("field:garden:Garden.Beds.HerbBed.home", "write"), ("field:addon:Addon.Plot.own", "write")):
        assert want in found, want
    assert {r.resolution_confidence for r in idx.symbol_references.collect()} <= {0.0, 0.5, 1.0}


def test_type_uses(built):
    _, idx = built
    t = idx.types.select(F.col("id").alias("target_type_id"), "full_name")
    found = set(rows(idx.type_references.join(t, "target_type_id"), "full_name", "reference_kind"))
    for want in (("Garden.Beds.Plot", "cast"), ("Garden.Beds.Plot", "as"), ("Garden.Beds.Plot", "generic_argument"), ("Garden.Beds.Plot", "instantiate"), ("Garden.Beds.Plot", "field_type"), ("Garden.Beds.HerbBed", "return_type"), ("Garden.Beds.Plot", "parameter_type"), ("Addon.Plot", "instantiate"), ("Garden.Beds.Bed", "inherit")):
        assert want in found, want


def test_verbs(built):
    _, idx = built
    assert [r.full_name for r in search.search_types(idx, "herb").collect()] == ["Garden.Beds.HerbBed"]
    assert symbol.lookup(idx, "Plot")["kind"] == "ambiguous"
    assert symbol.lookup(idx, "addon::Plot")["row"].full_name == "Addon.Plot"
    assert symbol.lookup(idx, "Garden.Beds.Bed.Corner")["kind"] == "type"
    assert symbol.lookup(idx, "HerbBed.Find")["row"].signature == "Find(int)" and symbol.lookup(idx, "Bed.Water")["kind"] == "ambiguous"
    assert symbol.lookup(idx, "Bed.Water(string,int)")["row"].signature == "Water(string,int)" and symbol.lookup(idx, "Nothing.at.all")["kind"] == "not_found"
    card = symbol.symbol(idx, "Garden.Beds.Bed")["card"].collect()[0]
    assert [d for d in card.derived] == ["Addon.Greenhouse", "Garden.Beds.HerbBed"] and len(card.methods) == 5
    assert symbol.symbol(idx, "Nope") == {"found": False} and symbol.symbol(idx, "Plot")["ambiguous"]
    assert symbol.refs(idx, "Garden.Beds.Plot.size", from_source="addon").count() == 2
    assert any("Water(int)" in r.caller for r in symbol.callers_of(idx, "HerbBed.Find").collect())
    ping = symbol.lookup(idx, "HerbBed.Ping")["row"].id
    tree = nav.call_tree(idx, ping, 5).orderBy("ord").collect()
    assert [(r.level, r.status) for r in tree] == [(0, "resolved"), (1, "resolved")] and "Pong(int)" in tree[0].call
    bed = symbol.lookup(idx, "Garden.Beds.Bed")["row"].id
    roots = idx.spark.createDataFrame([(bed,)], "id long")
    assert rows(graph.overrides(idx, roots, "Water"), "full_name", "signature") == [("Addon.Greenhouse", "Water(int)"), ("Garden.Beds.HerbBed", "Water(int)")]
    assert dict((r.source_id, r.types) for r in stats.per_source(idx).collect()) == {"garden": 11, "addon": 2}
    with pytest.raises(symbol.SymbolError):
        symbol.callers_of(idx, "Garden.Beds.Plot.size")


def test_windows_and_paths(spark, specs):
    files = scan(spark, specs[0]).select(F.col("relative_path").alias("path"), F.decode("content", "UTF-8").alias("content"))
    lines = symbol.show(files, "Shapes.cs:1", 2).orderBy("no").collect()
    assert [(r.no, r.text) for r in lines] == list(enumerate(SHAPES.splitlines()[:3], 1))
    for bad in ("../x.cs", "/etc/passwd", "a/../../b", "", "C:/x"):
        with pytest.raises(symbol.SymbolError):
            symbol.safe_path(bad)
    one = fingerprint(spark, specs[0].path).first()
    assert (one.file_count, one.csharp_file_count, one.assembly_files) == (5, 4, 0)


def test_rebuilds_are_recognised_and_failures_keep_what_was(spark, specs, built):
    path, idx = built
    assert build_index(spark, specs, path, Rules(primary="garden"), VALID) == "UNCHANGED"
    changed = [SourceSpec(**{**vars(specs[0]), "version": "1.1"}), specs[1]]
    with pytest.raises(BuildError):
        build_index(spark, changed, path, Rules(primary="garden"), {"core_types": ("NoSuchType",), "primary": "garden"})
    assert open_index(spark, path).types.count() == idx.types.count()


def test_missing_sources_and_indexes(spark, tmp_path):
    write(tmp_path / "empty", {"a.txt": ""})
    with pytest.raises(FileNotFoundError):
        build_index(spark, [SourceSpec("x", str(tmp_path / "empty"))], tmp_path.as_uri())
    with pytest.raises(FileNotFoundError):
        open_index(spark, (tmp_path / "none").as_uri())
