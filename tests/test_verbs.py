"""Verbs by symbol, their rendering, the call tree against a plain walk, catalog files and the health report."""

from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from glyphmine.operators import catalog, symbol, verbs
from glyphmine.plans import code_queries
from glyphmine.sources import discovery

from .compare import SF


@pytest.fixture(scope="module")
def idx(spark):
    return code_queries.built(spark, SF)[0]


def test_verbs_by_symbol(idx):
    lost = verbs.refs(idx, "No.Such")
    assert (lost["target"], lost["definition"], lost["references"].count()) == ({"kind": "not_found"}, None, 0)
    many = verbs.refs(idx, "Mode")
    assert many["target"]["kind"] == "ambiguous" and len(many["target"]["candidates"]) == 200
    found = verbs.refs(idx, "N1.T1.link", limit=3)
    assert found["definition"] == "[field] N1.T1.link  (p1.cs:7)" and found["references"].count() == 3
    assert verbs.refs(idx, "game::T1")["definition"] == "[game] [class] N1.T1  (p1.cs:4)"
    for verb, rows in ((verbs.callers, "callers"), (verbs.callees, "tree")):
        other = verb(idx, "N1.T1.link")
        assert other["error"] == "not a method" and other[rows].count() == 0 and verb(idx, "No.Such")["target"]["kind"] == "not_found"
    assert verbs.callers(idx, "N1.T1.Twice").get("callers").count() > 0
    assert verbs.derived(idx, "No.Such") == {"type": "No.Such", "found": False} and verbs.derived(idx, "Mode")["ambiguous"]
    assert [r.full_name for r in verbs.derived(idx, "N1.T1")["derived"].collect()] == ["N0.T5", "N3.T3", "N4.T4"]
    assert verbs.derived(idx, "N1.T1", source="other") == {"type": "N1.T1", "found": False}
    assert verbs.overrides(idx, "N1.T1")["overrides"].count() == 0


def test_the_call_tree_is_a_walk_that_expands_a_method_once(idx):
    path = {r.id: r.relative_path for r in idx.files.collect()}
    below: dict = {}
    for r in idx.method_calls.collect():
        below.setdefault(r.caller_method_id, []).append(((path[r.file_id], r.line, r.column, r.id), r))
    root = symbol.lookup(idx, "N4.T199.Run")["row"].id
    for depth, limit in ((5, 50), (3, 2), (9, 4)):
        want, met = [], set()

        def walk(node, level, depth=depth, limit=limit, want=want, met=met):
            if level >= min(depth, 5) or node in met:
                return
            met.add(node)
            for _, r in sorted(below.get(node, []), key=lambda x: x[0])[:limit]:
                want.append((level, r.resolution_status, f"{path[r.file_id]}:{r.line}"))
                if r.callee_method_id is not None:
                    walk(r.callee_method_id, level + 1)

        walk(root, 0)
        tree = verbs.callees(idx, "N4.T199.Run", depth, limit)["tree"].orderBy("ord").collect()
        assert [(r.level, r.status, r.location) for r in tree] == want and len(want) > 1
        assert [r.ord for r in tree] == list(range(len(want)))


def test_rendering(idx):
    out = json.loads(verbs.as_json(verbs.refs(idx, "N1.T1.link", limit=2)))
    assert out["symbol"] == "N1.T1.link" and [set(r) for r in out["references"]] == [{"location", "kind", "status", "from_source"}] * 2
    text = verbs.as_text(idx.types.select("full_name", "kind").orderBy("full_name"), 3).split("\n")
    assert text[0].split() == ["full_name", "kind"] and len(text) == 5 and text[-1] == f"… and {idx.types.count() - 3} more"
    assert verbs.as_text([]) == "(none)"


def test_show(spark, idx):
    files = code_queries.source_files(spark, SF).select("source_id", F.col("relative_path").alias("path"), F.decode("content", "UTF-8").alias("content"))
    rows = verbs.show(idx, files, "p1.cs:18", 1).orderBy("no").collect()
    assert [r.no for r in rows] == [17, 18, 19] and "+= 3" in rows[1].text
    assert [r.no for r in verbs.show(idx, files, "p1.cs", 2).orderBy("no").collect()] == [1, 2, 3]
    assert verbs.show(idx, files, "p1.cs:9999", 0).first().no == 37
    for bad in ("p1.cs:x", "no/such.cs:3", "../p1.cs", "p1.cs:", "C:/p1.cs:3"):
        with pytest.raises(symbol.SymbolError):
            verbs.show(idx, files, bad)
    plain = files.select("path", "content")
    for bad in ("p1.cs:x", "no/such.cs:3"):
        with pytest.raises(symbol.SymbolError):
            symbol.show(plain, bad)


def test_catalog_files(spark, tmp_path):
    fields = "source_id string, name string, tier string, summary string, primary_systems array<string>, secondary_systems array<string>, key_files array<string>, pattern_candidates array<string>, harmony boolean, ui boolean, assets boolean, persistence boolean, confidence string, profile string, patterns array<struct<id:string,goal:string>>"
    rows = [
        ("ref:b", 'B, "the" mod', "A", "long " * 40, ["UI", "AI"], ["Save"], ["k"], ["x"], True, False, False, True, "Verified", "mods/b.md", [("x", "do x")]),
        ("ref:a", "Ä", "B", "short", [], ["UI"], ["k", "l"], ["y"], False, False, True, True, "Partial", "mods/a.md", [("y", "do y")]),
    ]
    written = catalog.write_catalog(spark.createDataFrame(rows, fields), tmp_path.as_uri())
    assert written == ["catalog.csv", "catalog.json", "pattern-candidates.jsonl", "system-matrix.csv"]
    entries = json.loads((tmp_path / "catalog.json").read_text())
    assert [e["source_id"] for e in entries] == ["ref:a", "ref:b"] and entries[1]["primary_systems"] == ["UI", "AI"]
    flat = list(csv.DictReader((tmp_path / "catalog.csv").open(newline="", encoding="utf-8")))
    assert [r["primary_systems"] for r in flat] == ["", "UI|AI"] and flat[1]["name"] == 'B, "the" mod'
    matrix = list(csv.reader((tmp_path / "system-matrix.csv").open(newline="")))
    assert matrix[0] == ["mod_id", "system", "role", "evidence_count", "confidence"] and matrix[1:] == sorted(matrix[1:]) and len(matrix) == 5
    lines = [json.loads(x) for x in (tmp_path / "pattern-candidates.jsonl").read_text().splitlines()]
    assert [(x["pattern_id"], x["system"], x["confidence"], len(x["reason"])) for x in lines] == [("candidate:y", "Utility", "inferred", 5), ("candidate:x", "UI", "verified", 80)]


def test_discovery_takes_the_first_way_that_leads_somewhere(tmp_path, monkeypatch):
    game, library = tmp_path / "games" / "steamapps" / "common" / "Village", tmp_path / "libraryfolders.vdf"
    game.mkdir(parents=True)
    library.write_text(f'"libraryfolders" {{ "0" {{ "path" "/none" }} "1" {{ "path" "{tmp_path / "games"}" }} }}')
    config = tmp_path / "config.json"
    how = {"config": config, "environment": "VILLAGE_ROOT", "library": library, "game_folder": "Village"}
    assert discovery.discover(**how) == {"root": str(game), "origin": "library", "problems": []}
    monkeypatch.setenv("VILLAGE_ROOT", str(tmp_path))
    assert discovery.discover(**how)["origin"] == "environment"
    config.write_text(json.dumps({"game_root": "/gone"}))
    assert discovery.discover(**how)["origin"] == "environment+stale-config-kept"
    config.write_text(json.dumps({"game_root": str(game)}))
    assert discovery.discover(**how)["origin"] == "local-config" and discovery.discover(explicit=str(tmp_path), **how)["origin"] == "explicit"
    assert discovery.discover(ask=lambda: f'"{game}"')["origin"] == "asked" and discovery.discover()["problems"] == ["game root not found"]


def test_health(tmp_path):
    assembly = tmp_path / "a.dll"
    assembly.write_bytes(b"x")
    sources = {"game": {"kind": "game", "root_path": str(tmp_path), "assembly": {"path": str(assembly)}}, "part": {"kind": "assembly", "file": {"path": str(assembly)}}, "loader": {"kind": "loader", "root_path": str(tmp_path), "assemblies": [{"path": str(assembly)}]}}
    found = {"root": str(tmp_path), "origin": "explicit", "problems": []}
    rows, ok = discovery.doctor(found, {"sources": sources}, {"assemblies": [1]}, [{}, {}], {"Index": "OK", "Source": "OK-EXTRACTOR-CHANGED"})
    assert ok and dict(rows) == {"Config": "explicit", "Game": "OK", "Assembly": "OK", "Loader": "OK", "Reference mods": "2 detected", "Registry": "OK (3 sources)", "Index": "OK", "Source": "OK"}
    sources["part"]["file"]["path"] = str(tmp_path / "gone.dll")
    assert not discovery.registry_paths_valid({"sources": sources}) and dict(discovery.doctor(found, {"sources": sources})[0])["Registry"].startswith("STALE")
    rows, ok = discovery.doctor({"root": None, "origin": "none", "problems": []}, None)
    assert not ok and dict(rows)["Game"] == dict(rows)["Registry"] == dict(rows)["Assembly"] == dict(rows)["Loader"] == "MISSING"
