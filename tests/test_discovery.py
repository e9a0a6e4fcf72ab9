"""Readers of what lies on a machine."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from glyphmine.operators import registry
from glyphmine.sources import discovery


def test_walk_is_bounded_and_skips_dots(tmp_path):
    for name in ("a.txt", "x/b.txt", "x/y/c.txt", "x/y/z/d.txt", ".h/e.txt", "x/f.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    assert [p.name for p in discovery.walk(tmp_path, "*.txt", 2)] == ["a.txt", "b.txt", "c.txt"]


def test_texts_of_the_store():
    text = '"libraryfolders" { "0" { "path"  "/games/one" } "1" { "path" "D:\\\\two" } }'
    assert discovery.library_folders(text) == ["/games/one", "D:\\two"]
    assert discovery.build_id('"AppState" { "buildid"\t\t"12345" }') == "12345" and discovery.build_id("{}") is None


def test_json_with_required_keys(tmp_path):
    p = tmp_path / "a.json"
    for text, want in (('{"a": 1}', {"a": 1}), ('{"b": 1}', None), ("[1]", None), ("{", None)):
        p.write_text(text)
        assert discovery.read_json(p, ["a"]) == want
    assert discovery.read_json(tmp_path / "none") is None


def test_version_beside_a_path():
    doc = {"games": [{"path": "/x", "version": "1"}, {"deep": {"path": "C:\\Games\\Y\\", "version": "2"}}]}
    assert discovery.version_for_path(doc, "c:/games/y") == "2" and discovery.version_for_path(doc, "/z") is None


def test_git_files(tmp_path):
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "config").write_text('[remote "origin"]\n\turl = https://host/x.git\n')
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    assert discovery.git_info(tmp_path) == {"remote": "https://host/x.git", "commit": None}
    (git / "packed-refs").write_text(f"# pack\n{'a' * 40} refs/heads/main\n")
    assert discovery.git_info(tmp_path)["commit"] == "a" * 40
    (git / "refs/heads/main").write_text("b" * 40)
    assert discovery.git_info(tmp_path)["commit"] == "b" * 40
    (git / "HEAD").write_text("c" * 40)
    assert discovery.git_info(tmp_path)["commit"] == "c" * 40
    assert discovery.loader_identity("xyz", "1" * 33) == {"commit": None, "version": None}


def test_mods(tmp_path):
    (tmp_path / "B_mod").mkdir()
    (tmp_path / "A mod").mkdir()
    (tmp_path / "A mod/mod.json").write_text('{"name": "Alpha"}')
    rows = discovery.scan_mods(tmp_path, lambda n: n.lower().replace(" ", "-"))
    assert [(r["id"], r["name"], r["loader"]) for r in rows] == [("ref:a-mod", "Alpha", "verified"), ("ref:b_mod", "B_mod", "inferred")]
    assert discovery.scan_mods(tmp_path / "none", str) == []


def test_first_source_and_changed_writes(tmp_path):
    assert discovery.first_source([lambda: None, lambda: str(tmp_path / "no"), lambda: str(tmp_path)]) == str(tmp_path)
    p = tmp_path / "d/x.json"
    assert discovery.write_if_changed(p, {"a": 1, "generated_at": "x"})
    assert not discovery.write_if_changed(p, {"a": 1, "generated_at": "y"})
    assert discovery.write_if_changed(p, {"a": 2, "generated_at": "y"}) and json.loads(p.read_text())["a"] == 2


def test_public_manifest_names_no_place():
    registry = {"sources": {"g": {"kind": "game", "path": "/secret", "game_version": "1", "assembly": {"sha256": "h"}}, "l": {"kind": "loader", "commit": "c", "assemblies": [{"filename": "a.dll", "sha256": "x"}, {"filename": "b.dll"}]}, "ref:m": {"kind": "reference-mod", "name": "M", "path": "/secret"}}}
    found = discovery.public_manifest(registry)
    assert "/secret" not in json.dumps(found)
    assert found["assemblies"] == [{"filename": "a.dll", "sha256": "x"}] and found["game"]["sha256"] == "h" and [m["id"] for m in found["mods"]] == ["ref:m"]


def test_version_by_the_keys_of_the_reference(tmp_path):
    doc = [{"GameVersion": "n/a", "path": "/x"}, {"a": {"InstallPath": "C:\\Games\\X\\", "GameVersion": "0.51.2"}}, {"path": "c:/games/x", "version": "9"}]
    assert discovery.version_for_path(doc, "C:/Games/X") == "0.51.2" and discovery.version_for_path(doc, "/x") is None
    (tmp_path / "a").mkdir()
    (tmp_path / "a/versions.json").write_text("{")
    assert discovery.game_version(tmp_path, "c:/games/x") == (None, "unknown")
    (tmp_path / "b").mkdir()
    (tmp_path / "b/versions.json").write_text(json.dumps(doc))
    assert discovery.game_version(tmp_path, "c:/games/x") == ("0.51.2", "verified:local-metadata")


def test_loader_folder(tmp_path):
    mods = tmp_path / discovery.GAME_MODS
    mods.mkdir(parents=True)
    assert discovery.scan_loader(mods / "NML", tmp_path) is None
    for name in (*discovery.LOADER_ASSEMBLIES, "Other.dll"):
        (mods / name).write_bytes(name.encode())
    records = [{"filename": n, "sha256": hashlib.sha256(n.encode()).hexdigest(), "size": len(n)} for n in discovery.LOADER_ASSEMBLIES]
    assert discovery.scan_loader(None, tmp_path) == {"kind": "loader", "path": None, "commit": None, "version": None, "assemblies": records[:1]}
    nml = mods / "NML"
    nml.mkdir()
    (nml / "commit").write_text("abcdef1\n")
    (nml / "version").write_text(" 1.2 \n")
    found = discovery.scan_loader(nml, tmp_path)
    assert found == {"kind": "loader", "path": str(nml), "commit": "abcdef1", "version": "1.2", "assemblies": records}
    public = discovery.public_manifest({"sources": {"l": found}})
    assert public["loader"] == {"version": "1.2", "commit": "abcdef1"} and [a["filename"] for a in public["assemblies"]] == list(discovery.LOADER_ASSEMBLIES)


def test_loaders_that_mods_name(tmp_path):
    for name, text in (("a", '{"ModLoader": " Other "}'), ("b", "{}"), ("c", "{"), (".d", "{}")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "mod.json").write_text(text)
    rows = discovery.scan_mods(tmp_path, str)
    assert [(r["id"], r["detected_mod_loader"], r["detected_mod_loader_status"]) for r in rows] == [("ref:a", "Other", "verified:mod.json"), ("ref:b", "NeoModLoader", "inferred:mod.json"), ("ref:c", None, None)]


def test_scanned_sources_show_their_changes(spark, tmp_path):
    mods = tmp_path / discovery.GAME_MODS
    for name in ("NML", "a/.git", "b"):
        (mods / name).mkdir(parents=True)
    for name in ("a/X.cs", "a/.hidden", "a/.git/y.cs", "a/a.csproj", "b/Y.cs", discovery.LOADER_ASSEMBLIES[0]):
        (mods / name).write_text("one")

    def registered():
        rows = [*discovery.scan_mods(mods, str), {"id": "loader", **discovery.scan_loader(mods / "NML")}]
        schema = "id string, kind string, sha256 string, build_id string, version string, commit string, assemblies array<struct<filename: string, sha256: string>>, file_count long, total_size long, latest_mtime string"
        return rows, spark.createDataFrame([{c: r.get(c) for c in "id kind sha256 build_id version commit assemblies file_count total_size latest_mtime".split()} for r in rows], schema)

    rows, old = registered()
    by = {r["id"]: r for r in rows}
    assert [by["ref:a"][c] for c in ("file_count", "total_size", "csharp_file_count", "project_files", "assembly_files")] == [3, 9, 1, 1, 0]
    assert [m["csharp_file_count"] for m in discovery.public_manifest({"sources": by})["mods"]] == [0, 1, 1]
    (mods / "a/Z.cs").write_text("more")
    (mods / discovery.LOADER_ASSEMBLIES[0]).write_text("two")
    found = registry.diff(old, registered()[1], "id", registry.identity(F.col("kind")))
    assert {r.id: r.status for r in found.collect()} == {"loader": "CHANGED", "ref:NML": "UNCHANGED", "ref:a": "CHANGED", "ref:b": "UNCHANGED"}
