"""Control-plane readers: where sources lie on this machine and which version they are."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

COMMIT = re.compile("[a-f0-9]{7,40}")
LONGEST_VERSION = 32
LOADER_ASSEMBLIES = ("NeoModLoader.dll", "NeoModLoader.AutoUpdate_memload.dll")
DEFAULT_LOADER = "NeoModLoader"
LOADER_KEYS = ("ModLoader", "mod_loader", "loader")
GAME_MODS = "worldbox_Data/StreamingAssets/mods"
VERSION_KEYS = ("GameVersion", "game_version", "version")
GAME_VERSION = re.compile(r"\d+(?:\.\d+)*")
VERSIONS_DEPTH = 3


def walk(root: Path, pattern: str, max_depth: int) -> list[Path]:
    """Files that match a pattern at most max_depth folders down; folders that begin with a dot are skipped."""
    found = []
    for folder, below, names in os.walk(root):
        here = Path(folder)
        deeper = len(here.relative_to(root).parts) < max_depth
        below[:] = sorted(d for d in below if deeper and d[:1] != ".")
        found += map(here.joinpath, fnmatch.filter(names, pattern))
    return sorted(found)


def vdf_values(text: str, key: str) -> list[str]:
    """Values of a key in Valve's text format."""
    return [v.replace("\\\\", "\\") for v in re.findall(rf'"{re.escape(key)}"\s+"([^"]*)"', text)]


def library_folders(vdf: str) -> list[str]:
    return vdf_values(vdf, "path")


def build_id(acf: str) -> str | None:
    return next((v for v in vdf_values(acf, "buildid") if v.isdigit()), None)


def read_json(path: Path, required: Iterable[str] = ()) -> dict | None:
    """A JSON object with the required keys, else None."""
    try:
        found = json.loads(path.read_bytes())
    except (ValueError, OSError):
        return None
    return found if isinstance(found, dict) and all(k in found for k in required) else None


def version_for_path(document: Any, path: str) -> str | None:
    """The version of the first object, anywhere in a nested document, that has a game version and, in a key with "path" in its name, the given path."""
    plain = lambda p: p.translate({92: 47}).lower().rstrip("/")
    stack = [document]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            version = next((v for v in map(x.get, VERSION_KEYS) if isinstance(v, str) and GAME_VERSION.fullmatch(v)), None)
            if version and any(isinstance(v, str) and "path" in k.lower() and plain(v) == plain(path) for k, v in x.items()):
                return version
            stack += reversed(x.values())
        elif isinstance(x, list):
            stack += reversed(x)
    return None


def game_version(near: Path, path: str) -> tuple[str | None, str]:
    """(version, status) of a game's folder by the versions.json files below a folder."""
    for found in sorted(walk(near, "versions.json", VERSIONS_DEPTH), key=str):
        try:
            version = version_for_path(json.loads(found.read_bytes()), path)
        except (ValueError, OSError):
            continue
        if version:
            return version, "verified:local-metadata"
    return None, "unknown"


def git_info(folder: Path) -> dict[str, str | None]:
    """remote and commit of a working copy, from its files alone."""
    git = folder / ".git"
    config, head = (p.read_text(errors="replace") if p.is_file() else "" for p in (git / "config", git / "HEAD"))
    origin = re.search(r'\[remote "origin"\][^\[]*?url\s*=\s*(\S+)', config)
    commit = head.strip()
    if commit.startswith("ref:"):
        ref = commit[4:].strip()
        packed = (git / "packed-refs").read_text(errors="replace") if (git / "packed-refs").is_file() else ""
        loose = git / ref
        in_pack = re.search(rf"^([0-9a-f]{{40}}) {re.escape(ref)}$", packed, re.M)
        commit = loose.read_text().strip() if loose.is_file() else in_pack.group(1) if in_pack else ""
    return {"remote": origin.group(1) if origin else None, "commit": commit if COMMIT.fullmatch(commit) else None}


def loader_identity(commit: str | None, version: str | None) -> dict[str, str | None]:
    """Commit and version where they are well formed."""
    return {"commit": commit if commit and COMMIT.fullmatch(commit) else None, "version": version if version and len(version) <= LONGEST_VERSION else None}


def assembly_record(path: Path) -> dict[str, Any]:
    with path.open("rb") as f:
        return {"filename": path.name, "sha256": hashlib.file_digest(f, "sha256").hexdigest(), "size": path.stat().st_size}


def scan_loader(folder: Path | None, game: Path | None = None) -> dict[str, Any] | None:
    """The loader's record: commit and version from the files of these names in its folder, the known assemblies beside the folder.

    Without the folder, the bare assembly among the game's mods; None where there is neither.
    """
    text = lambda p: p.read_text(encoding="utf-8", errors="replace").strip() if p.is_file() else None
    if folder and folder.is_dir():
        known = [p for n in LOADER_ASSEMBLIES if (p := folder.parent / n).is_file()]
        return {"kind": "loader", "path": str(folder), **loader_identity(text(folder / "commit"), text(folder / "version")), "assemblies": [assembly_record(p) for p in known]}
    bare = game / GAME_MODS / LOADER_ASSEMBLIES[0] if game else None
    if bare and bare.is_file():
        return {"kind": "loader", "path": None, "commit": None, "version": None, "assemblies": [assembly_record(bare)]}
    return None


def folder_stats(folder: Path) -> dict[str, Any]:
    """file_count, total_size, latest_mtime, csharp_file_count, project_files and assembly_files of a folder, .git aside, hidden files included."""
    extensions, size, latest = [], 0, 0.0
    for here, below, names in os.walk(folder):
        below[:] = [d for d in below if d != ".git"]
        for name in names:
            try:
                about = os.stat(os.path.join(here, name))
            except OSError:
                continue
            extensions.append(os.path.splitext(name)[1].lower())
            size, latest = size + about.st_size, max(latest, about.st_mtime)
    count = lambda *ends: sum(e in ends for e in extensions)
    return {
        "file_count": len(extensions), "total_size": size, "latest_mtime": datetime.fromtimestamp(latest, UTC).isoformat(timespec="seconds") if latest else None,
        "csharp_file_count": count(".cs"), "project_files": count(".csproj", ".sln"), "assembly_files": count(".dll"),
    }


def mod_loader(info: dict | None) -> tuple[str | None, str | None]:
    """(loader, status): the loader that a mod.json names; one that names none is taken for the default's, no mod.json for nobody's."""
    named = next((v.strip() for v in map((info or {}).get, LOADER_KEYS) if isinstance(v, str) and v.strip()), None)
    return (named, "verified:mod.json") if named else (None, None) if info is None else (DEFAULT_LOADER, "inferred:mod.json")


def scan_mods(folder: Path, normalize: Callable[[str], str]) -> list[dict[str, Any]]:
    """A record for each child folder that doesn't begin with a dot, by id: name and loader from its mod.json, whether there is one, git remote and commit, file counts."""
    rows = []
    for child in sorted(p for p in folder.iterdir() if p.is_dir() and p.name[:1] != ".") if folder.is_dir() else []:
        info = read_json(child / "mod.json")
        name = (info or {}).get("name")
        detected, status = mod_loader(info)
        rows.append({
            "id": "ref:" + normalize(child.name), "kind": "reference-mod", "name": name.strip() if isinstance(name, str) and name.strip() else child.name, "loader": "verified" if info else "inferred",
            "detected_mod_loader": detected, "detected_mod_loader_status": status, "path": str(child), **git_info(child), **folder_stats(child),
        })
    return sorted(rows, key=lambda r: r["id"])


def first_source(candidates: Iterable[Callable[[], str | None]]) -> str | None:
    """The first candidate that gives an existing folder: explicit, configured, from the environment, from a library, asked for."""
    for candidate in candidates:
        path = candidate()
        if path and Path(path).exists():
            return path
    return None


def write_if_changed(path: Path, document: dict, volatile: frozenset[str] = frozenset({"generated_at"})) -> bool:
    """Write sorted JSON unless it only differs in volatile keys; whether it was written."""
    plain = lambda d: {k: v for k, v in d.items() if k not in volatile}
    old = read_json(path)
    if old is not None and plain(old) == plain(document):
        return False
    os.makedirs(path.parent, exist_ok=True)
    held = path.with_suffix(path.suffix + ".new")
    held.write_text(json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    os.replace(held, path)
    return True


def public_manifest(registry: dict[str, Any]) -> dict[str, Any]:
    """Identities alone, no place on this machine: hashes, versions, and mods by id."""
    sources = registry.get("sources") or {}
    out: dict[str, Any] = {"assemblies": [], "mods": []}
    for name, r in sorted(sources.items()):
        if r.get("kind") == "game":
            out["game"] = {"version": r.get("game_version"), "build_id": r.get("steam_buildid"), "sha256": (r.get("assembly") or {}).get("sha256")}
        elif r.get("kind") == "loader":
            out["loader"] = {"version": r.get("version"), "commit": r.get("commit")}
            known = ({k: a.get(k) for k in ("filename", "sha256")} for a in r.get("assemblies") or [])
            out["assemblies"] = [a for a in known if all(a.values())]
        elif r.get("kind") == "reference-mod":
            out["mods"].append({"id": name, "name": r.get("name"), "git_commit": r.get("commit"), "csharp_file_count": r.get("csharp_file_count", 0)})
    return out


def registry_paths(registry: dict[str, Any]) -> list[str]:
    """All places that a registry records: of a game its folder and assembly, of an assembly its file, of a loader its folder and assemblies, else the folder."""
    found: list[str | None] = []
    for r in (registry.get("sources") or {}).values():
        kind = r.get("kind")
        found += [(r.get("file") or {}).get("path")] if kind == "assembly" else [r.get("root_path") or r.get("path")]
        if kind == "game":
            found.append((r.get("assembly") or {}).get("path"))
        elif kind == "loader":
            found += [a.get("path") for a in r.get("assemblies") or []]
    return [p for p in found if p]


def registry_paths_valid(registry: dict[str, Any]) -> bool:
    """Whether all of them still exist."""
    return all(Path(p).exists() for p in registry_paths(registry))


def discover(explicit: str | None = None, config: Path | None = None, environment: str | None = None, library: Path | None = None, game_folder: str | None = None, ask: Callable[[], str | None] | None = None) -> dict[str, Any]:
    """root, origin and problems: a game's folder by the first way that gives one that exists.

    The ways: named explicitly; game_root of a JSON configuration; an environment variable; a folder of some name in a library that a library file lists;
    the answer to a question. A configuration that names no existing folder stays as it is, and the origin says so.
    """
    configured = read_json(config) if config else None
    stale = bool(config and config.is_file()) and not Path((configured or {}).get("game_root") or "/nowhere/at/all").is_dir()

    def in_library() -> str | None:
        folders = library_folders(library.read_text(errors="replace")) if library and library.is_file() else []
        return first_source([lambda f=f: os.path.join(f, "steamapps", "common", game_folder) for f in folders]) if game_folder else None

    ways = {"explicit": lambda: explicit, "local-config": lambda: (configured or {}).get("game_root"), "environment": lambda: os.environ.get(environment) if environment else None, "library": in_library, "asked": lambda: ask() if ask else None}
    for origin, way in ways.items():
        path = (way() or "").strip().strip('"')
        if path and Path(path).is_dir():
            return {"root": path, "origin": origin + ("+stale-config-kept" if stale and origin != "explicit" else ""), "problems": []}
    return {"root": None, "origin": "none" + ("+stale-config-kept" if stale else ""), "problems": ["game root not found"]}


def doctor(found: dict[str, Any], registry: dict[str, Any] | None, loader: dict[str, Any] | None = None, mods: list[dict[str, Any]] | None = None, states: dict[str, str] | None = None) -> tuple[list[tuple[str, str]], bool]:
    """([(check, state)], whether a game with its assembly is there): what discover(), a registry, the scans and the states of snapshots and indexes say, by name."""
    game = next((r for r in ((registry or {}).get("sources") or {}).values() if r.get("kind") == "game"), {})
    assembly = (game.get("assembly") or {}).get("path")
    rows = [("Config", found["origin"]), ("Game", "OK" if found["root"] else "MISSING"), ("Assembly", "OK" if assembly and os.access(assembly, os.R_OK) else "FAIL (unreadable)" if assembly and Path(assembly).exists() else "MISSING")]
    rows.append(("Loader", "OK" if loader and (loader.get("path") or loader.get("assemblies")) else "MISSING"))
    rows.append(("Reference mods", "not configured" if mods is None else f"{len(mods)} detected"))
    if registry is None:
        rows.append(("Registry", "MISSING"))
    else:
        rows.append(("Registry", f"OK ({len(registry.get('sources') or {})} sources)" if registry_paths_valid(registry) else "STALE (recorded paths invalid)"))
    rows += [(name, state.replace("OK-EXTRACTOR-CHANGED", "OK")) for name, state in (states or {}).items()]
    return rows, rows[1][1] == "OK" and rows[2][1] == "OK"
