"""Symbol lookup, cards and source windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..model import CodeIndex
from .nav import callers, refs_member, refs_method, refs_type

MAX_DERIVED = 50


class SymbolError(LookupError):
    """A symbol that isn't there, or a path that may not be shown."""


def split_source(spec: str, source: str | None = None) -> tuple[str | None, str]:
    """(source, rest) of [source::]rest; what stands before :: overrides source."""
    before, mark, rest = spec.strip().rpartition("::")
    return (before.strip() or source if mark else source), rest.strip()


def named_types(idx: CodeIndex, name: str, generated: bool = True, source: str | None = None) -> DataFrame:
    """Types of a name or full name, which may begin with source::."""
    source, name = split_source(name, source)
    t = idx.types.filter((F.col("full_name") == name) | (F.col("name") == name))
    t = t if generated else t.filter("is_compiler_generated = 0")
    s = idx.sources.select(F.col("id").alias("source_key"), "source_id")
    s = s.filter(F.col("source_id") == source) if source else s
    return t.withColumnRenamed("source_id", "source_key").join(s, "source_key").orderBy("source_id", "full_name", "id")


def _choices(names: list[str]) -> dict:
    return {"kind": "ambiguous", "candidates": names}


def _labels(rows: list[Row]) -> list[str]:
    return ["[{}] {}".format(r.source_id, r.full_name) for r in rows]


def lookup(idx: CodeIndex, spec: str, source: str | None = None, parity: bool = False) -> dict:
    """kind, row, owner or candidates of [source::]Type[.member[(signature)]].

    The longest type that is unique wins. Unless parity, a whole type of that name comes before a member, so nested types are found.
    """
    source, spec = split_source(spec, source)
    spec, bracket, tail = spec.partition("(")
    signature = bracket + tail
    parts = spec.split(".")
    for cut in ([] if parity or signature else [len(parts)]) + list(range(len(parts) - 1, 0, -1)) + ([len(parts)] if parity or signature else []):
        rows = named_types(idx, ".".join(parts[:cut]), source=source).collect()
        member = ".".join(parts[cut:])
        match rows:
            case []:
                continue
            case [_, _, *_]:
                return _choices(_labels(rows))
            case [only] if member:
                return _member(idx, only, member, signature)
            case [only]:
                return dict(kind="type", row=only)
    return {"kind": "not_found"}


def _member(idx: CodeIndex, owner: Row, member: str, signature: str) -> dict:
    mine = (F.col("type_id") == owner.id) & (F.col("name") == member)
    same = idx.methods.filter((F.col("type_id") == owner.id) & (F.col("signature") == member + signature)).orderBy("id").take(1) if signature else []
    found = same or idx.methods.filter(mine).orderBy("signature", "id").collect()
    if len(found) > 1:
        return _choices([owner.full_name + "." + m.signature for m in found])
    for kind, rows in (("method", found), ("field", None), ("property", None)):
        table = idx.fields if kind == "field" else idx.properties
        rows = table.filter(mine).orderBy("id").take(1) if rows is None else rows
        if rows:
            return dict(kind=kind, row=rows[0], owner=owner.full_name)
    return {"kind": "not_found"}


def refs_of(idx: CodeIndex, found: dict, **how) -> DataFrame:
    """The uses of what lookup() found, a single symbol."""
    row = found["row"]
    if found["kind"] == "type":
        return refs_type(idx, row.id, name=row.name, **how)
    if found["kind"] == "method":
        return refs_method(idx, row.id, name=row.name, **how)
    return refs_member(idx, found["kind"], row.id, name=row.name, **how)


def refs(idx: CodeIndex, spec: str, **how) -> DataFrame:
    """(location, kind, status, from_source) of the uses of a symbol; how: limit, include_all and from_source as in refs_type. An error where there is no single one."""
    found = lookup(idx, spec)
    if "row" not in found:
        raise SymbolError(f"{spec}: {found['kind']} {', '.join(found.get('candidates', []))}")
    return refs_of(idx, found, **how)


def callers_of(idx: CodeIndex, spec: str, **how) -> DataFrame:
    found = lookup(idx, spec)
    if found["kind"] != "method":
        raise SymbolError(f"{spec}: not a method but {found['kind']}")
    return callers(idx, found["row"].id, name=found["row"].name, **how)


def symbol_cards(idx: CodeIndex, types: DataFrame) -> DataFrame:
    """One row for each of types (by id): the declaration with bases, members and direct subtypes as sorted arrays of structs."""
    keys = types.select("id")
    chosen = idx.types.join(keys, "id", "left_semi")
    files = idx.files.select(F.col("id").alias("file_id"), "relative_path")
    sources = idx.sources.select(F.col("id").alias("source_key"), "source_id")

    def gathered(table: DataFrame, name: str, *columns: str) -> DataFrame:
        mine = table.join(keys.withColumnRenamed("id", "type_id"), "type_id", "left_semi")
        return mine.groupBy(F.col("type_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    direct = idx.inheritance.select(F.col("target_type_id").alias("id"), F.col("type_id").alias("sub")).join(keys, "id", "left_semi")
    # Spark keeps the first rows of each group before the shuffle, so a base with millions of subtypes sends a few from each task
    nth = F.row_number().over(Window.partitionBy("id").orderBy("full_name", "sub"))
    first = direct.join(idx.types.select(F.col("id").alias("sub"), "full_name"), "sub").withColumn("nth", nth).filter(F.col("nth") <= MAX_DERIVED)
    below = first.groupBy("id").agg(F.array_sort(F.collect_list("full_name")).alias("derived"))
    card = chosen.withColumnRenamed("source_id", "source_key").join(sources, "source_key").join(files, "file_id")
    for part in (
        gathered(idx.inheritance, "bases", "relation", "target_name"),
        gathered(idx.methods, "methods", "start_line", "signature", "visibility", "is_static", "is_virtual", "is_override"),
        gathered(idx.fields, "fields", "start_line", "name", "field_type", "visibility", "is_static", "is_const"),
        gathered(idx.properties, "properties", "start_line", "name", "property_type", "has_getter", "has_setter", "is_static"),
        below,
    ):
        card = card.join(part, "id", "left")
    return card.drop("source_key")


def symbol(idx: CodeIndex, name: str, source: str | None = None, generated: bool = False) -> dict:
    """found, and the card of a type or the candidates where the name is ambiguous."""
    rows = named_types(idx, name, generated, source)
    heads = rows.collect()
    out: dict = {"found": bool(heads)}
    if heads:
        out |= {"ambiguous": True, "candidates": _labels(heads)} if heads[1:] else {"ambiguous": False, "card": symbol_cards(idx, rows)}
    return out


def string_search(idx: CodeIndex, value: str, limit: int = 20, exact: bool = False) -> DataFrame:
    from .search import search_strings

    return search_strings(idx, value, limit, exact=exact).select("value", "classification", "relative_path", "start_line")


def lines_of(content: Column) -> Column:
    """The lines of a text, as Python's splitlines has them."""
    parts = F.split(content, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def around(rows: DataFrame, context: int = 5) -> DataFrame:
    """(path, line, no, text): of each of rows (path, line, parts) the context lines around its line; lines beyond the ends are clamped. Rows of one path stay apart."""
    at = rows.withColumn("at", F.greatest(F.lit(1), F.least(F.col("line"), F.size("parts")))).withColumn("first", F.greatest(F.col("at") - context, F.lit(1)))
    shown = F.slice("parts", F.col("first"), F.col("at") + context + 1 - F.col("first"))
    return at.select("path", "line", "first", F.posexplode(shown).alias("k", "text")).select("path", "line", (F.col("first") + F.col("k")).alias("no"), "text")


def window(files: DataFrame, places: DataFrame, context: int = 5) -> DataFrame:
    """(path, line, no, text): context lines around each of places (path, line) in files (path, content); lines beyond the ends are clamped."""
    return around(places.join(files, "path").select("path", "line", lines_of(F.col("content")).alias("parts")), context)


def safe_path(path: str) -> str:
    """A relative path that stays inside a snapshot, or an error."""
    clean = path.replace("\\", "/").strip()
    if not clean or clean.startswith("/") or ":" in clean.partition("/")[0] or any(p in ("..", ".", "") for p in clean.split("/")):
        raise SymbolError(f"not a path inside a snapshot: {path}")
    return clean


def place(location: str) -> tuple[str, int]:
    """(path, line) of path[:line], line 1 where it isn't given; an error for a malformed line or a path that may not be shown."""
    path, mark, line = location.rpartition(":")
    if mark and not (line.isascii() and line.isdigit()):
        raise SymbolError(f"invalid location: {location}")
    return safe_path((path if mark else location).replace(chr(92), "/").strip().rstrip("/")), min(int(line), (1 << 31) - 1) if mark else 1


def show(files: DataFrame, spec: str, context: int = 5) -> DataFrame:
    """The window of path[:line] in files (path, content); an error where there is no such file."""
    path, line = place(spec)
    mine = files.filter(F.col("path") == path)
    if mine.isEmpty():
        raise SymbolError(f"file not found in snapshot: {path}")
    return window(mine, files.sparkSession.createDataFrame([(path, line)], "path string, line int"), context)


def refs_with_context(idx: CodeIndex, files: DataFrame, spec: str, context: int = 3, **how) -> DataFrame:
    """refs() with the source lines around each use; files (path, content)."""
    found = refs(idx, spec, **how).withColumn("path", F.regexp_extract("location", r"^(.*):", 1)).withColumn("line", F.regexp_extract("location", r":([0-9]+)$", 1).cast("int"))
    return found.join(window(files, found.select("path", "line").distinct(), context), ["path", "line"]).orderBy("path", "line", "no")
