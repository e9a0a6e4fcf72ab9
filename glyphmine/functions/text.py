"""Column functions over names, signatures and literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _until_none(c: Column, opening: Column, pattern: str) -> Column:
    """c with pattern removed again and again: as many rounds as there are opening brackets, of which each round removes the innermost."""
    rounds = F.aggregate(F.sequence(F.lit(1), F.greatest(opening, F.lit(1))), c, lambda x, _: F.regexp_replace(x, pattern, ""))
    return F.when(opening > 0, rounds).otherwise(c)


def _times(c: Column, *marks: str) -> Column:
    """How often the marks occur."""
    return F.length(c) - F.length(F.translate(c, "".join(marks), ""))



def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def has_substring(c: Column, query: str) -> Column:
    """Substring match that ignores the case of ASCII letters alone; no character of the query is special."""
    return ascii_lower(c).contains(query.translate(str.maketrans(_UPPER, _LOWER)))


def like_unescaped(c: Column, query: str) -> Column:
    """The parity form of has_substring: % and _ in the query were escaped, yet the escape is read as a plain backslash."""
    pattern = "".join("\\" + x if x in "\\%_" else x for x in query)
    lowered = "%" + pattern.translate(str.maketrans(_UPPER, _LOWER)) + "%"
    inert = next(x for x in "!~^`\x01" if x not in lowered)
    return F.call_function("like", ascii_lower(c), F.lit(lowered), F.lit(inert))


def matches(c: Column, query: str, exact: bool = False, parity: bool = False) -> Column:
    return c == query if exact else like_unescaped(c, query) if parity else has_substring(c, query)


def classify_string(c: Column) -> Column:
    """Kind of a literal: path_like, localization_like, possible_identifier, possible_asset_id or other; the first rule that holds."""
    asset = c.rlike(r"\A\p{Alnum}[-.\w]*\z") & (c.contains("_") | c.contains("."))
    return (
        F.when(c.isNull() | (c == ""), "other").when(c.contains("/") | c.contains("\\"), "path_like").when(c.rlike(r"(?U)\s"), "localization_like")
        .when(c.rlike(r"\A[\p{Alpha}_]\w*\z"), "possible_identifier").when(asset, "possible_asset_id").otherwise("other")
    )


def strip_generics(c: str | Column) -> Column:
    """Without <...>, innermost first, however deep."""
    c = F.col(c) if isinstance(c, str) else c
    return _until_none(c, _times(c, "<"), r"<[^<>]*>")


def simple_name(c: Column) -> Column:
    """The last dotted part of a type name without generic arguments."""
    return F.element_at(F.split(strip_generics(c), r"\."), -1)


def is_external_name(c: Column, roots: frozenset[str]) -> Column:
    return F.split(strip_generics(c), r"\.").getItem(0).isin(sorted(roots))


def parameter_text(signature: Column) -> Column:
    return F.regexp_extract(signature, r"(?s)\((.*)\)\z", 1)


def arity(signature: Column, parity: bool = False) -> Column:
    """Number of parameters; commas inside generic arguments, arrays and tuples don't count. parity: half the text's length."""
    inner = parameter_text(signature)
    if parity:
        return F.floor(F.length(inner) / 2).cast("int")
    flat = _until_none(inner, _times(inner, "<", "[", "("), r"<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)")
    return F.when(F.trim(inner) == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(","), F.lit(""))) + 1).cast("int")


_GAP = r"[-_\s]"
_STAGES, _ENDS = "beta alpha pre rc".split(), "new final stable pre beta alpha rc".split()
_VERSION = rf"{_GAP}?(?:v|{'|'.join(_STAGES)})?\d+(?:(?:\.|{_GAP})\d+)*\+?(?:{_GAP}?(?:{'|'.join(_ENDS)}))?$"


def normalize_name(c: Column) -> Column:
    """Folder name to identifier: lower case, dashes for spaces and underscores, version endings stripped until none is left; never empty."""
    start = F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("-"))
    # each round shortens the name or leaves it, so its length bounds the rounds
    bare = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(start), F.lit(1))), start, lambda x, _: F.regexp_replace(F.regexp_replace(x, _VERSION, ""), r"[_\- ]+$", ""))
    bare = F.replace(bare, F.lit("_"), F.lit("-"))
    return F.when(bare == "", start).otherwise(bare)


def logical_key(status: Column, kind: Column, source: Column, type_full: Column, signature: Column, name: Column) -> Column:
    """What a reference points at, stable across rebuilds; a name with ? where it isn't resolved."""
    member = F.when(kind == "method", signature).otherwise(name)
    return F.when(status == "resolved", F.concat_ws(":", kind, source, F.concat_ws(".", type_full, member))).otherwise(F.concat(F.lit("?"), name))


def snapshot_id(prefix: Column, version: Column, sha256: Column) -> Column:
    return F.concat_ws("-", prefix, version, F.substring(sha256, 1, 12))


def size_text(c: Column) -> Column:
    return (
        F.when(c >= 1_000_000, F.concat(F.format_number(c / 1_000_000, 1), F.lit(" MB"))).when(c >= 1_000, F.concat(F.format_number(c / 1_000, 1), F.lit(" KB")))
        .otherwise(F.concat(c.cast("string"), F.lit(" B")))
    )


def short_hash(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 12), F.lit("…"))


def location(path: Column, line: Column) -> Column:
    return F.concat(path, F.lit(":"), F.coalesce(line.cast("string"), F.lit("?")))


def line_count(content: Column) -> Column:
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("long")


def identity_text(versions: Column, snapshots: Column) -> Column:
    """The index identity: sorted versions and snapshots joined by semicolons."""
    return F.concat_ws(";", F.concat_ws(";", F.array_sort(versions)), F.concat_ws(";", F.array_sort(snapshots)))
