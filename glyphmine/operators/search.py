"""Ranked symbol search: six lists, each with a total order, so a limit is well defined."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_substring, matches
from ..model import CodeIndex

LIMIT = 20


@dataclass(frozen=True)
class Options:
    """limit: rows of a list; exact: whole names; generated: also compiler-generated symbols; source: only of this one; parity: keep known quirks."""

    limit: int = LIMIT
    exact: bool = False
    generated: bool = False
    source: str | None = None
    parity: bool = False

    def sources(self, idx: CodeIndex) -> DataFrame:
        s = idx.sources.select(F.col("id").alias("source_key"), "source_id")
        return s.filter(F.col("source_id") == self.source) if self.source else s

    def hit(self, c: Column, query: str, escaped: bool = False) -> Column:
        return matches(c, query, self.exact, self.parity and not escaped)


def _files(idx: CodeIndex) -> DataFrame:
    return idx.files.select(F.col("id").alias("file_key"), "relative_path", F.col("source_id").alias("file_source"))


def search_types(idx: CodeIndex, query: str, limit: int = LIMIT, **options) -> DataFrame:
    o = Options(limit, **options)
    t = idx.types.filter(o.hit(F.col("name"), query, escaped=True) | o.hit(F.col("full_name"), query, escaped=True))
    t = t if o.generated else t.filter("is_compiler_generated = 0")
    t = t.withColumnRenamed("source_id", "source_key").join(o.sources(idx), "source_key").join(_files(idx), F.col("file_id") == F.col("file_key"))
    order = ["full_name", "source_id", "id"] if o.exact else ["is_compiler_generated", "full_name", "source_id", "id"]
    return t.orderBy(*order).limit(limit).select("source_id", "full_name", "kind", "relative_path", "start_line")


def _members(idx: CodeIndex, table: DataFrame, query: str, o: Options, *shown: str) -> DataFrame:
    owner = idx.types if o.generated else idx.types.filter("is_compiler_generated = 0")
    owner = owner.select(F.col("id").alias("type_id"), F.col("full_name").alias("type_full"), F.col("source_id").alias("source_key"))
    m = table.filter(o.hit(F.col("name"), query)).drop("source_id").join(owner, "type_id")
    m = m.join(o.sources(idx), "source_key").join(_files(idx), F.col("file_id") == F.col("file_key"))
    return m.orderBy("type_full", shown[0], "source_id", "id").limit(o.limit).select("source_id", *shown, "type_full", "relative_path", "start_line")


def search_methods(idx: CodeIndex, query: str, limit: int = LIMIT, **options) -> DataFrame:
    return _members(idx, idx.methods, query, Options(limit, **options), "signature")


def search_fields(idx: CodeIndex, query: str, limit: int = LIMIT, **options) -> DataFrame:
    return _members(idx, idx.fields, query, Options(limit, **options), "name", "field_type")


def search_properties(idx: CodeIndex, query: str, limit: int = LIMIT, **options) -> DataFrame:
    return _members(idx, idx.properties, query, Options(limit, **options), "name", "property_type")


def search_strings(idx: CodeIndex, query: str, limit: int = LIMIT, **options) -> DataFrame:
    o = Options(limit, **options)
    found = idx.strings.filter(o.hit(F.col("value"), query, escaped=True)).drop("source_id").join(_files(idx), F.col("file_id") == F.col("file_key"))
    found = found.withColumnRenamed("file_source", "source_key").join(o.sources(idx), "source_key")
    return found.orderBy("value", "relative_path", "start_line", "id").limit(limit).select("source_id", "value", "classification", "relative_path", "start_line")


def search_files(idx: CodeIndex, query: str, limit: int = LIMIT, **options) -> DataFrame:
    o = Options(limit, **options)
    f = _files(idx).filter(o.hit(F.col("relative_path"), query)).withColumnRenamed("file_source", "source_key")
    return f.join(o.sources(idx), "source_key").orderBy("relative_path", "source_id").limit(limit).select("source_id", "relative_path")


def search(idx: CodeIndex, query: str, limit: int = LIMIT, **options) -> dict[str, DataFrame]:
    """The six lists by category."""
    lists = {"types": search_types, "methods": search_methods, "fields": search_fields, "properties": search_properties, "strings": search_strings, "files": search_files}
    return {name: f(idx, query, limit, **options) for name, f in lists.items()}


def search_all(idx: CodeIndex, query: str, **how) -> DataFrame:
    """The six lists as one: (category, source_id, symbol, owner, relative_path, start_line)."""
    names = {"types": ("full_name", None), "methods": ("signature", "type_full"), "fields": ("name", "type_full"), "properties": ("name", "type_full"), "strings": ("value", None), "files": ("relative_path", None)}
    parts = []
    for category, df in search(idx, query, **how).items():
        symbol, owner = names[category]
        line = F.col("start_line").cast("int") if "start_line" in df.columns else F.lit(None).cast("int")
        parts.append(df.select(F.lit(category).alias("category"), "source_id", F.col(symbol).alias("symbol"), (F.col(owner) if owner else F.lit(None).cast("string")).alias("owner"), "relative_path", line.alias("start_line")))
    return reduce(DataFrame.unionByName, parts)
