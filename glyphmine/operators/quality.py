"""Validation rules as rows, so a report is one DataFrame and a gate is one filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CodeIndex

FAILED_PER_CENT = 1
LEAST_FILES, LEAST_LOADER_FILES, SAMPLES, LOADER_NAMESPACE = 50, 20, 5, "NeoModLoader"


def validate_index(idx: CodeIndex, expected: DataFrame | None = None, failed_per_cent: dict[str, int] | None = None, core_types: tuple[str, ...] = (), primary: str | None = None, literals: tuple[str, ...] = (), namespaces: dict[str, str] | None = None, strict: bool = True) -> DataFrame:
    """(rule, subject, ok, detail): file coverage and failed share by source, tables that must not be empty, resolved calls, core types, literals, namespaces.

    expected: (source_id, n) raw files. strict: an empty table of declarations only warns, as a small corpus may have no properties.
    """
    parts = []

    def rule(df: DataFrame) -> None:
        parts.append(df.select("rule", "subject", "ok", F.col("detail").cast("string").alias("detail")))

    files = idx.files.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("parse_status") == "FAILED").alias("failed"))
    by_source = idx.sources.select("id", F.col("source_id").alias("subject")).join(files.withColumnRenamed("source_id", "id"), "id", "left").fillna(0, ["n", "failed"])
    limits = F.create_map(*(x for k, v in (failed_per_cent or {}).items() for x in (F.lit(k), F.lit(v)))) if failed_per_cent else None
    allowed = F.coalesce(limits[F.col("subject")], F.lit(FAILED_PER_CENT)) if limits is not None else F.lit(FAILED_PER_CENT)
    rule(by_source.select(F.lit("failed_share").alias("rule"), "subject", ((F.col("n") > 0) & (F.col("failed") * 100 <= allowed * F.col("n"))).alias("ok"), F.concat_ws("/", "failed", "n").alias("detail")))
    if expected is not None:
        raw = expected.select(F.col("source_id").alias("subject"), F.col("n").alias("raw"))
        rule(by_source.join(raw, "subject", "full").select(F.lit("coverage").alias("rule"), "subject", F.col("n").eqNullSafe(F.col("raw")).alias("ok"), F.concat_ws("/", "n", "raw").alias("detail")))
    for name in "types methods fields properties strings inheritance".split() + ("symbol_references method_calls type_references".split() if core_types else []):
        n = getattr(idx, name).limit(1).agg(F.count("*").alias("n"))
        rule(n.select(F.lit("not_empty").alias("rule"), F.lit(name).alias("subject"), ((F.col("n") > 0) | F.lit(strict and name not in ("types", "methods"))).alias("ok"), F.col("n").alias("detail")))
    if core_types:
        n = idx.method_calls.filter("resolution_status = 'resolved'").limit(1).agg(F.count("*").alias("n"))
        rule(n.select(F.lit("resolved_calls").alias("rule"), F.lit("method_calls").alias("subject"), (F.col("n") > 0).alias("ok"), F.col("n").alias("detail")))
        home = idx.sources.filter(F.col("source_id") == primary) if primary else idx.sources
        real = idx.types.filter("is_compiler_generated = 0").join(home.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        counts = real.agg(*(F.count_if(F.col("name") == c).alias(f"c{k}") for k, c in enumerate(core_types)))
        rule(counts.select(F.explode(F.array(*(F.struct(F.lit("core_type").alias("rule"), F.lit(c).alias("subject"), (F.col(f"c{k}") > 0).alias("ok"), F.col(f"c{k}").alias("detail")) for k, c in enumerate(core_types)))).alias("r")).select("r.*"))
    for literal in literals:
        n = idx.strings.filter(F.col("value") == literal).limit(1).agg(F.count("*").alias("n"))
        rule(n.select(F.lit("literal").alias("rule"), F.lit(literal).alias("subject"), (F.col("n") > 0).alias("ok"), F.col("n").alias("detail")))
    for source, prefix in (namespaces or {}).items():
        own = idx.types.join(idx.sources.filter(F.col("source_id") == source).select(F.col("id").alias("source_id")), "source_id", "left_semi")
        n = own.filter(F.col("namespace").startswith(prefix)).limit(1).agg(F.count("*").alias("n"))
        rule(n.select(F.lit("namespace").alias("rule"), F.lit(source).alias("subject"), (F.col("n") > 0).alias("ok"), F.col("n").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right doesn't have."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def symmetric_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., side): distinct keys that one side alone has."""
    return missing_keys(left, right, keys).withColumn("side", F.lit("left")).unionByName(missing_keys(right, left, keys).withColumn("side", F.lit("right")))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def outside_domain(rows: DataFrame, key: str, column: str, domain: tuple[str, ...]) -> DataFrame:
    """(key, value) of rows whose value isn't of the domain."""
    return rows.filter(~F.coalesce(F.col(column).isin(*domain), F.lit(False))).select(key, F.col(column).alias("value"))


def sample_sources(files: DataFrame, n: int = 5, least: int = 50) -> DataFrame:
    """One row (n_files, n_bad, ok): n files of (relative_path, content), chosen by hash, must be non-empty, without NUL, and look like code."""
    total = files.agg(F.count("*").alias("total"))
    spaced = files.select("relative_path", "content", F.xxhash64("relative_path").alias("h")).orderBy("h", "relative_path").limit(n)
    text = F.col("content").cast("string")
    bad = (F.length(F.trim(text)) == 0) | text.contains("\x00") | ~text.rlike(r"\b(class|struct|interface|enum|namespace|using|delegate|record)\b")
    return total.crossJoin(spaced.agg(F.count_if(bad).alias("n_bad"))).select(F.col("total").alias("n_files"), "n_bad", ((F.col("total") >= least) & (F.col("n_bad") == 0)).alias("ok"))


def validate_extraction(files: DataFrame, loader: bool = False) -> DataFrame:
    """One row (ok, csharp_files, total_files, total_bytes, project_files, namespace_hits, problems) about all files (relative_path, content) of an extraction.

    There must be LEAST_FILES of C#, and SAMPLES of them, evenly spaced by path, must be non-empty, without NUL, and look like code;
    a loader's must also hold a file with its namespace.
    """
    path, text = F.lower("relative_path"), F.col("content").cast("string")
    totals = files.agg(
        F.count_if(path.endswith(".cs")).alias("csharp_files"), F.count("*").alias("total_files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("total_bytes"),
        F.count_if(path.rlike(r"\.(csproj|sln)$")).alias("project_files"), F.count_if(path.endswith(".cs") & text.rlike(rf"(?m)^\s*namespace\s+{LOADER_NAMESPACE}")).alias("namespace_hits"),
    )
    places = files.filter(path.endswith(".cs")).select("relative_path", (F.row_number().over(Window.orderBy("relative_path")) - 1).alias("at"))
    step = F.greatest(F.lit(1), F.floor(F.col("csharp_files") / SAMPLES))
    chosen = places.crossJoin(totals.select("csharp_files")).filter((F.col("at") % step == 0) & (F.col("at") < step * SAMPLES)).select("relative_path", "at")
    name = F.element_at(F.split("relative_path", "/"), -1)
    problem = (
        F.when(~text.rlike(r"\S"), F.concat(F.lit("empty sample "), name)).when(text.contains("\x00"), F.concat(F.lit("binary content in sample "), name))
        .when(~(text.rlike(r"\b(class|struct|interface|enum)\s+") | text.rlike(r"(?m)^\s*\[assembly:") | text.contains("using ")), F.concat(F.lit("no C# syntax in sample "), name))
    )
    bad = files.join(F.broadcast(chosen), "relative_path").select("at", problem.alias("problem")).filter("problem is not null")
    found = bad.agg(F.array_sort(F.collect_list(F.struct("at", "problem"))).getField("problem").alias("sampled"))
    none = F.when(F.col("csharp_files") == 0, F.array(F.lit("no .cs files produced"))).otherwise(F.col("sampled"))
    few = (F.size("content_problems") == 0) & (F.col("csharp_files") < (LEAST_FILES if not loader else max(LEAST_FILES, LEAST_LOADER_FILES)))
    unlike = F.lit(loader) & (F.col("namespace_hits") == 0)
    lists = [F.col("content_problems"), F.when(few, F.array(F.format_string("only %d .cs files", "csharp_files"))), F.when(unlike, F.array(F.lit(f"no {LOADER_NAMESPACE}-namespace types found in output")))]
    report = totals.crossJoin(found).withColumn("content_problems", none).withColumn("problems", F.flatten(F.array_compact(F.array(*lists))))
    return report.select((F.size("problems") == 0).alias("ok"), "csharp_files", "total_files", "total_bytes", "project_files", "namespace_hits", "problems")


def core_type_probe(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(name, found): whether some file of (content) declares a class of the name."""
    text = F.col("content").cast("string")
    flags = files.agg(*(F.coalesce(F.max(text.rlike(rf"\bclass\s+{name}\b")), F.lit(False)).alias(f"c{k}") for k, name in enumerate(names)))
    return flags.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"c{k}").alias("found")) for k, name in enumerate(names)))).alias("r")).select("r.*")
