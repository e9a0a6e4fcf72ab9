"""The curated catalog: denormalised entries, their explosion and the rules that keep them consistent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stage import write_text
from .quality import duplicates, missing_keys, outside_domain, symmetric_difference

TIERS, CONFIDENCES, ROLES = ("A", "B", "C"), ("Verified", "Mostly Verified", "Partial"), ("primary", "secondary")
PATTERN_TIERS, PATTERN_STATUSES = ("S", "A"), ("Inferred", "Mostly Verified", "Strong Verified", "Verified")
SUMMARY_CHARS = 80
FLAT = "name tier harmony ui assets persistence".split()


def system_matrix(catalog: DataFrame) -> DataFrame:
    """(mod_id, system, role, evidence_count, confidence): a row for each system of an entry; primary ones count its key files, secondary ones 1."""
    primary = catalog.select(F.col("source_id").alias("mod_id"), F.explode("primary_systems").alias("system"), F.lit("primary").alias("role"), F.size("key_files").alias("evidence_count"), "confidence")
    secondary = catalog.select(F.col("source_id").alias("mod_id"), F.explode("secondary_systems").alias("system"), F.lit("secondary").alias("role"), F.lit(1).alias("evidence_count"), "confidence")
    return primary.unionByName(secondary)


def pattern_candidates(catalog: DataFrame) -> DataFrame:
    """(pattern_id, mod_id, system, confidence): a row for each candidate; its system is the first primary one or Utility."""
    sure = F.when(F.col("confidence") == "Verified", "verified").otherwise("inferred")
    system = F.coalesce(F.try_element_at("primary_systems", F.lit(1)), F.lit("Utility"))
    return catalog.select(F.explode("pattern_candidates").alias("pattern_id"), F.col("source_id").alias("mod_id"), system.alias("system"), sure.alias("confidence"))


def flat_catalog(catalog: DataFrame) -> DataFrame:
    """The tabular form: lists joined by pipes."""
    return catalog.select(F.col("source_id").alias("mod_id"), *FLAT, F.concat_ws("|", "primary_systems").alias("primary_systems"), "confidence", "profile")


def roll_up(rows: DataFrame, by: str, member: str) -> DataFrame:
    """(by, n, members): how many and which, sorted."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))


def candidate_rows(catalog: DataFrame) -> DataFrame:
    """(pattern_id, goal, system, mod_id, file, symbol, reason, confidence): a row for each of an entry's patterns (id, goal); the reason is the summary's first 80 characters."""
    sure = F.when(F.col("confidence") == "Verified", "verified").otherwise("inferred")
    system = F.coalesce(F.try_element_at("primary_systems", F.lit(1)), F.lit("Utility"))
    rows = catalog.withColumn("p", F.explode("patterns"))
    return rows.select(
        F.concat(F.lit("candidate:"), "p.id").alias("pattern_id"), "p.goal", system.alias("system"), F.col("source_id").alias("mod_id"), F.col("profile").alias("file"), F.lit("").alias("symbol"),
        F.substring("summary", 1, SUMMARY_CHARS).alias("reason"), sure.alias("confidence"),
    )


def write_catalog(catalog: DataFrame, folder: str) -> list[str]:
    """catalog.json (an array), catalog.csv (lists joined by pipes), system-matrix.csv (sorted by all columns) and pattern-candidates.jsonl, each one file; what was written.

    Rows are joined into texts by Spark in their order, so each file is one cell of one row; a catalog is written by hand and has dozens of entries.
    """
    flat, matrix = flat_catalog(catalog), system_matrix(catalog)

    def text(rows: DataFrame, line: Column, order: list[str], head: str = "", between: str = "\n", tail: str = "\n") -> str:
        lines = rows.select(F.struct(*order, line.alias("__line")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
        return head + lines.select(F.array_join(F.transform("xs", lambda x: x["__line"]), between)).first()[0] + tail

    as_csv = lambda df: F.to_csv(F.struct(*df.columns), {"quoteAll": "false", "escape": '"'})
    as_json = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    files = {
        "catalog.json": text(catalog, as_json(catalog), ["source_id"], "[\n", ",\n", "\n]\n"), "catalog.csv": text(flat, as_csv(flat), ["mod_id"], ",".join(flat.columns) + "\n"),
        "system-matrix.csv": text(matrix, as_csv(matrix), matrix.columns, ",".join(matrix.columns) + "\n"),
    }
    if "patterns" in catalog.columns:
        candidates = candidate_rows(catalog)
        files["pattern-candidates.jsonl"] = text(candidates, as_json(candidates), ["mod_id", "pattern_id"])
    for name, body in files.items():
        write_text(catalog.sparkSession, f"{folder.rstrip('/')}/{name}", body)
    return sorted(files)


def _as_problems(rule: str, rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("subject"))


def catalog_problems(catalog: DataFrame, flat: DataFrame, matrix: DataFrame, profiles: DataFrame | None = None, expected: int | None = None) -> DataFrame:
    """(rule, subject) of everything inconsistent; none if all is well."""
    ids = catalog.select(F.col("source_id").alias("mod_id"))
    primary = catalog.select(F.col("source_id").alias("mod_id"), F.explode("primary_systems").alias("system"))
    marked = matrix.filter("role = 'primary'").select("mod_id", "system")
    parts = [
        _as_problems("duplicate id", duplicates(ids, ["mod_id"]), "mod_id"), _as_problems("flat ids", symmetric_difference(ids, flat, ["mod_id"]), "mod_id"),
        _as_problems("matrix ids", missing_keys(matrix, ids, ["mod_id"]), "mod_id"), _as_problems("matrix primaries", symmetric_difference(primary, marked, ["mod_id", "system"]), "mod_id"),
        _as_problems("tier", outside_domain(catalog, "source_id", "tier", TIERS), "source_id"), _as_problems("confidence", outside_domain(catalog, "source_id", "confidence", CONFIDENCES), "source_id"),
        _as_problems("role", outside_domain(matrix, "mod_id", "role", ROLES), "mod_id"),
    ]
    if profiles is not None:
        parts.append(_as_problems("profile", missing_keys(catalog.select("profile"), profiles, ["profile"]), "profile"))
    if expected is not None:
        count = catalog.agg(F.count("*").alias("n")).filter(F.col("n") != expected)
        parts.append(_as_problems("cardinality", count, "n"))
    return reduce(DataFrame.unionByName, parts)


def pattern_problems(patterns: DataFrame, texts: DataFrame, known: DataFrame, sections: tuple[str, ...], categories: tuple[str, ...], expected: int | None = None) -> DataFrame:
    """(rule, subject) for patterns (id, category, tier, status, references, file), their texts (file, text) and known (source_id)."""
    p = patterns.select("id", "file").join(texts, "file", "left")
    lacking = p.select("id", F.explode(F.filter(F.array(*map(F.lit, sections)), lambda s: ~F.coalesce(F.contains("text", s), F.lit(False)))).alias("section"))
    cited = patterns.select("id", F.explode("references").alias("source_id"))
    parts = [
        _as_problems("duplicate id", duplicates(patterns, ["id"]), "id"), _as_problems("section", lacking, "id"),
        _as_problems("evidence", p.filter(~F.coalesce(F.col("text").rlike(r"\.cs:[0-9]+"), F.lit(False))), "id"), _as_problems("inferred", patterns.filter("status = 'Inferred'"), "id"),
        _as_problems("tier", outside_domain(patterns, "id", "tier", PATTERN_TIERS), "id"), _as_problems("status", outside_domain(patterns, "id", "status", PATTERN_STATUSES), "id"),
        _as_problems("category", outside_domain(patterns, "id", "category", categories), "id"), _as_problems("reference", cited.join(known, "source_id", "left_anti"), "id"),
        _as_problems("files", symmetric_difference(patterns, texts, ["file"]), "file"),
    ]
    if expected is not None:
        parts.append(_as_problems("cardinality", patterns.agg(F.count("*").alias("n")).filter(F.col("n") != expected), "n"))
    return reduce(DataFrame.unionByName, parts)
