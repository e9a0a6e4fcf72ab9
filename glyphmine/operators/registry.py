"""Change detection over source registries and state machines over manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity(kind: Column) -> Column:
    """The values whose change means that a source changed, for registry rows (kind, sha256, build_id, version, commit, assemblies, file_count, total_size, latest_mtime)."""
    text = lambda *names: F.to_json(F.struct(*(F.col(n).alias(n) for n in names)), {"ignoreNullFields": "false"})
    return (
        F.when(kind == "game", text("kind", "sha256", "build_id", "version")).when(kind == "assembly", text("kind", "sha256"))
        .when(kind == "loader", text("kind", "commit", "version", "assemblies")).otherwise(text("kind", "file_count", "total_size", "latest_mtime"))
    )


def diff(old: DataFrame, new: DataFrame, key: str, identity_: Column) -> DataFrame:
    """(key, status): NEW, MISSING, CHANGED or UNCHANGED by a null-safe comparison of identities."""
    a = old.select(key, identity_.alias("was"), F.lit(True).alias("in_old"))
    b = new.select(key, identity_.alias("now"), F.lit(True).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "NEW").when(F.col("in_new").isNull(), "MISSING").when(F.col("was").eqNullSafe(F.col("now")), "UNCHANGED").otherwise("CHANGED")
    return a.join(b, key, "full").select(key, status.alias("status"))


def tally(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def snapshot_state(manifests: DataFrame) -> DataFrame:
    """(source_id, state) of rows (source_id, has_manifest, has_files, recorded_hash, actual_hash, recorded_tool, actual_tool)."""
    state = (
        F.when(~F.coalesce(F.col("has_manifest"), F.lit(False)) | ~F.coalesce(F.col("has_files"), F.lit(False)), "MISSING").when(~F.col("recorded_hash").eqNullSafe(F.col("actual_hash")), "STALE")
        .when(~F.col("recorded_tool").eqNullSafe(F.col("actual_tool")), "OK-EXTRACTOR-CHANGED").otherwise("OK")
    )
    return manifests.select("source_id", state.alias("state"))


def index_state(indexed: DataFrame, current: DataFrame, version: int) -> DataFrame:
    """(source_id, state, reason): rows (source_id, snapshot_id, schema_version) of an index against the snapshots (source_id, snapshot_id) of now."""
    a = indexed.select("source_id", F.col("snapshot_id").alias("was"), "schema_version", F.lit(True).alias("in_index"))
    b = current.select("source_id", F.col("snapshot_id").alias("now"), F.lit(True).alias("in_snapshots"))
    reason = (
        F.when(F.col("in_index").isNull(), "source added").when(F.col("in_snapshots").isNull(), "source removed").when(F.col("schema_version") != version, "schema version")
        .when(~F.col("was").eqNullSafe(F.col("now")), "snapshot changed")
    )
    return a.join(b, "source_id", "full").select("source_id", F.when(reason.isNull(), "OK").otherwise("STALE").alias("state"), reason.alias("reason"))
