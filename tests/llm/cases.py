"""Tables with what an operator must stand: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = "the quick brown fox jumps over the lazy dog while seven wizards brew potent tea near an old stone bridge"
LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(60_000))
CLASHING = ("id", "row", "n", "len", "hash", "key", "part", "slot", "cell", "bands", "owner_id", "language", "share", "item", "__gone", "__leaks", "x", "y", "repeated", "bytes", "label", "step", "g", "word", "shard", "value", "kept", "root", "nth", "accepted")

ROWS = [
    (None, PLAIN, "en", "a", 1),
    (None, None, None, None, None),
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, " \n\t ", None, "b", 4),
    (4, PLAIN, "en", "b", None),
    (5, PLAIN, "en", "b", None),
    (5, PLAIN, "en", "b", None),
    (6, LONG, "en", "c", 1),
    (7, "Ein kurzer Satz über Brücken", "de", "c", 1),
    (8, "!!! ... ???", "en", "c", 1),
    (9, "x", "en", "c", 1),
]


def table(spark: SparkSession, rows: list[tuple], schema: str = SCHEMA) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def awkward(spark: SparkSession) -> DataFrame:
    """ROWS with further columns whose names the operators use inside."""
    return table(spark, ROWS).withColumns({c: F.lit(f"{c}!") for c in CLASHING})


def empty(spark: SparkSession) -> DataFrame:
    return table(spark, [])


def documents(spark: SparkSession, sf: str = "0.001") -> DataFrame:
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
