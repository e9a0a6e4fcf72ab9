"""The index as a set of DataFrames, read from Parquet or derived from a star schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .schemas import TABLES


@dataclass
class CodeIndex:
    """Tables by name; attributes give them too. Missing tables are empty."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        found = self.__dict__["tables"].get(name)
        return found if found is not None else self.spark.createDataFrame([], TABLES[name])

    def register(self, prefix: str = "") -> None:
        """Temporary views, so any Spark SQL may be asked."""
        for name in TABLES:
            getattr(self, name).createOrReplaceTempView(prefix + name)


def open_index(spark: SparkSession, path: str) -> CodeIndex:
    """The index published under path (see plans.publish)."""
    from .plans.publish import current

    where = current(spark, path)
    if where is None:
        raise FileNotFoundError(f"no index under {path}: build one first")
    return CodeIndex(spark, {name: spark.read.schema(kind).parquet(f"{where}/{name}") for name, kind in TABLES.items()})
