"""Parquet table access and the named-table registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Catalog:
    """Name -> DataFrame registry; registered merge results are addressable by name.

    Every entry is also a temp view, so SQL and DataFrame code see the same tables.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}
        for k, v in (tables or {}).items():
            self.register(k, v)

    @classmethod
    def from_dir(cls, spark: SparkSession, sf_dir: str, names=TABLES) -> "Catalog":
        return cls(spark, {n: load(spark, sf_dir, n) for n in names})

    def register(self, name: str, df: DataFrame) -> DataFrame:
        self._tables[name] = df
        df.createOrReplaceTempView(name)
        return df

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise KeyError(f"table '{name}' is not registered; known: {sorted(self._tables)}")
        return self._tables[name]

    def names(self) -> list[str]:
        return list(self._tables)

    def __contains__(self, name: str) -> bool:
        return name in self._tables
