"""A catalog of indexes and logs by name and ordinal, over Spark's temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.ordinals, self.next = spark, {}, 0

    def reserve(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, name: str, df: DataFrame, ordinal: int | None = None) -> int:
        if name in self.ordinals:
            raise ValueError(f"already_exists: {name}")
        self.ordinals[name] = self.reserve() if ordinal is None else ordinal
        df.createOrReplaceTempView(name)
        return self.ordinals[name]

    def get(self, name: str) -> DataFrame:
        if name not in self.ordinals:
            raise KeyError(f"not_found: {name}")
        return self.spark.table(name)

    def by_ordinal(self, ordinal: int) -> DataFrame:
        return self.get(next(n for n, o in self.ordinals.items() if o == ordinal))

    def remove(self, name: str) -> None:
        self.get(name)
        del self.ordinals[name]
        self.spark.catalog.dropTempView(name)

    def names(self) -> list[str]:
        return sorted(self.ordinals)
