"""Named tables, loaded on first use."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from sheetwise.sources.tables import load_table


class TableRegistry:
    """Table name -> path. A table is read, and its view made, when asked for."""

    def __init__(self, spark: SparkSession, keep: bool = False):
        self.spark = spark
        self.keep = keep  # persist tables that are asked about more than once
        self._paths: dict[str, str] = {}
        self._loaded: dict[str, DataFrame] = {}

    def register(self, name: str, path: str) -> None:
        self._paths[name] = path

    def put(self, name: str, df: DataFrame) -> None:
        """Register a DataFrame that exists already."""
        self._loaded[name] = df
        df.createOrReplaceTempView(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._loaded:
            df = load_table(self.spark, self._paths[name])
            if self.keep:
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self.put(name, df)
        return self._loaded[name]

    def is_loaded(self, name: str) -> bool:
        return name in self._loaded

    def swap(self, name: str, path: str) -> None:
        """Point ``name`` at another file; the old table is released."""
        old = self._loaded.pop(name, None)
        if old is not None:
            old.unpersist()
            self.spark.catalog.dropTempView(name)
        self._paths[name] = path
