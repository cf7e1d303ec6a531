"""The smallest whole path: load a table, answer a question on it, keep the detail row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetwise.operators import stats
from sheetwise.operators.answering import answer
from sheetwise.sources.registry import TableRegistry


def correlation_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = TableRegistry(spark)
    registry.register("lineitem", f"{sf_dir}/lineitem.parquet")

    def correlate(df: DataFrame) -> DataFrame:
        return stats.corr(df, "l_quantity", "l_extendedprice")

    question = "Find the correlation between quantity and extended price."
    result, detail = answer(registry, "lineitem", question, [correlate])
    if not isinstance(result, DataFrame):
        raise RuntimeError(f"no answer: {detail}")
    return result
