"""What a prompt says about a table: its columns, sample values and first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.ordering import first_samples
from sheetwise.operators.scale import first_rows

PROFILE = "table_name string, column_name string, position int, data_type string, sample_values array<string>"


def profile_table(
    df: DataFrame, name: str, n_samples: int, order: Sequence[str | Column], describe: bool = True
) -> DataFrame:
    """One row per column, with its first ``n_samples`` values.

    No samples when ``n_samples`` is 0; no rows at all unless ``describe``.
    """
    if n_samples > 0 and not describe:
        raise ValueError("sample values need column descriptions to be on")
    spark = df.sparkSession
    kinds = [(name, c, i, t, None) for i, (c, t) in enumerate(df.dtypes)] if describe else []
    columns = spark.createDataFrame(kinds, PROFILE)
    if n_samples <= 0 or not describe:
        return columns
    samples = first_samples(df, n_samples, order)
    # one row per column on both sides
    return columns.drop("sample_values").join(F.broadcast(samples.select("column_name", "sample_values")), "column_name", "left").select(
        "table_name", "column_name", "position", "data_type", "sample_values"
    )


def profile_json(profile: DataFrame) -> DataFrame:
    """``(table_name, column_text)``: a table's columns as a JSON list in column order.

    The list is as long as the table is wide.
    """
    entry = F.struct("position", F.struct("column_name", "sample_values").alias("c"))
    gathered = profile.groupBy("table_name").agg(F.sort_array(F.collect_list(entry)).alias("cs"))
    return gathered.select("table_name", F.to_json(F.transform("cs", lambda e: e["c"])).alias("column_text"))


def annotation_json(annotations: DataFrame) -> DataFrame:
    """Column descriptions ``(column, description)`` as one JSON object text."""
    pairs = annotations.agg(F.sort_array(F.collect_list(F.struct("column", "description"))).alias("p"))
    return pairs.select(F.to_json(F.map_from_entries("p")).alias("annotation_text"))


def head_text(df: DataFrame, n: int, order: Sequence[str | Column], name: str = "head_text") -> DataFrame:
    """The first ``n`` rows as one text: a header line, then a line per row; empty when n is 0."""
    spark = df.sparkSession
    if n <= 0:
        return spark.createDataFrame([("",)], f"{name} string")
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NaN")) for c in df.columns]
    lines = first_rows(df, n, order).select(F.concat_ws(" | ", *cells).alias("line"))
    # n lines in order: a limit of an ordered table keeps its order
    body = F.array_join(F.collect_list("line"), "\n")
    return lines.agg(F.concat(F.lit(" | ".join(df.columns) + "\n"), body).alias(name))
