"""Projections, filters and cell cleaning."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sheetwise.operators import scale


def filter_rows(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate (a column or SQL text) is true."""
    return df.filter(predicate)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in the given (default: all) columns."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def fill_missing(df: DataFrame, value) -> DataFrame:
    """Replace NULL and NaN by ``value``, or per column by a dict of values."""
    return df.na.fill(value)


def blank_nan_text(df: DataFrame) -> DataFrame:
    """Text cells that read ``nan`` in any case become empty."""
    blank = {
        f.name: F.when(F.lower(F.col(f"`{f.name}`")) == "nan", F.lit("")).otherwise(F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if isinstance(f.dataType, StringType)
    }
    return df.withColumns(blank) if blank else df


def cast_columns(df: DataFrame, types: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Change column types; with ``strict=False`` a bad cell becomes NULL."""
    return df.withColumns({c: F.col(c).cast(t) if strict else F.col(c).try_cast(t) for c, t in types.items()})


def set_index(df: DataFrame, key: str) -> DataFrame:
    """The key column first; it must be free of NULL and of repeats to look rows up by it."""
    return df.select(key, *[c for c in df.columns if c != key])


def head(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows in the given order."""
    return scale.first_rows(df, n, order)


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Position 0..n-1 of every row in the given order."""
    return scale.row_index(df, order, name)


def ratio_column(df: DataFrame, top: str, bottom: str, name: str) -> DataFrame:
    """``top / bottom``; a zero denominator gives NULL."""
    return df.withColumn(name, F.try_divide(top, bottom))


def range_power(df: DataFrame, high: str, low: str, power: float, name: str = "result") -> DataFrame:
    """``(max(high) - min(low)) ** power`` as one row."""
    return df.agg(F.pow(F.max(high) - F.min(low), F.lit(power)).alias(name))


def is_blank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | (F.trim(c) == "") | (F.lower(F.trim(c)) == "nan")


def non_blank_queries(queries: DataFrame, col: str = "user_query") -> DataFrame:
    """Rows that really hold a question."""
    return queries.filter(~is_blank(col))


def general_only(queries: DataFrame, col: str = "tagged_query_type") -> DataFrame:
    return queries.filter(F.col(col) == "general")


def training_eligible(
    queries: DataFrame, tag: str = "tagged_query_type", success: str = "successful_code_execution"
) -> DataFrame:
    """Questions usable as examples: not a plot, and the code ran."""
    return queries.filter((F.col(tag) != "plot") & F.col(success))


def corpus_filter(
    df: DataFrame, col: str, any_of: Sequence[str], all_of: Sequence[str] = (), exempt: Column | None = None
) -> DataFrame:
    """Snippets that contain one of ``any_of`` and, unless exempt, all of ``all_of``."""
    text = F.col(col)
    some = F.lit(False)
    for word in any_of:
        some = some | text.contains(word)
    every = F.lit(True)
    for word in all_of:
        every = every & text.contains(word)
    return df.filter(some & (every if exempt is None else exempt | every))


def apply_column(
    df: DataFrame,
    col: str,
    fn: Callable[[Column], Column] | Callable[[pd.Series], pd.Series],
    name: str | None = None,
    python_type: str | None = None,
) -> DataFrame:
    """Apply ``fn`` to a column.

    ``fn`` maps a Spark column to a Spark column and stays in the JVM. Give
    ``python_type`` to run a pandas ``Series -> Series`` function instead.
    """
    if python_type is None:
        result = fn(F.col(col))
    else:
        result = F.pandas_udf(fn, python_type)(F.col(col))
    return df.withColumn(name or col, result)
