"""Wide and long forms.

A wide result has one column per category. The categories are given by the
caller or looked up; whoever asks for the wide form gets it. The long form
(``pivot_long``) has the same cells as rows and suits any number of categories, and so
do the wide form in blocks of columns (``pivot_blocks``) and the sparse form (``pivot_sparse``):
categories are numbered in a table of their own; a block has a column for each of
its numbers, a sparse row lists the numbers it has a cell for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.scale import row_index, small_side, with_keys
from sheetwise.operators.stats import multi_agg, named_aggregate
from sheetwise.session import settle


def categories(df: DataFrame, col: str) -> list:
    """The sorted different values of a column: as many as the wide form has columns."""
    return sorted(r[0] for r in with_keys(df.select(col), [col]).distinct().toLocalIterator())


def pivot_long(
    df: DataFrame, index: Sequence[str], columns: str, values: str, aggfunc: str = "mean", name: str = "value"
) -> DataFrame:
    """The cells of ``pivot_table`` as rows: index key, category, value."""
    kept = with_keys(df, [*index, columns])
    return kept.groupBy(*index, columns).agg(named_aggregate(kept, aggfunc, values).alias(name))


def pivot_table(
    df: DataFrame, index: Sequence[str], columns: str, values: str, aggfunc: str = "mean", column_values=None
) -> DataFrame:
    """One row per index key, one column per category; missing keys are left out."""
    kept = with_keys(df, [*index, columns])
    found = categories(kept, columns) if column_values is None else list(column_values)
    # given values are not counted again by Spark, so its own limit does not apply
    return kept.groupBy(*index).pivot(columns, found).agg(named_aggregate(kept, aggfunc, values))


def category_numbers(df: DataFrame, col: str, name: str = "number") -> DataFrame:
    """``(col, n, number)``: the different values numbered 0.. by falling count, then by value; none passes the driver."""
    counts = with_keys(df.select(col), [col]).groupBy(col).agg(F.count("*").alias("n"))
    ranked = row_index(settle(counts.withColumn("__down", -F.col("n"))), ["__down", col], name)
    return ranked.select(col, "n", name)


def pivot_sparse(
    df: DataFrame, index: Sequence[str], columns: str, values: str, aggfunc: str = "mean", width: int = 65_536
) -> tuple[DataFrame, DataFrame]:
    """The cells of ``pivot_table`` as sparse vectors, and the dictionary of categories.

    ``(*index, chunk, numbers, cells)``: the numbers of the categories a key has and the values there, in the order
    of the numbers. A vector is cut at multiples of ``width`` numbers, so no array grows with the
    categories. A cell whose aggregate is missing is left out, as an absent one is.
    """
    known = settle(category_numbers(df, columns))
    cells = pivot_long(df, index, columns, values, aggfunc, "__cell").filter(F.col("__cell").isNotNull())
    placed = cells.join(small_side(known.select(columns, "number")), columns)
    held = F.array_sort(F.collect_list(F.struct("number", "__cell")))
    rows = placed.groupBy(*index, F.floor(F.col("number") / width).alias("chunk")).agg(held.alias("__held"))
    taken = lambda field: F.transform("__held", lambda s: s[field])
    return rows.select(*index, "chunk", taken("number").alias("numbers"), taken("__cell").alias("cells")), known


def pivot_blocks(
    df: DataFrame, index: Sequence[str], columns: str, values: str, aggfunc: str = "mean", width: int = 250
) -> tuple[DataFrame, DataFrame]:
    """The table of ``pivot_table`` cut into blocks of ``width`` columns, and the dictionary of categories.

    ``(*index, chunk, 0 .. width - 1)``: column ``p`` of a block is the category numbered ``chunk * width + p``. A row
    and a plan never have more than ``width`` cells, whatever the number of categories, and none of these
    passes the driver. A key has no row for a block it has no cell in; the last block ends in nulls.
    """
    known = settle(category_numbers(df, columns))
    places = known.select(
        columns, F.floor(F.col("number") / width).alias("chunk"), F.pmod("number", F.lit(width)).cast("int").alias("__place")
    )
    placed = with_keys(df, [*index, columns]).join(small_side(places), columns)
    return pivot_table(placed, [*index, "chunk"], "__place", values, aggfunc, range(width)), known


def melt_blocks(
    wide: DataFrame, known: DataFrame, id_vars: Sequence[str], columns: str, value_name: str = "value"
) -> DataFrame:
    """Wide to long for both results of ``pivot_blocks``: a row per cell that has a value, with its category."""
    places = [c for c in wide.columns if c not in (*id_vars, "chunk")]
    cells = melt(wide, [*id_vars, "chunk"], places, "__place", value_name).filter(F.col(f"`{value_name}`").isNotNull())
    cells = cells.withColumn("number", F.col("chunk") * len(places) + F.col("__place").cast("long"))
    return cells.join(small_side(known.select(columns, "number")), "number").select(*id_vars, columns, value_name)


def pivot_multi(df: DataFrame, index: Sequence[str], spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """Several aggregates per value column, over a compound index."""
    return multi_agg(df, spec, by=index)


def melt(
    df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str], var_name: str = "variable", value_name: str = "value"
) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def crosstab(df: DataFrame, a: str, b: str, column_values=None) -> DataFrame:
    """Counts of ``a`` by ``b``, 0 where a pair does not occur."""
    kept = with_keys(df, [a, b])
    found = categories(kept, b) if column_values is None else list(column_values)
    return kept.groupBy(a).pivot(b, found).agg(F.count(F.lit(1))).na.fill(0)


def get_dummies(df: DataFrame, col: str, column_values=None, as_int: bool = False) -> DataFrame:
    """Replace a column by one indicator ``col_value`` per category."""
    found = categories(df, col) if column_values is None else list(column_values)
    flags = {}
    for v in found:
        flag = F.col(col).eqNullSafe(F.lit(v))
        flags[f"{col}_{v}"] = flag.cast("int") if as_int else flag
    return df.withColumns(flags).drop(col)
