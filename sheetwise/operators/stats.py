"""Statistics of columns and groups.

Everything here is one aggregation with partial results per input partition,
unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.text import token_count
from sheetwise.operators.quantiles import exact_quantiles
from sheetwise.operators.scale import present, with_keys

#: functions that may be named in ``multi_agg`` and the reshape operators
NAMED = {
    "max": F.max,
    "min": F.min,
    "mean": F.avg,
    "sum": F.sum,
    "count": F.count,
    "std": F.stddev_samp,
    "nunique": F.count_distinct,
}

#: functions that need an order of the rows
ORDERED = {"first": F.min_by, "last": F.max_by}


def named_aggregate(df: DataFrame, fn: str, col: str, order: Sequence[str] = ()) -> Column:
    """An aggregate by its name over the present values; ``median`` is left to ``median``, which scales.

    ``first`` and ``last`` are the present values at the ends of ``order``.
    """
    value = present(df, col)
    if fn in ORDERED:
        if not order:
            raise ValueError(f"{fn!r} needs an order of the rows")
        return ORDERED[fn](value, F.when(value.isNotNull(), F.struct(*order)))
    if fn not in NAMED:
        raise ValueError(f"unknown aggregate {fn!r}; known: {', '.join(sorted([*NAMED, *ORDERED]))}")
    return NAMED[fn](value)


def column_stat(df: DataFrame, col: str, fn: str, name: str | None = None) -> DataFrame:
    """One statistic of one column as a one-row table; missing values are skipped."""
    return df.agg(named_aggregate(df, fn, col).alias(name or f"{col}_{fn}"))


def median(df: DataFrame, col: str, by: Sequence[str] = (), approx: bool = False, name: str = "median") -> DataFrame:
    """Median with interpolation; ``approx`` gives a one-pass approximation.

    Rows without a group key are left out; a group without a value has a null median.
    """
    df = with_keys(df, by)
    if approx:
        return df.groupBy(*by).agg(F.percentile_approx(present(df, col), 0.5, 10_000).alias(name))
    return exact_quantiles(df, col, [0.5], [name], by)


def unique(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def nunique(df: DataFrame, col: str, approx: bool = False, name: str = "nunique") -> DataFrame:
    """Number of different values, missing ones not counted."""
    value = present(df, col)
    return df.agg((F.approx_count_distinct(value) if approx else F.count_distinct(value)).alias(name))


def _complete(df: DataFrame, a: str, b: str) -> tuple[Column, Column]:
    """Both columns as numbers where both are present, else null."""
    x, y = present(df, a), present(df, b)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x.cast("double")), F.when(both, y.cast("double"))


def _complete_corr(df: DataFrame, a: str, b: str) -> Column:
    return F.corr(*_complete(df, a, b))


def corr(df: DataFrame, a: str, b: str, name: str = "corr") -> DataFrame:
    """Pearson correlation over the rows where both values are present."""
    return df.agg(_complete_corr(df, a, b).alias(name))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairwise correlations as ``(column_a, column_b, corr)``, from one scan."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[_complete_corr(df, a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        for left, right in {(a, b), (b, a)}:
            cells.append(
                F.struct(
                    F.lit(left).alias("column_a"), F.lit(right).alias("column_b"), F.col(f"`{a}|{b}`").alias("corr")
                )
            )
    return wide.select(F.inline(F.array(*cells)))


def group_stat(df: DataFrame, by: Sequence[str], cols: Sequence[str], fn: str) -> DataFrame:
    """One statistic per group and column; rows without a group key are left out."""
    return with_keys(df, by).groupBy(*by).agg(*[named_aggregate(df, fn, c).alias(f"{c}_{fn}") for c in cols])


def multi_agg(
    df: DataFrame, spec: Mapping[str, Sequence[str]], by: Sequence[str] = (), order: Sequence[str] = ()
) -> DataFrame:
    """Several statistics at once, named ``column_function``; ``first`` and ``last`` follow ``order``."""
    if by:
        df = with_keys(df, by)
    return df.groupBy(*by).agg(*[named_aggregate(df, fn, c, order).alias(f"{c}_{fn}") for c, fns in spec.items() for fn in fns])


def summary(df: DataFrame, cols: Sequence[str], fns: Sequence[str] = ("max", "min", "mean")) -> DataFrame:
    """``(column, stat, value)`` rows from one scan."""
    wide = df.agg(*[named_aggregate(df, fn, c).cast("double").alias(f"{c}|{fn}") for c in cols for fn in fns])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(fn).alias("stat"), F.col(f"`{c}|{fn}`").alias("value"))
        for c in cols
        for fn in fns
    ]
    return wide.select(F.inline(F.array(*cells)))


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    return with_keys(df, [col]).groupBy(col).agg(F.count("*").alias(name))


def count_where(df: DataFrame, predicate: Column, name: str = "count") -> DataFrame:
    return df.agg(F.count_if(predicate).alias(name))


def mean_and_members(df: DataFrame, predicate: Column, col: str, member: str, name: str = "mean") -> DataFrame:
    """The mean over the chosen rows and the name of every one of them.

    One row per member, each with the mean beside it, so that the list of
    names can be as long as the table. The mean is a scalar subquery.
    """
    chosen = df.filter(predicate).select(member, col)
    return chosen.select(member, chosen.agg(F.avg(present(df, col))).scalar().alias(name))


def best_by(df: DataFrame, score: Column, tie: Sequence[str], largest: bool = True, name: str = "score") -> DataFrame:
    """The row with the best score; equal scores go to the smallest tie key."""
    scored = df.withColumn(name, score)
    scored = scored.filter(present(scored, name).isNotNull())
    order = F.col(name).desc() if largest else F.col(name).asc()
    return scored.orderBy(order, *tie).limit(1)


def trend_line(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x``: slope, intercept and r2."""
    a, b = _complete(df, y, x)
    return df.agg(
        F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2")
    )


def group_members(df: DataFrame, key: str, label: str, chunk: int = 65_536) -> DataFrame:
    """Key -> row labels, as ``(key, chunk, members)``.

    ``label`` is a whole number that identifies the row (see ``row_index``).
    A group's labels are cut at multiples of ``chunk``, so no array exceeds
    ``chunk`` labels however large the group is, and all labels are kept.
    """
    if dict(df.dtypes)[label] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{label!r} is not a whole number; number the rows with row_index first")
    part = F.floor(F.col(label) / F.lit(chunk)).alias("chunk")
    return with_keys(df, [key]).groupBy(key, part).agg(F.sort_array(F.collect_list(label)).alias("members"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def token_budget(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Estimated number of tokens per group: words and single punctuation marks."""
    total = sum((token_count(c) for c in cols[1:]), token_count(cols[0]))
    return df.groupBy(*by).agg(F.sum(total.cast("long")).alias("tokens"))
