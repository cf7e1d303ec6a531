"""Stacking and comparing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.scale import GROUP_ROWS, rank_in_group
from sheetwise.session import settle


def concat_rows(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack tables; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def concat_splits(splits: Mapping[str, DataFrame], drop: Sequence[str] = ("text",)) -> DataFrame:
    """Stack named splits with a ``split`` column, without the ``drop`` columns."""
    return concat_rows([df.withColumn("split", F.lit(name)) for name, df in splits.items()]).drop(*drop)


def extend_split(prev: DataFrame, new: DataFrame, name: str = "train") -> DataFrame:
    """The former split unchanged, and an extended one (``<name>_upd``) that adds the new rows."""
    longer = concat_rows([prev, new]).withColumn("split", F.lit(f"{name}_upd"))
    return concat_rows([prev.withColumn("split", F.lit(name)), longer])


def merge_pairs(dfs: Sequence[DataFrame], source: str = "input_prompt", target: str = "completed_code") -> DataFrame:
    """Prompt/code sheets below one another as ``(input, output)``."""
    return concat_rows([df.select(F.col(source).alias("input"), F.col(target).alias("output")) for df in dfs])


def frame_diff(a: DataFrame, b: DataFrame, check_types: bool = True) -> DataFrame:
    """Rows that one table has more often than the other: ``(..., side, times)``.

    Repeats count. One pass with partial aggregation over both tables.
    """
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    if check_types and dict(a.dtypes) != dict(b.dtypes):
        raise ValueError(f"types differ: {a.dtypes} and {b.dtypes}")
    names = [f"`{c}`" for c in a.columns]
    both = a.select(*names, F.lit(1).cast("long").alias("__d")).unionByName(
        b.select(*names, F.lit(-1).cast("long").alias("__d"))
    )
    net = both.groupBy(*names).agg(F.sum("__d").alias("__d")).filter("__d <> 0")
    side = F.when(F.col("__d") > 0, F.lit("left")).otherwise(F.lit("right"))
    return net.select(*names, side.alias("side"), F.abs("__d").alias("times"))


def _unequal(a: DataFrame, b: DataFrame, key: Sequence[str], rest: Sequence[str], group_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows one table has more often than the other, each as often as that, numbered within their key.

    Rows that are equal in all cells meet first, so only what differs is paired; it is numbered in the order of the
    cells that are no floating numbers, then of those, since these may differ a little.
    """
    exact = [c for c in rest if dict(b.dtypes)[c] not in ("double", "float")]
    order = [*exact, *[c for c in rest if c not in exact]]
    net = [frame_diff(a, b, check_types=False).filter(F.col("side") == side) for side in ("left", "right")]
    net = [df.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("side", "times") for df in net]
    return tuple(rank_in_group(settle(df), key, [*order, "__turn"], "__rank", group_rows).drop("__turn") for df in net)


def frame_close(
    a: DataFrame, b: DataFrame, key: Sequence[str], rel: float = 1e-5, abs_: float = 1e-8, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Cells that differ between two tables with the same key: ``(key, column, left, right)``.

    Numbers may differ by ``abs_ + rel * |right|``; missing cells are equal to each
    other, and so are missing keys. Rows that share a key are paired one to one: equal rows with each other, the rest in
    the order of their cells. A row that only one table has differs in the column ``"__row"``.
    """
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    kinds, rest = dict(b.dtypes), [c for c in a.columns if c not in key]
    left, right = _unequal(a, b, key, rest, group_rows)
    left = left.select(*[F.col(f"`{k}`").alias(f"__l_{k}") for k in key], F.col("__rank").alias("__l"), F.struct(F.lit(True).alias("__has"), *rest).alias("__a"))
    right = right.select(*[F.col(f"`{k}`").alias(f"__r_{k}") for k in key], F.col("__rank").alias("__r"), F.struct(F.lit(True).alias("__has"), *rest).alias("__b"))
    same_key = reduce(lambda x, y: x & y, [F.col(f"__l_{k}").eqNullSafe(F.col(f"__r_{k}")) for k in key])
    both = left.join(right, (F.col("__l") == F.col("__r")) & same_key, "full_outer")
    both = both.select(*[F.when(F.col("__a").isNotNull(), F.col(f"__l_{k}")).otherwise(F.col(f"__r_{k}")).alias(k) for k in key], "__a", "__b")
    cells = []
    for c in rest:
        x, y = F.col(f"__a.`{c}`"), F.col(f"__b.`{c}`")
        same = x.eqNullSafe(y)
        if kinds[c] in ("double", "float") or kinds[c].startswith("decimal"):
            u, v = x.cast("double"), y.cast("double")
            same = same | F.coalesce(F.abs(u - v) <= F.lit(abs_) + F.lit(rel) * F.abs(v), F.lit(False))
        cells.append((c, x, y, ~same))
    alone = F.col("__a").isNull() | F.col("__b").isNull()
    shown = [F.when(~alone & bad, F.struct(F.lit(c).alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right"))) for c, x, y, bad in cells]
    row = F.struct(
        F.lit("__row").alias("column"),
        F.when(F.col("__a").isNotNull(), "present").alias("left"),
        F.when(F.col("__b").isNotNull(), "present").alias("right"),
    )
    found = F.filter(F.array(F.when(alone, row), *shown), lambda s: s.isNotNull())
    return both.select(*key, F.inline(found))


def assert_frame_equal(a: DataFrame, b: DataFrame, check_types: bool = True) -> None:
    """Raise AssertionError with a few differing rows unless the tables hold the same rows."""
    try:
        rows = frame_diff(a, b, check_types).take(5)
    except ValueError as e:
        raise AssertionError(str(e)) from e
    if rows:
        raise AssertionError(f"tables differ, for example in {rows}")
