"""Words, letters and lines as the operators of this subpackage read them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that ends a word, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: stands for a missing id: smaller than every other
NO_ID = -(2**63)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_id(name: str) -> Column:
    """The id of a row; a missing one counts as the smallest."""
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NO_ID).cast("long"))


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` that do not carry one of these names (in any case)."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def rows_kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], made: Sequence[str]) -> DataFrame:
    """The rows that ``judge`` keeps with the columns they came with, also those named like a result in ``made``."""
    clash = [c for c in docs.columns if c.lower() in made]
    carried = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in clash])) if clash else docs
    same = [F.col(f"__row.`{c}`").alias(c) if c in clash else F.col(f"`{c}`") for c in docs.columns]
    return judge(carried).select(*same)
