"""Order and skew: the pieces that keep positional work off a single task.

Positional operators (index, shift, rolling) need an order that Spark rows do
not have. A window partitioned by a key puts the whole key into one task, so a
key that holds a third of the table would stall it. Here the group sizes are
measured first: ordinary groups use a plain window; hot groups, and tables
without a group, are indexed by one range sort and cut into equal blocks, each
block carrying the few neighbouring rows its frames reach.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sheetwise.session import settle

#: rows one window task may be handed before the group counts as hot
GROUP_ROWS = 5_000_000
#: rows per block of a hot or ungrouped ordered table
BLOCK_ROWS = 1_000_000
#: rows a table may have to be broadcast or sent from the driver
SMALL_ROWS = 100_000

Build = Callable[[DataFrame, WindowSpec], DataFrame]


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; stops reading beyond that."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its size is checked to be small.

    A larger side is returned unhinted, so that Spark joins by shuffle and
    splits skewed partitions adaptively.
    """
    return F.broadcast(df) if is_small(df, rows) else df


def present(df: DataFrame, col: str) -> Column:
    """The column with NaN as NULL: a missing number counts as missing in every statistic and order."""
    c = F.col(col)
    return F.when(~F.isnan(c), c) if dict(df.dtypes).get(col.strip("`")) in ("double", "float") else c


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key cells are all present; the null test reaches the scan."""
    kinds = dict(df.dtypes)
    for k in keys:
        df = df.filter(F.col(f"`{k}`").isNotNull())
        if kinds[k] in ("double", "float"):
            df = df.filter(~F.isnan(F.col(f"`{k}`")))
    return df


def first_rows(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows of a table.

    When the order starts with a plain column, its n-th smallest value is
    looked up from that column alone, and the rows are then read with a filter
    that lets Parquet skip whole row groups. The value stays in Spark (a scalar
    subquery), so it does not depend on the driver's time zone.
    """
    lead = order[0]
    if n > 0 and isinstance(lead, str) and len(df.columns) > 1:
        edge = df.select(lead).orderBy(lead).limit(n).agg(F.max(lead)).scalar()
        df = df.filter(F.col(lead).isNull() | (F.col(lead) <= edge))
    return df.orderBy(*order).limit(n)


def hot_keys(df: DataFrame, by: Sequence[str], limit: int = GROUP_ROWS) -> DataFrame | None:
    """The keys that hold more than ``limit`` rows, or None when there are none.

    One scan of the key columns with partial counts. At most
    ``rows / limit`` keys can qualify.
    """
    counts = df.groupBy(*by).count().filter(F.col("count") > limit).select(*by)
    found = counts.take(SMALL_ROWS + 1)
    if not found:
        return None
    if len(found) <= SMALL_ROWS:
        return F.broadcast(df.sparkSession.createDataFrame(found, counts.schema))
    return counts


#: rows one part of a numbered table is meant to hold, and the most parts and sampled keys there are
PART_ROWS, MOST_PARTS, MOST_KEYS = 100_000, 32_768, 200_000
#: up to so many bounds are compared by a tree of conditions, more by a search in an array
TREE_BOUNDS = 64


def _rising(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """What the leading columns of ``order`` are compared by: values that pass the driver as they are.

    They never fall where the order rises, which is all that cutting a table into ranges needs.
    """
    out = []
    for name in order:
        kind, c = df.schema[name].dataType.simpleString(), F.col(f"`{name}`")
        if kind == "timestamp":
            c = F.unix_micros(c)
        elif kind == "timestamp_ntz":
            c = (F.unix_date(F.to_date(c)).cast("long") * 24 + F.hour(c)) * 3600 + F.minute(c) * 60 + F.second(c)
        elif kind == "date":
            c = F.unix_date(c)
        elif not kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "string", "boolean")):
            break
        out.append(c)
    return out


def range_part(df: DataFrame, order: Sequence[str], rows: int | None = None, part_rows: int = PART_ROWS) -> Column:
    """The number of the range a row lies in: a fixed expression, ranges rise with ``order`` and hold like many rows.

    Their bounds come from a sample of the keys, drawn once by a hash, and are literals of the plan, so
    every evaluation places a row alike and nothing has to be written down. Missing keys are the
    smallest. The sample decides how even the ranges are, never what a result is.
    """
    rows = df.count() if rows is None else rows
    parts = min(MOST_PARTS, -(-rows // part_rows))
    keys = _rising(df, order)
    if parts < 2 or not keys:
        return F.lit(0)
    names = [f"k{i}" for i in range(len(keys))]
    seen = df.select(*[k.alias(n) for k, n in zip(keys, names)])
    every = max(1, rows // min(MOST_KEYS, 32 * parts))
    wide = df.select(F.pmod(F.xxhash64(*keys), F.lit(every)).alias("h"), *[k.alias(n) for k, n in zip(keys, names)])
    # different keys alone: a key is in one range however often it occurs
    found = [tuple(r) for r in wide.filter("h = 0").select(*names).distinct().orderBy(*names).limit(2 * MOST_KEYS).collect()]
    bounds = list(dict.fromkeys(found[len(found) * i // parts] for i in range(1, parts))) if found else []
    if not bounds:
        return F.lit(0)
    kinds = [f.dataType for f in seen.schema.fields]
    literal = lambda b: F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(b, kinds, names)])
    key = F.struct(*[k.alias(n) for k, n in zip(keys, names)])

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key >= literal(bounds[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    if len(bounds) <= TREE_BOUNDS:
        return tree(0, len(bounds))
    known = F.array(*[literal(b) for b in bounds])
    # halves (low, high) until one place is left
    place = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["low"] + at["high"]) / 2).cast("int")
        over = (at["low"] < at["high"]) & (key >= F.get(known, mid))
        low = F.when(over, mid + 1).otherwise(at["low"])
        return F.struct(low.alias("low"), F.when(over | (at["low"] >= at["high"]), at["high"]).otherwise(mid).alias("high"))

    steps = F.array(*[F.lit(0)] * (len(bounds).bit_length() + 1))
    return F.aggregate(steps, place, halve)["low"]


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_index", part_rows: int = PART_ROWS) -> DataFrame:
    """Add the position 0..n-1 of every row in the order of ``order``.

    ``order`` should identify rows uniquely. The table is cut into ranges by a fixed expression
    (``range_part``); rows are numbered inside their range and the ranges' counts, taken from the key columns
    alone, are added. Whole rows move once and are never written down.
    """
    spark = df.sparkSession
    part = range_part(df, order, part_rows=part_rows)
    counts = sorted(tuple(r) for r in df.groupBy(part.alias("part")).count().collect())  # a row per range
    starts = itertools.accumulate((n for _, n in counts), initial=0)
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    placed = df.withColumn("__part", part).withColumn("__place", place)
    columns = [F.col(f"`{c}`") for c in df.columns]
    if len(counts) < 2:
        return placed.select(*columns, F.col("__place").cast("long").alias(name))
    offsets = F.broadcast(spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "__part int, __start long"))
    return placed.join(offsets, "__part").select(*columns, (F.col("__start") + F.col("__place")).alias(name))


def block_window(
    df: DataFrame,
    index: str,
    before: int,
    after: int,
    build: Build,
    by: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``build`` over windows that reach ``before``/``after`` rows.

    ``index`` is a dense row position. Every row goes to its own block and,
    when it lies close to a border, also to the block whose frames reach it;
    the guests are dropped after the window. Results equal those of one
    window over the whole table.
    """
    at = F.col(index)
    home = F.floor(at / F.lit(block_rows))
    first = F.floor(F.greatest(at - after, F.lit(0)) / F.lit(block_rows))
    last = F.floor((at + before) / F.lit(block_rows))
    spread = df.withColumn("__block", F.explode(F.sequence(first, last)))
    window = Window.partitionBy("__block", *by).orderBy(index)
    return build(spread, window).filter(F.col("__block") == home).drop("__block")


def framed(
    df: DataFrame,
    order: Sequence[str],
    before: int,
    after: int,
    build: Build,
    by: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``build(frame, window)`` per group in order, whatever the skew.

    ``build`` adds columns from frames that reach at most ``before`` rows back
    and ``after`` rows ahead. Rows with a missing group key are left out, as a
    grouped table has no group for them.
    """

    def in_blocks(part: DataFrame) -> DataFrame:
        indexed = row_index(part, [*by, *order], "__at")
        return block_window(indexed, "__at", before, after, build, by, block_rows).drop("__at")

    if not by:
        return in_blocks(df)
    keyed = with_keys(df, by)
    hot = hot_keys(keyed, by, group_rows)
    if hot is None:
        return build(keyed, Window.partitionBy(*by).orderBy(*order))
    calm = keyed.join(hot, list(by), "left_anti").select(*keyed.columns)
    busy = keyed.join(hot, list(by), "left_semi").select(*keyed.columns)
    return build(calm, Window.partitionBy(*by).orderBy(*order)).unionByName(in_blocks(busy))


def rank_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add the position 0.. of every row among those with its key, in the order of ``order``; a missing key is a key."""
    hot = hot_keys(df, by, group_rows)
    if hot is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)
    indexed = settle(row_index(df, [*by, *order], "__at"))
    first = indexed.groupBy(*by).agg(F.min("__at").alias("__first")).withColumnsRenamed({k: f"__k_{k}" for k in by})
    same = reduce(lambda a, b: a & b, [indexed[k].eqNullSafe(first[f"__k_{k}"]) for k in by])
    joined = indexed.join(first, same).withColumn(name, F.col("__at") - F.col("__first"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], name)


def hash_order(seed: int, key: Sequence[str | Column]) -> Column:
    """A repeatable pseudo-random order that depends on the row's key only: 60 bits of an MD5 sum."""
    text = F.concat_ws("|", F.lit(seed), *[_as_text(k) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _as_text(key: str | Column) -> Column:
    return F.coalesce((key if isinstance(key, Column) else F.col(key)).cast("string"), F.lit(""))
