"""Exact quantiles that never hold a column's values in one task.

Whole columns take two scans, however many columns and ranks are wanted
(``column_quantiles``): mergeable sketches bracket every rank, then the values
inside the brackets are counted and those below them too. Groups take another way.

Spark's ``percentile`` keeps every distinct value of a group in memory. That
is fine while groups are small, and wrong for a group of a billion distinct
amounts. Groups above ``group_rows`` are therefore narrowed: each pass counts
the values of the interesting range in a few thousand equal bins, keeps only
the bins that hold a wanted rank, and stops when a bin is a single value. A
pass moves nothing but bin counts, and each pass divides the range by the
number of bins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators.scale import present as present_value
from sheetwise.operators.scale import small_side
from sheetwise.session import settle

#: rows a group may have before its values are narrowed instead of held in memory
GROUP_ROWS = 100_000
BINS = 2048
#: a sketch's ranks are right to one in so many; a bracket may hold so many different values before it is narrowed
ACCURACY, INSIDE_ROWS = 10_000, 2_000_000


def _present(df: DataFrame, col: str) -> DataFrame:
    kind = dict(df.dtypes)[col]
    kept = df.filter(F.col(col).isNotNull())
    return kept.filter(~F.isnan(col)) if kind in ("double", "float") else kept


def rank_values(values: DataFrame, ranks: Sequence[int], low, high, bins: int = BINS) -> dict[int, object]:
    """Values at the 0-based ``ranks`` of the one-column table ``values``.

    ``low``/``high`` are the column's extremes. The driver sees at most
    ``bins`` counts per range and pass.
    """
    v = F.col("v")
    found: dict[int, object] = {}
    # a range is (low, high, rows below it, the ranks inside it)
    open_ranges = [(low, high, 0, sorted(set(ranks)))]
    while open_ranges:
        todo = []
        for lo, hi, below, inside in open_ranges:
            if lo == hi:
                found.update({r: lo for r in inside})
            else:
                todo.append((lo, hi, below, inside))
        if not todo:
            break
        which, cell = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (lo, hi, _, _) in enumerate(todo):
            within = v.between(F.lit(lo), F.lit(hi))
            width = (float(hi) - float(lo)) / bins or 1.0
            place = F.floor((v.cast("double") - F.lit(float(lo))) / F.lit(width)).cast("int")
            which = F.when(within, F.lit(i)).otherwise(which)
            # the two ends always get cells of their own, so a range of two values splits
            cell = F.when(
                within,
                F.when(v == F.lit(lo), F.lit(-1))
                .when(v == F.lit(hi), F.lit(bins + 1))
                .otherwise(F.least(F.greatest(place, F.lit(0)), F.lit(bins))),
            ).otherwise(cell)
        counted = (
            values.select("v", which.alias("range"), cell.alias("cell"))
            .filter(F.col("range").isNotNull())
            .groupBy("range", "cell")
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()
        )
        open_ranges = []
        for i, (_, _, below, inside) in enumerate(todo):
            at = below
            for row in sorted((r for r in counted if r["range"] == i), key=lambda r: r["cell"]):
                hit = [r for r in inside if at <= r < at + row["n"]]
                if hit:
                    open_ranges.append((row["lo"], row["hi"], at, hit))
                at += row["n"]
    return found


def exact_quantiles(
    df: DataFrame,
    col: str,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per probability.

    Without ``by`` the result is one row. A group, or an ungrouped table,
    without a value gives nulls.
    """
    if not by:
        at = column_quantiles(df, [col], probs)[col] or [None] * len(probs)
        return df.sparkSession.createDataFrame([at], ", ".join(f"`{n}` double" for n in names))
    present = _present(df, col)
    values = df.select(*by, present_value(df, col).alias(col))
    picks = [F.percentile(col, F.lit(float(p))).alias(n) for p, n in zip(probs, names)]
    sizes = present.groupBy(*by).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))
    large = sizes.filter(F.col("n") > group_rows)
    large = settle(large)
    if not large.take(1):
        return values.groupBy(*by).agg(*picks)
    narrowed = _narrow_groups(present, col, probs, names, list(by), large)
    rest = _with_keys(values, small_side(large.select(*by)), list(by), "left_anti")
    return rest.groupBy(*by).agg(*picks).unionByName(narrowed)


def _spots(probs: Sequence[float], n: int) -> list[float]:
    return [p * (n - 1) for p in probs]


def _between(lower: float, upper: float, s: float) -> float:
    """The arithmetic of Spark's ``percentile``, so that all routes agree to the last bit."""
    return lower if lower == upper else (math.ceil(s) - s) * lower + (s - math.floor(s)) * upper


def column_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY, inside_rows: int = INSIDE_ROWS
) -> dict[str, list[float] | None]:
    """Linear-interpolated quantiles of whole columns, None for a column without a value, by two scans of ``df``.

    The first gives each column's count, ends and sketched quantiles a little below and above the wanted
    ranks. The second counts the values inside these brackets and how many lie below. A rank is then
    read off the counted values. Only a bracket of more than ``inside_rows`` different values is narrowed
    further, by scans of its column.
    """
    numbers = df.select(*[present_value(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    slack = 3 / accuracy
    edges = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)})
    sketched = []
    for i in range(len(cols)):
        c = F.col(f"c{i}")
        sketched += [F.count(c), F.min(c), F.max(c), F.percentile_approx(c, F.array(*map(F.lit, edges)), accuracy)]
    seen = numbers.agg(*[s.alias(f"s{i}") for i, s in enumerate(sketched)]).first()
    brackets: list[tuple[int, float, float]] = []
    ranks: dict[int, list[float]] = {}
    for i in range(len(cols)):
        n, low, high, at = seen[4 * i : 4 * i + 4]
        if not n:
            continue
        ranks[i] = _spots(probs, n)
        found = []
        for p in probs:
            # a sketch of few values is exact up to a rank or two, which the slack does not cover
            near = n > 2 * accuracy
            a = at[edges.index(max(0.0, p - slack))] if near and p > slack else low
            b = at[edges.index(min(1.0, p + slack))] if near and p < 1 - slack else high
            found.append((a, b))
        merged: list[list[float]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        brackets += [(i, a, b) for a, b in merged]
    if not brackets:
        return dict.fromkeys(cols)
    cells = []
    for j, (i, a, b) in enumerate(brackets):
        v = F.col(f"c{i}")
        # values below the bracket count as one cell, those above are not looked at
        cells.append(F.when(v <= F.lit(b), F.struct(F.lit(j).alias("j"), F.when(v >= F.lit(a), v).alias("v"))))
    counted = settle(numbers.select(F.inline(F.filter(F.array(*cells), lambda s: s.isNotNull()))).groupBy("j", "v").count())
    sizes = {r["j"]: r for r in counted.groupBy("j").agg(F.count("v").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("count"))).alias("below")).collect()}
    wanted, wide = [], []
    for i, spots in ranks.items():
        for r in sorted({x for s in spots for x in (math.floor(s), math.ceil(s))}):
            # the bracket with the largest start whose rows below do not reach the rank
            j = max(k for k, b in enumerate(brackets) if b[0] == i and (sizes[k]["below"] or 0) <= r)
            (wide if sizes[j]["n"] > inside_rows else wanted).append((i, j, r))
    at = {}
    if wanted:
        spark = df.sparkSession
        asked = spark.createDataFrame([(i, j, r) for i, j, r in wanted], "i int, j int, r long")
        # one window partition holds the different values of one bracket: at most inside_rows
        up_to = F.sum("count").over(Window.partitionBy("j").orderBy(F.col("v").asc_nulls_first()))
        spread = counted.join(F.broadcast(asked.select("j").distinct()), "j").select("j", "v", up_to.alias("up"), "count")
        hit = spread.join(F.broadcast(asked), "j").filter(F.col("v").isNotNull() & (F.col("r") < F.col("up")) & (F.col("r") >= F.col("up") - F.col("count")))
        at = {(x["i"], x["r"]): x["v"] for x in hit.select("i", "r", "v").collect()}
    wide += [(i, None, r) for i, _, r in wanted if (i, r) not in at]  # beside its bracket, which a right sketch rules out
    for i, j, r in wide:
        (_, a, b), below = (brackets[j], sizes[j]["below"] or 0) if j is not None else ((i, *seen[4 * i + 1 : 4 * i + 3]), 0)
        inside = numbers.select(F.col(f"c{i}").alias("v")).filter(F.col("v").between(a, b))
        at[i, r] = rank_values(inside, [r - below], a, b)[r - below]
    return {
        c: [_between(at[i, math.floor(s)], at[i, math.ceil(s)], s) for s in ranks[i]] if i in ranks else None
        for i, c in enumerate(cols)
    }


def _with_keys(df: DataFrame, keys: DataFrame, by: list[str], how: str) -> DataFrame:
    """Join on the group key, where a missing key is a group like any other."""
    renamed = keys.withColumnsRenamed({k: f"__k_{k}" for k in by})
    condition = F.lit(True)
    for k in by:
        condition = condition & df[k].eqNullSafe(renamed[f"__k_{k}"])
    joined = df.join(renamed, condition, how)
    return joined.drop(*[f"__k_{k}" for k in by]) if how == "inner" else joined


def _narrow_groups(
    present: DataFrame,
    col: str,
    probs: Sequence[float],
    names: Sequence[str],
    by: list[str],
    large: DataFrame,
    bins: int = BINS,
) -> DataFrame:
    """Quantiles of large groups, all groups together in every pass.

    ``open_ranks`` has one row per group and wanted rank: the range the rank's
    value lies in and the number of rows below that range.
    """
    values = present.select(*by, F.col(col).alias("__v"))
    spots = F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in probs])
    ranks = F.array_distinct(F.flatten(F.transform(spots, lambda s: F.array(F.floor(s), F.ceil(s)))))
    open_ranks = large.select(*by, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    found = None
    while True:
        open_ranks = settle(open_ranks)
        done = open_ranks.filter("lo = hi").select(*by, "rank", F.col("lo").cast("double").alias("__at"))
        found = done if found is None else found.unionByName(done)
        open_ranks = open_ranks.filter("lo < hi")
        if not open_ranks.take(1):
            break
        # the ranges of a group are the same or do not touch, so a value meets at most one
        ranges = small_side(open_ranks.select(*by, "lo", "hi", "below").distinct())
        near = _with_keys(values, ranges, by, "inner").filter(F.col("__v").between(F.col("lo"), F.col("hi")))
        width = (F.col("hi").cast("double") - F.col("lo").cast("double")) / F.lit(bins)
        place = F.floor(F.try_divide(F.col("__v").cast("double") - F.col("lo").cast("double"), width)).cast("int")
        cell = (
            F.when(F.col("__v") == F.col("lo"), F.lit(-1))
            .when(F.col("__v") == F.col("hi"), F.lit(bins + 1))
            .otherwise(F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.lit(bins)))
        )
        counts = near.groupBy(*by, "lo", "hi", "below", cell.alias("cell")).agg(
            F.count("*").alias("n"), F.min("__v").alias("cell_lo"), F.max("__v").alias("cell_hi")
        )
        # one window partition holds the cells of one range: at most bins + 3 rows
        order = Window.partitionBy(*by, "lo").orderBy("cell")
        start = F.col("below") + F.sum("n").over(order) - F.col("n")
        cells = counts.withColumn("start", start).select(
            *by, F.col("lo").alias("from_lo"), "start", (F.col("start") + F.col("n")).alias("stop"), "cell_lo", "cell_hi"
        )
        hit = _with_keys(open_ranks, cells, by, "inner").filter(
            (F.col("from_lo") == F.col("lo")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop"))
        )
        open_ranks = hit.select(
            *by, "rank", F.col("cell_lo").alias("lo"), F.col("cell_hi").alias("hi"), F.col("start").alias("below")
        )
    at = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "__at"))).alias("at"))
    picked = _with_keys(large.select(*by, "n"), at, by, "inner")
    out = []
    for p, name in zip(probs, names):
        s = F.lit(float(p)) * (F.col("n") - 1)
        lower, upper = F.element_at("at", F.floor(s)), F.element_at("at", F.ceil(s))
        between = (F.ceil(s) - s) * lower + (s - F.floor(s)) * upper
        out.append(F.when(lower == upper, lower).otherwise(between).alias(name))
    return picked.select(*by, *out)
