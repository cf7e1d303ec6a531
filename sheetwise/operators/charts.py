"""The tables behind charts.

No picture is drawn. What leaves Spark is as large as the chart: bins, slices,
box figures. Line and scatter charts of all points are the exception.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators import stats
from sheetwise.operators.ordering import bottom_k, top_k
from sheetwise.operators.quantiles import column_quantiles
from sheetwise.operators.scale import hash_order, present, row_index


def chart_line(df: DataFrame, x: str, y: str, key: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """Points ``(x, y)`` in x order, or the mean per equal-width x bin."""
    points = df.select(present(df, x).alias("x"), present(df, y).alias("y"), *key).filter("x is not null")
    if bins is None:
        return points.orderBy("x", *key).select("x", "y")
    ends = _ends(points, "x") or (0.0, 1.0)
    return (
        points.withColumn("bin", _bin_of("x", ends, bins))
        .groupBy("bin")
        .agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        .orderBy("bin")
    )


def chart_line_mean(df: DataFrame, x: str, y: str, reach: float = 1.96) -> DataFrame:
    """``(x, n, mean, low, high)``: the mean of ``y`` per x, and ``reach`` standard errors around it.

    An x with a single value has no band (null).
    """
    value = present(df, y)
    rows = df.select(present(df, x).alias("x"), value.cast("double").alias("y")).filter("x is not null and y is not null")
    grouped = rows.groupBy("x").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("s"))
    width = F.lit(reach) * F.col("s") / F.sqrt(F.col("n"))
    band = F.when(F.col("n") > 1, width)
    return grouped.select("x", "n", "mean", (F.col("mean") - band).alias("low"), (F.col("mean") + band).alias("high")).orderBy("x")


def chart_bar(df: DataFrame, col: str) -> DataFrame:
    """``(category, value)``: how often each value occurs."""
    return stats.value_counts(df, col, "value").withColumnRenamed(col, "category").orderBy(F.col("value").desc(), "category")


def chart_bar_top(df: DataFrame, label: str, value: Column, k: int) -> DataFrame:
    """``(category, value)`` of the ``k`` largest values."""
    return top_k(df.select(F.col(label).alias("category"), value.alias("value")), "value", k, ["category"])


def chart_pie(df: DataFrame, label: str, col: str, k: int, largest: bool = True) -> DataFrame:
    """``(category, value, share, is_max)`` of the top or bottom ``k`` rows; shares add up to 1."""
    rows = df.select(F.col(label).alias("category"), F.col(col).alias("value"))
    few = (top_k if largest else bottom_k)(rows, "value", k, ["category"])
    # k rows: gathered once, so that share and maximum are of the same k rows
    whole = few.agg(F.collect_list(F.struct("category", "value")).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, s: a + s["value"].cast("double"))
    whole = whole.select("s", total.alias("total"), F.array_max(F.transform("s", lambda s: s["value"])).alias("top"))
    return whole.select("total", "top", F.inline("s")).select(
        "category",
        "value",
        F.try_divide(F.col("value").cast("double"), F.col("total")).alias("share"),
        (F.col("value") == F.col("top")).alias("is_max"),
    )


def _ends(df: DataFrame, col: str) -> tuple[float, float] | None:
    """Lowest and highest value, widened when they are equal."""
    row = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    if row["lo"] is None:
        return None
    return (row["lo"] - 0.5, row["hi"] + 0.5) if row["lo"] == row["hi"] else (row["lo"], row["hi"])


def _edge(lo: float, hi: float, bins: int, i: Column) -> Column:
    """Left edge of bin ``i``; the last edge is exactly ``hi``."""
    return F.when(i >= bins, F.lit(hi)).otherwise(F.lit(lo) + i.cast("double") * F.lit((hi - lo) / bins))


def _bin_of(col: str, ends: tuple[float, float], bins: int) -> Column:
    lo, hi = ends
    v = F.col(col).cast("double")
    guess = F.floor((v - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)).cast("int")
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(bins - 1))
    # rounding may put a value one bin off; the edges decide
    guess = F.when(v < _edge(lo, hi, bins, guess), guess - 1).otherwise(guess)
    return F.when((v >= _edge(lo, hi, bins, guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)


def chart_hist(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """``(bin, low, high, n)``: equal-width bins, the last one closed, empty ones kept."""
    rows = df.select(present(df, col).alias(col)).filter(F.col(col).isNotNull())
    ends = _ends(rows, col) or (0.0, 1.0)
    counts = rows.groupBy(_bin_of(col, ends, bins).alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    low, high = _edge(*ends, bins, F.col("bin")), _edge(*ends, bins, F.col("bin") + 1)
    # counts has at most one row per bin
    joined = spine.join(F.broadcast(counts), "bin", "left")
    return joined.select("bin", low.alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def chart_box(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 box lengths and the number of outliers, per column that holds a value.

    Three scans, however many columns: two for all quartiles and one for all whiskers.
    """
    found = {c: q for c, q in column_quantiles(df, cols, [0.25, 0.5, 0.75]).items() if q is not None}
    if not found:
        raise ValueError("none of the columns holds a value")
    rows = []
    for c, (q1, middle, q3) in found.items():
        reach = 1.5 * (q3 - q1)
        v = present(df, c)
        inside = v.between(F.lit(q1 - reach), F.lit(q3 + reach))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                *[F.lit(float(x)).alias(n) for n, x in (("q1", q1), ("median", middle), ("q3", q3))],
                F.min(F.when(inside, v)).cast("double").alias("whisker_low"),
                F.max(F.when(inside, v)).cast("double").alias("whisker_high"),
                F.count_if(~inside).alias("n_outliers"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def chart_scatter(
    df: DataFrame, x: str, y: str, share: float = 1.0, seed: int = 0, key: Sequence[str] = ()
) -> DataFrame:
    """Points ``(x, y)``: all of them, or a repeatable sample of about ``share``."""
    if share < 1.0:
        df = df.filter(F.pmod(hash_order(seed, key), F.lit(1_000_000)) < int(share * 1_000_000))
    u, v = present(df, x), present(df, y)
    return df.select(u.alias("x"), v.alias("y"))


def chart_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points with the value of the least-squares line: ``(x, y, fitted)``; a missing x has no fitted value."""
    line = stats.trend_line(df, y, x).select(F.struct("slope", "intercept")).scalar()
    u, v = present(df, x), present(df, y)
    return df.select(u.alias("x"), v.alias("y"), (line["slope"] * u + line["intercept"]).alias("fitted"))


def chart_scatter_matrix(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """``(kind, column_a, column_b, bin, value)``: correlations, and a histogram per column."""
    out = stats.corr_matrix(df, cols).select(
        F.lit("corr").alias("kind"), "column_a", "column_b", F.lit(-1).alias("bin"), F.col("corr").alias("value")
    )
    # all ends from one scan, all histograms from another
    numbers = df.select(*[present(df, c).cast("double").alias(c) for c in cols])
    seen = numbers.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    ends = {}
    for c in cols:
        lo, hi = (0.0, 1.0) if seen[f"lo_{c}"] is None else (seen[f"lo_{c}"], seen[f"hi_{c}"])
        ends[c] = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    placed = [F.struct(F.lit(c).alias("column_a"), _bin_of(c, ends[c], bins).alias("bin"), F.col(c).isNotNull().alias("has")) for c in cols]
    counts = numbers.select(F.inline(F.array(*placed))).filter("has").groupBy("column_a", "bin").agg(F.count("*").alias("n"))
    names = F.explode(F.array(*map(F.lit, cols)))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), names.alias("column_a"))
    # one row per column and bin
    hist = spine.join(F.broadcast(counts), ["column_a", "bin"], "left").select(
        F.lit("hist").alias("kind"),
        "column_a",
        F.col("column_a").alias("column_b"),
        "bin",
        F.coalesce("n", F.lit(0)).cast("double").alias("value"),
    )
    return out.unionByName(hist)


def bootstrap_stats(
    df: DataFrame, col: str, key: Sequence[str], size: int = 50, samples: int = 500, seed: int = 0
) -> DataFrame:
    """Mean, median and mid-range of ``samples`` random draws of ``size`` values of the whole column.

    Draws are without replacement (all values if there are fewer). The rows
    are numbered in the order of ``key``; a sample takes different positions
    that follow from an MD5 sum of seed, sample and turn, and only these
    positions are joined to the rows. The result is repeatable.
    """
    rows = df.select(present(df, col).cast("double").alias("v"), *key).filter("v is not null")
    numbered = row_index(rows, key, "__at").select("__at", "v")
    n = numbered.count()
    turns = df.sparkSession.range(samples).select((F.col("id") + 1).alias("sample"))
    if n > 4 * size:
        # more turns than needed: some positions come up twice
        at = F.pmod(hash_order(seed, ["sample", "turn"]), F.lit(n))
        turns = turns.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(3 * size)))).withColumn("__at", at)
        turns = turns.groupBy("sample", "__at").agg(F.min("turn").alias("luck"))
    else:
        turns = turns.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else turns.withColumn("__at", F.lit(0))
        turns = turns.withColumn("luck", hash_order(seed, ["sample", "__at"]))
    # a few hundred positions per sample
    first = Window.partitionBy("sample").orderBy("luck", "__at")
    picked = turns.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= size)
    # at most ``size`` values a sample, added in their own order: the last bit of a mean depends on it
    drawn = picked.join(numbered, "__at").groupBy("sample").agg(F.array_sort(F.collect_list("v")).alias("s"), F.median("v").alias("median"))
    total = F.aggregate("s", F.lit(0.0), lambda a, v: a + v)
    return drawn.select("sample", (total / F.size("s")).alias("mean"), "median", ((F.array_min("s") + F.array_max("s")) / 2).alias("midrange"))
