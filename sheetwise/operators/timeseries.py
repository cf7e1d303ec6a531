"""Rolling, shifting, resampling and decomposition.

Windows run per group or per block (see ``scale``), so neither a group that
holds a third of the rows nor an ungrouped table ends in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.quantiles import GROUP_ROWS as QUANTILE_ROWS
from sheetwise.operators.quantiles import exact_quantiles
from sheetwise.operators.scale import BLOCK_ROWS, GROUP_ROWS, block_window, framed, present, row_index
from sheetwise.session import settle

#: calendar rules: the unit whose start is a bin's label
RULES = {"s": "SECOND", "min": "MINUTE", "h": "HOUR", "D": "DAY", "MS": "MONTH", "QS": "QUARTER", "YS": "YEAR"}

AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def rolling_mean(
    df: DataFrame,
    col: str,
    window: int,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "rolling_mean",
    group_rows: int = GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of the last ``window`` values; null until that many are present, NaN is not."""

    def build(part, w):
        frame, v = w.rowsBetween(1 - window, 0), present(part, col)
        return part.withColumn(name, F.when(F.count(v).over(frame) == window, F.avg(v).over(frame)))

    return framed(df, order, window - 1, 0, build, by, group_rows, block_rows)


def shift(
    df: DataFrame,
    col: str,
    periods: int,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "shifted",
    group_rows: int = GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The value ``periods`` rows earlier; negative periods look ahead."""

    def build(part, w):
        return part.withColumn(name, F.lag(col, periods).over(w))

    return framed(df, order, max(periods, 0), max(-periods, 0), build, by, group_rows, block_rows)


def pct_change(
    df: DataFrame,
    col: str,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "pct_change",
    group_rows: int = GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Change against the previous row as a share; null after a zero and where a value is missing."""

    def build(part, w):
        v = present(part, col)
        return part.withColumn(name, F.try_divide(v, F.lag(v, 1).over(w)) - 1)

    return framed(df, order, 1, 0, build, by, group_rows, block_rows)


def lag_pairs(df: DataFrame, col: str, lag: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Points ``(y, y_lagged)`` of each value and the one ``lag`` rows later; a missing value is null, NaN too."""

    def build(part, w):
        return part.withColumn("y_lagged", F.lead(present(part, col), lag).over(w)).withColumn("__has", F.lead(F.lit(1), lag).over(w))

    paired = framed(df.select(*by, *order, col), order, 0, lag, build, by)
    return paired.filter(F.col("__has").isNotNull()).select(*by, *order, present(paired, col).alias("y"), "y_lagged")


def _bin(ts: str, rule: str) -> Column:
    """Start of the calendar bin, in wall-clock time: no time zone takes part."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; known: {', '.join(RULES)}")
    t = F.col(ts)
    day = F.to_date(t)
    if rule in ("s", "min", "h"):
        zero = F.lit(0)
        minute = zero if rule == "h" else F.minute(t)
        second = F.floor(F.second(t)) if rule == "s" else zero
        return day.cast("timestamp_ntz") + F.make_dt_interval(zero, F.hour(t), minute, second)
    if rule != "D":
        day = F.trunc(day, RULES[rule])
    return day.cast("timestamp_ntz")


def resample(df: DataFrame, ts: str, rule: str, col: str, agg: str = "mean", name: str = "value") -> DataFrame:
    """One row per calendar bin: ``(bin_index, bin, value)``.

    Bins without rows are present, with a missing value (0 for sum and
    count). The table is read once; its bins are settled. The full calendar
    comes from ``spark.range`` between the first and the last bin, so it is
    spread over tasks too, and ``bin_index`` is dense.
    """
    timed = df.filter(F.col(ts).isNotNull())
    binned = settle(timed.groupBy(_bin(ts, rule).alias("bin")).agg(AGGREGATES[agg](present(df, col)).alias(name)))
    unit = RULES[rule]
    # the start passes the driver as text: a time would be read in the driver's zone
    ends = (
        binned.agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
        .select(F.col("a").cast("string").alias("a"), F.timestamp_diff(unit, F.col("a"), F.col("b")).alias("n"))
        .first()
    )
    n = 0 if ends["a"] is None else ends["n"] + 1
    step = F.expr(f"timestampadd({unit}, bin_index, start)")
    spine = (
        df.sparkSession.range(n)
        .select(F.col("id").alias("bin_index"), F.lit(ends["a"]).cast("timestamp_ntz").alias("start"))
        .select("bin_index", step.alias("bin"))
    )
    value = F.coalesce(F.col(name), F.lit(0)) if agg in ("sum", "count") else F.col(name)
    return spine.join(binned, "bin", "left").select("bin_index", "bin", value.alias(name))


def resample_quantile(
    df: DataFrame, ts: str, rule: str, col: str, q: float, name: str = "value", group_rows: int = QUANTILE_ROWS
) -> DataFrame:
    """Quantile of ``col`` per calendar bin that has rows."""
    binned = df.select(_bin(ts, rule).alias("bin"), col).filter(F.col("bin").isNotNull())
    return exact_quantiles(binned, col, [q], [name], ["bin"], group_rows)


def to_datetime(df: DataFrame, col: str, fmt: str | None = None, name: str | None = None) -> DataFrame:
    """Parse text to a timestamp; text that cannot be parsed becomes NULL."""
    parsed = F.try_to_timestamp(F.col(col), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(col))
    return df.withColumn(name or col, parsed.cast("timestamp_ntz"))


def index_by_time(df: DataFrame, col: str, fmt: str | None = None, key: Sequence[str] = ()) -> DataFrame:
    """The parsed time column first, rows in time order."""
    if dict(df.dtypes)[col] == "string":
        df = to_datetime(df, col, fmt)
    return df.select(col, *[c for c in df.columns if c != col]).orderBy(F.col(col).asc_nulls_last(), *key)


def seasonal_decompose(
    df: DataFrame, ts: str, rule: str, col: str, period: int, agg: str = "mean", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Additive decomposition of the resampled series.

    ``trend`` is the centred moving average over one period (half weights at
    both ends when the period is even), null where it does not fit.
    ``seasonal`` is the mean detrended value of the phase, centred on zero;
    ``resid`` is the rest.
    """
    series = resample(df, ts, rule, col, agg, "observed")
    half = period // 2

    def build(part, w):
        inner = w.rowsBetween(-half, half) if period % 2 else w.rowsBetween(1 - half, half - 1)
        full = F.count("observed").over(w.rowsBetween(-half, half)) == 2 * half + 1
        total = F.sum("observed").over(inner)
        if period % 2 == 0:
            total = total + (F.lag("observed", half).over(w) + F.lead("observed", half).over(w)) / 2
        return part.withColumn("trend", F.when(full, total / period))

    # read three times below, so settled
    trended = settle(
        block_window(series, "bin_index", half, half, build, block_rows=block_rows)
        .withColumn("phase", F.pmod("bin_index", F.lit(period)))
        .withColumn("__rest", F.col("observed") - F.col("trend"))
    )
    phases = trended.groupBy("phase").agg(F.avg("__rest").alias("__level"))
    level = phases.agg(F.avg("__level")).scalar()
    # one row per phase: as small as the period
    seasonal = F.broadcast(phases.select("phase", (F.col("__level") - level).alias("seasonal")))
    return trended.join(seasonal, "phase", "left").select(
        "bin_index", "bin", "observed", "trend", "seasonal", (F.col("__rest") - F.col("seasonal")).alias("resid")
    )


#: from so many lags on, lagged products come from a transform of blocks and not from a column per lag
MANY_LAGS = 32


def _lagged_products(series: DataFrame, max_lag: int, order: Sequence[str], block_rows: int) -> DataFrame:
    """``(lag, c)`` for lags 0..max_lag: sums of products of ``__y`` and the value ``lag`` rows before.

    The series is cut into blocks; a block also gets the ``max_lag`` rows before it. All its lagged sums are one
    product of Fourier transforms, so the work for a row grows with the logarithm of the lags, not with their number.
    """
    block_rows = max(block_rows, 4 * max_lag)
    at = F.col("__at")
    home, last = F.floor(at / block_rows), F.floor((at + max_lag) / block_rows)
    spread = row_index(series.select(*order, "__y"), order, "__at").select("__at", "__y", F.explode(F.sequence(home, last)).alias("__block"))

    def sums(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        start = key[0].as_py() * block_rows - max_lag
        place = rows.column("__at").to_numpy() - start
        all_ = np.zeros(block_rows + max_lag)
        all_[place] = rows.column("__y").to_numpy()
        mine = all_.copy()
        mine[:max_lag] = 0  # the rows of the block before
        size = 1 << (2 * len(all_) - 1).bit_length()
        products = np.fft.irfft(np.fft.rfft(mine, size) * np.conj(np.fft.rfft(all_, size)), size)[: max_lag + 1]
        return pa.table({"lag": pa.array(range(max_lag + 1), pa.int32()), "c": pa.array(products)})

    return spread.groupBy("__block").applyInArrow(sums, "lag int, c double").groupBy("lag").agg(F.sum("c").alias("c"))


def autocorrelation(
    df: DataFrame, col: str, max_lag: int, order: Sequence[str], block_rows: int = BLOCK_ROWS, many: int = MANY_LAGS
) -> DataFrame:
    """``(lag, r)`` for lags 1..max_lag around the overall mean; missing values (NaN too) are left out.

    Few lags come from one windowed pass, ``many`` and more from transforms of blocks; no pairs of rows are formed.
    """
    series = df.select(*order, present(df, col).cast("double").alias("__y")).filter("__y is not null")
    mean = F.lit(series.agg(F.avg("__y")).first()[0])
    if max_lag >= many:
        centred = series.withColumn("__y", F.col("__y") - mean)
        # a row per lag
        products = settle(_lagged_products(centred, max_lag, order, block_rows))
        base = products.filter("lag = 0").agg(F.max("c")).scalar()
        lags_ = df.sparkSession.range(1, max_lag + 1).select(F.col("id").cast("int").alias("lag"))
        return lags_.join(F.broadcast(products), "lag", "left").select("lag", F.try_divide("c", F.nullif(base, F.lit(0.0))).alias("r"))
    lags = range(1, max_lag + 1)

    def build(part, w):
        return part.withColumns({f"__y{k}": F.lag("__y", k).over(w) for k in lags})

    wide = framed(series, order, max_lag, 0, build, block_rows=block_rows)
    base = F.sum((F.col("__y") - mean) * (F.col("__y") - mean)).alias("c0")
    sums = wide.agg(base, *[F.sum((F.col("__y") - mean) * (F.col(f"__y{k}") - mean)).alias(f"c{k}") for k in lags])
    cells = [F.struct(F.lit(k).alias("lag"), F.try_divide(f"c{k}", "c0").alias("r")) for k in lags]
    return sums.select(F.inline(F.array(*cells)))
