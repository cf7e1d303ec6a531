"""Statistics, time series and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import charts, stats, timeseries
from sheetwise.plans.registry import SPARSE_EVENTS, hash_sql, in_place, nan_events, query, rounded, sparse_events, table

# ---- statistics ----


@query("agg_max", "SELECT max(l_extendedprice) AS l_extendedprice_max FROM lineitem")
def _(spark, d):
    return stats.column_stat(table(spark, d, "lineitem"), "l_extendedprice", "max")


@query("agg_min", "SELECT min(l_shipdate) AS l_shipdate_min FROM lineitem")
def _(spark, d):
    return stats.column_stat(table(spark, d, "lineitem"), "l_shipdate", "min")


@query("agg_mean", f"SELECT round(avg(value), 6) AS value_mean FROM {SPARSE_EVENTS}")
def _(spark, d):
    return rounded(stats.column_stat(sparse_events(spark, d), "value", "mean"), 6, "value_mean")


@query("agg_median", "SELECT round(median(l_extendedprice), 4) AS median FROM lineitem")
def _(spark, d):
    return rounded(stats.median(table(spark, d, "lineitem"), "l_extendedprice"), 4, "median")


@query(
    "group_median",
    "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY o_orderpriority",
)
def _(spark, d):
    return rounded(stats.median(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]), 4, "median")


@query("agg_sum", "SELECT round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders")
def _(spark, d):
    return rounded(stats.column_stat(table(spark, d, "orders"), "o_totalprice", "sum"), 2, "o_totalprice_sum")


@query("agg_count", f"SELECT count(value) AS value_count FROM {SPARSE_EVENTS}")
def _(spark, d):
    return stats.column_stat(sparse_events(spark, d), "value", "count")


@query("agg_std", "SELECT round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_std FROM lineitem")
def _(spark, d):
    return rounded(stats.column_stat(table(spark, d, "lineitem"), "l_extendedprice", "std"), 4, "l_extendedprice_std")


@query("agg_unique", "SELECT DISTINCT p_brand FROM part")
def _(spark, d):
    return stats.unique(table(spark, d, "part"), "p_brand")


@query("agg_nunique", "SELECT count(DISTINCT l_partkey) AS \"nunique\" FROM lineitem")
def _(spark, d):
    return stats.nunique(table(spark, d, "lineitem"), "l_partkey")


@query("corr_pair", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem")
def _(spark, d):
    return rounded(stats.corr(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 6, "corr")


_MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM lineitem"
        for a in _MATRIX
        for b in _MATRIX
    ),
)
def _(spark, d):
    return rounded(stats.corr_matrix(table(spark, d, "lineitem"), _MATRIX), 6, "corr")


@query(
    "group_sum",
    "SELECT c_nationkey, round(sum(c_acctbal), 2) AS c_acctbal_sum FROM customer GROUP BY c_nationkey",
)
def _(spark, d):
    return rounded(stats.group_stat(table(spark, d, "customer"), ["c_nationkey"], ["c_acctbal"], "sum"), 2, "c_acctbal_sum")


@query(
    "group_mean",
    f"""SELECT event_type, round(avg(value), 6) AS value_mean FROM {SPARSE_EVENTS} GROUP BY event_type""",
)
def _(spark, d):
    return rounded(stats.group_stat(sparse_events(spark, d), ["event_type"], ["value"], "mean"), 6, "value_mean")


@query(
    "multi_agg",
    """SELECT round(sum(l_quantity), 2) AS l_quantity_sum, min(l_quantity) AS l_quantity_min,
    max(l_extendedprice) AS l_extendedprice_max, round(avg(l_extendedprice), 4) AS l_extendedprice_mean FROM lineitem""",
)
def _(spark, d):
    spec = {"l_quantity": ["sum", "min"], "l_extendedprice": ["max", "mean"]}
    return rounded(
        rounded(stats.multi_agg(table(spark, d, "lineitem"), spec), 2, "l_quantity_sum"), 4, "l_extendedprice_mean"
    )


@query(
    "summary_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{s}' AS stat, round({f}({c}), 4) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
        for c in ("o_totalprice", "l_quantity")
        for s, f in (("max", "max"), ("min", "min"), ("mean", "avg"))
    ),
)
def _(spark, d):
    joined = table(spark, d, "orders").join(
        table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")
    )
    return rounded(stats.summary(joined, ["o_totalprice", "l_quantity"]), 4, "value")


@query("value_counts", 'SELECT event_type, count(*) AS "count" FROM events GROUP BY event_type')
def _(spark, d):
    return stats.value_counts(table(spark, d, "events"), "event_type")


@query("count_where", "SELECT count(*) FILTER (event_type = 'click') AS \"count\" FROM events")
def _(spark, d):
    return stats.count_where(table(spark, d, "events"), F.col("event_type") == "click")


@query(
    "mean_and_members",
    """SELECT c_name, (SELECT round(avg(c_acctbal), 4) FROM customer WHERE c_acctbal > 9000) AS mean
    FROM customer WHERE c_acctbal > 9000""",
)
def _(spark, d):
    found = stats.mean_and_members(table(spark, d, "customer"), F.col("c_acctbal") > 9000, "c_acctbal", "c_name")
    return rounded(found, 4, "mean")


@query(
    "best_by",
    """SELECT p_partkey, p_name, p_retailprice / p_size AS score FROM part WHERE p_retailprice >= 950 AND p_size <> 0
    ORDER BY score DESC, p_partkey LIMIT 1""",
)
def _(spark, d):
    dear = table(spark, d, "part").filter("p_retailprice >= 950")
    best = stats.best_by(dear, F.try_divide("p_retailprice", "p_size"), ["p_partkey"])
    return best.select("p_partkey", "p_name", "score")


@query(
    "trend_line",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
    round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
    round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""",
)
def _(spark, d):
    line = stats.trend_line(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return rounded(rounded(rounded(line, 4, "slope"), 2, "intercept"), 6, "r2")


@query(
    "group_members",
    """SELECT o_custkey, CAST(floor(o_orderkey / 4096) AS BIGINT) AS chunk,
    string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY ALL""",
)
def _(spark, d):
    members = stats.group_members(table(spark, d, "orders"), "o_custkey", "o_orderkey", chunk=4096)
    return members.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def _(spark, d):
    return stats.shape(table(spark, d, "lineitem"))


@query(
    "token_budget",
    r"""SELECT source, CAST(sum(length(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))) AS BIGINT) AS tokens
    FROM documents GROUP BY source""",
)
def _(spark, d):
    return stats.token_budget(table(spark, d, "documents"), ["text"], ["source"])


# ---- time series ----

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "value")


@query(
    "rolling_mean",
    f"""SELECT event_id, user_id, value, CASE WHEN count(value) OVER w = 3 THEN round(avg(value) OVER w, 6) END AS rolling_mean
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    out = timeseries.rolling_mean(_events(spark, d), "value", 3, ["ts", "event_id"], ["user_id"])
    return rounded(out, 6, "rolling_mean").drop("ts")


@query(
    "rolling_mean_all",
    """SELECT event_id, user_id, value, CASE WHEN count(value) OVER w = 3 THEN round(avg(value) OVER w, 6) END AS rolling_mean
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    out = timeseries.rolling_mean(_events(spark, d), "value", 3, ["ts", "event_id"])
    return rounded(out, 6, "rolling_mean").drop("ts")


@query("shift", f"SELECT event_id, user_id, value, lag(value, 1) {_W} AS shifted FROM events")
def _(spark, d):
    return timeseries.shift(_events(spark, d), "value", 1, ["ts", "event_id"], ["user_id"]).drop("ts")


@query("shift_back", f"SELECT event_id, user_id, value, lead(value, 2) {_W} AS shifted FROM events")
def _(spark, d):
    return timeseries.shift(_events(spark, d), "value", -2, ["ts", "event_id"], ["user_id"]).drop("ts")


@query(
    "pct_change",
    f"SELECT event_id, user_id, value / nullif(lag(value, 1) {_W}, 0) - 1 AS pct_change FROM events",
)
def _(spark, d):
    out = timeseries.pct_change(_events(spark, d), "value", ["ts", "event_id"], ["user_id"])
    return out.select("event_id", "user_id", "pct_change")


def _bins_sql(unit: str, agg: str, value: str, where: str = "") -> str:
    return f"""
    WITH e AS (SELECT date_trunc('{unit}', ts) AS bin, value FROM events {where}),
    b AS (SELECT bin, {agg}(value) AS v FROM e GROUP BY bin),
    s AS (SELECT unnest(generate_series((SELECT min(bin) FROM e), (SELECT max(bin) FROM e), INTERVAL 1 {unit})) AS bin)
    SELECT row_number() OVER (ORDER BY s.bin) - 1 AS bin_index, CAST(s.bin AS TIMESTAMP) AS bin, {value} AS value
    FROM s LEFT JOIN b ON s.bin = b.bin"""


@query("resample_day", _bins_sql("day", "avg", "round(v, 6)"))
def _(spark, d):
    return rounded(timeseries.resample(table(spark, d, "events"), "ts", "D", "value"), 6, "value")


@query("resample_hour_sparse", _bins_sql("minute", "sum", "round(coalesce(v, 0), 4)"))
def _(spark, d):
    return rounded(timeseries.resample(table(spark, d, "events"), "ts", "min", "value", "sum"), 4, "value")


@query(
    "resample_quantile",
    """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS bin, round(quantile_cont(o_totalprice, 0.8), 4) AS value
    FROM orders GROUP BY 1""",
)
def _(spark, d):
    return rounded(timeseries.resample_quantile(table(spark, d, "orders"), "o_orderdate", "MS", "o_totalprice", 0.8), 4, "value")


@query(
    "to_datetime",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS written FROM orders""",
)
def _(spark, d):
    bad = F.when(F.col("o_orderkey") % 10 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    orders = table(spark, d, "orders").select("o_orderkey", bad.alias("written"))
    return timeseries.to_datetime(orders, "written", "yyyy/MM/dd")


@query(
    "index_by_time",
    "SELECT o_orderdate, o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders",
)
def _(spark, d):
    few = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return in_place(timeseries.index_by_time(few, "o_orderdate", key=["o_orderkey"]))


def _decompose_sql(period: int) -> str:
    half = period // 2
    if period % 2:
        total = f"sum(observed) OVER (ORDER BY i ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    else:
        total = (
            f"(sum(observed) OVER (ORDER BY i ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING)"
            f" + (lag(observed, {half}) OVER (ORDER BY i) + lead(observed, {half}) OVER (ORDER BY i)) / 2)"
        )
    return f"""
    WITH o AS (SELECT bin_index AS i, bin, value AS observed FROM ({_bins_sql("day", "avg", "v")})),
    t AS (SELECT *, CASE WHEN count(observed) OVER (ORDER BY i ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) = {2 * half + 1}
                    THEN {total} / {period} END AS trend FROM o),
    p AS (SELECT i % {period} AS phase, avg(observed - trend) AS level FROM t GROUP BY 1),
    s AS (SELECT phase, level - (SELECT avg(level) FROM p) AS seasonal FROM p)
    SELECT i AS bin_index, CAST(bin AS TIMESTAMP) AS bin, round(observed, 6) AS observed, round(trend, 6) AS trend,
           round(seasonal, 6) AS seasonal, round(observed - trend - seasonal, 6) AS resid
    FROM t JOIN s ON t.i % {period} = s.phase"""


@query("seasonal_decompose", _decompose_sql(7))
def _(spark, d):
    out = timeseries.seasonal_decompose(table(spark, d, "events"), "ts", "D", "value", 7)
    return rounded(out, 6, "observed", "trend", "seasonal", "resid")


@query("seasonal_decompose_even", _decompose_sql(4))
def _(spark, d):
    out = timeseries.seasonal_decompose(table(spark, d, "events"), "ts", "D", "value", 4)
    return rounded(out, 6, "observed", "trend", "seasonal", "resid")


_LAGS = " UNION ALL ".join(
    f"""SELECT {k} AS lag, round(sum((y - m) * (y{k} - m)) / sum((y - m) * (y - m)), 6) AS r FROM l, a"""
    for k in range(1, 6)
)


@query(
    "autocorrelation",
    f"""WITH l AS (SELECT value AS y, {", ".join(f"lag(value, {k}) OVER (ORDER BY ts, event_id) AS y{k}" for k in range(1, 6))}
    FROM events), a AS (SELECT avg(value) AS m FROM events) {_LAGS}""",
)
def _(spark, d):
    return rounded(timeseries.autocorrelation(table(spark, d, "events"), "value", 5, ["ts", "event_id"]), 6, "r")


@query(
    "lag_pairs",
    """SELECT * FROM (SELECT ts, event_id, value AS y, lead(value, 2) OVER (ORDER BY ts, event_id) AS y_lagged FROM events)
    WHERE y_lagged IS NOT NULL""",
)
def _(spark, d):
    return timeseries.lag_pairs(table(spark, d, "events"), "value", 2, ["ts", "event_id"])


# ---- charts ----


@query("chart_line", "SELECT ts AS x, value AS y FROM events")
def _(spark, d):
    return charts.chart_line(table(spark, d, "events"), "ts", "value", ["event_id"])


@query(
    "chart_line_binned",
    """WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
    SELECT CAST(least(floor((l_quantity - lo) * 7 / (hi - lo)), 6) AS INTEGER) AS bin, round(avg(l_quantity), 6) AS x,
    round(avg(l_extendedprice), 4) AS y FROM lineitem, e GROUP BY 1""",
)
def _(spark, d):
    line = charts.chart_line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", bins=7)
    return rounded(rounded(line, 6, "x"), 4, "y")


@query("chart_bar", "SELECT o_orderpriority AS category, count(*) AS value FROM orders GROUP BY 1")
def _(spark, d):
    return charts.chart_bar(table(spark, d, "orders"), "o_orderpriority")


@query(
    "chart_bar_top",
    """SELECT p_name AS category, p_retailprice / nullif(p_size, 0) AS value FROM part
    ORDER BY value DESC NULLS LAST, category LIMIT 3""",
)
def _(spark, d):
    return charts.chart_bar_top(table(spark, d, "part"), "p_name", F.try_divide("p_retailprice", "p_size"), 3)


@query(
    "chart_pie",
    """WITH k AS (SELECT c_name AS category, c_acctbal AS value FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 10)
    SELECT category, value, round(value / (SELECT sum(value) FROM k), 6) AS share,
    value = (SELECT max(value) FROM k) AS is_max FROM k""",
)
def _(spark, d):
    return rounded(charts.chart_pie(table(spark, d, "customer"), "c_name", "c_acctbal", 10), 6, "share")


def _hist_sql(source: str, col: str, bins: int) -> str:
    return f"""
    SELECT b.bin, e.lo + b.bin * (e.hi - e.lo) / {bins} AS low,
           CASE WHEN b.bin = {bins - 1} THEN e.hi ELSE e.lo + (b.bin + 1) * (e.hi - e.lo) / {bins} END AS high,
           coalesce(c.n, 0) AS n
    FROM (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin) b
    CROSS JOIN (SELECT min({col}) AS lo, max({col}) AS hi FROM {source}) e
    LEFT JOIN (SELECT least(CAST(floor(({col} - lo) * {bins} / (hi - lo)) AS INTEGER), {bins - 1}) AS bin, count(*) AS n
               FROM {source}, (SELECT min({col}) AS lo, max({col}) AS hi FROM {source}) WHERE {col} IS NOT NULL GROUP BY 1) c ON b.bin = c.bin"""


@query("chart_hist", f"SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n FROM ({_hist_sql('orders', 'o_totalprice', 10)})")
def _(spark, d):
    return rounded(charts.chart_hist(table(spark, d, "orders"), "o_totalprice"), 6, "low", "high")


_BOX = """
  SELECT '{c}' AS "column", round(q1, 4) AS q1, round("median", 4) AS "median", round(q3, 4) AS q3,
         min({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
         max({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
         count(*) FILTER ({c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
  FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS "median", quantile_cont({c}, 0.75) AS q3 FROM {t})
  GROUP BY q1, "median", q3"""


@query("chart_box", _BOX.format(c="value", t="events"))
def _(spark, d):
    return rounded(charts.chart_box(table(spark, d, "events"), ["value"]), 4, "q1", "median", "q3")


@query("chart_box_columns", _BOX.format(c="l_extendedprice", t="lineitem") + " UNION ALL " + _BOX.format(c="l_quantity", t="lineitem"))
def _(spark, d):
    box = charts.chart_box(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])
    return rounded(box, 4, "q1", "median", "q3")


@query("chart_scatter", "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem")
def _(spark, d):
    return charts.chart_scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "chart_scatter_sample",
    f"SELECT o_custkey AS x, o_totalprice AS y FROM orders WHERE {hash_sql(7, 'o_orderkey')} % 1000000 < 100000",
)
def _(spark, d):
    return charts.chart_scatter(table(spark, d, "orders"), "o_custkey", "o_totalprice", 0.1, 7, ["o_orderkey"])


@query(
    "chart_trend",
    """SELECT l_quantity AS x, l_extendedprice AS y, round(s * l_quantity + i, 2) AS fitted FROM lineitem,
    (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)""",
)
def _(spark, d):
    return rounded(charts.chart_trend(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 2, "fitted")


_PAIR = ["o_totalprice", "o_custkey"]


@query(
    "chart_scatter_matrix",
    " UNION ALL ".join(
        [
            f"SELECT 'corr' AS kind, '{a}' AS column_a, '{b}' AS column_b, -1 AS bin, round(corr({a}, {b}), 6) AS value FROM orders"
            for a in _PAIR
            for b in _PAIR
        ]
        + [
            f"SELECT 'hist', '{a}', '{a}', bin, CAST(n AS DOUBLE) FROM ({_hist_sql('orders', a, 10)})"
            for a in _PAIR
        ]
    ),
)
def _(spark, d):
    return rounded(charts.chart_scatter_matrix(table(spark, d, "orders"), _PAIR), 6, "value")


@query(
    "bootstrap_stats",
    f"""WITH t AS (SELECT sample, place, min(turn) AS luck FROM
      (SELECT sample, turn, {hash_sql(0, 'sample', 'turn')} % (SELECT count(*) FROM orders) AS place
       FROM range(1, 101) a(sample), range(1, 151) b(turn)) GROUP BY sample, place),
    p AS (SELECT sample, place FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY luck, place) AS r FROM t) WHERE r <= 50),
    o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)
    SELECT sample, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round((min(v) + max(v)) / 2, 4) AS midrange
    FROM p JOIN o USING (place) GROUP BY sample""",
)
def _(spark, d):
    drawn = charts.bootstrap_stats(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"], samples=100)
    return rounded(drawn, 4, "mean", "median", "midrange")


@query(
    "chart_line_mean",
    """SELECT l_quantity AS x, count(*) AS n, round(avg(l_extendedprice), 3) AS mean,
    round(avg(l_extendedprice) - 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 3) AS low,
    round(avg(l_extendedprice) + 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 3) AS high FROM lineitem GROUP BY l_quantity""",
)
def _(spark, d):
    line = charts.chart_line_mean(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(line, 3, "mean", "low", "high")


# ---- missing numbers held as NaN ----

for _fn, _expr in {
    "max": "max(value)",
    "mean": "round(avg(value), 6)",
    "sum": "round(sum(value), 2)",
    "count": "count(value)",
    "std": "round(stddev_samp(value), 4)",
    "nunique": "count(DISTINCT value)",
}.items():

    @query(f"agg_{_fn}_nan", f"SELECT {_expr} AS value_{_fn} FROM {SPARSE_EVENTS}")
    def _(spark, d, fn=_fn):
        found = stats.column_stat(nan_events(spark, d), "value", fn)
        return rounded(found, {"mean": 6, "sum": 2, "std": 4}[fn], f"value_{fn}") if fn in ("mean", "sum", "std") else found


@query("agg_median_nan", f"SELECT round(median(value), 4) AS median FROM {SPARSE_EVENTS}")
def _(spark, d):
    return rounded(stats.median(nan_events(spark, d), "value"), 4, "median")


@query(
    "group_median_nan",
    f"""SELECT CASE WHEN k % 5 = 0 THEN 'none' ELSE event_type END AS kind, round(median(value), 4) AS median
    FROM {SPARSE_EVENTS} GROUP BY 1""",
)
def _(spark, d):
    kind = F.when(F.col("k") % 5 == 0, "none").otherwise(F.col("event_type"))
    return rounded(stats.median(nan_events(spark, d).withColumn("kind", kind), "value", ["kind"]), 4, "median")


@query("corr_pair_nan", f"SELECT round(corr(value, k), 6) AS corr FROM {SPARSE_EVENTS}")
def _(spark, d):
    return rounded(stats.corr(nan_events(spark, d), "value", "k"), 6, "corr")


@query(
    "trend_line_nan",
    f"""SELECT round(regr_slope(value, k), 6) AS slope, round(regr_intercept(value, k), 6) AS intercept,
    round(regr_r2(value, k), 6) AS r2 FROM {SPARSE_EVENTS}""",
)
def _(spark, d):
    return rounded(stats.trend_line(nan_events(spark, d), "value", "k"), 6, "slope", "intercept", "r2")


@query("chart_hist_nan", f"SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n FROM ({_hist_sql(SPARSE_EVENTS, 'value', 10)})")
def _(spark, d):
    return rounded(charts.chart_hist(nan_events(spark, d), "value"), 6, "low", "high")


@query("chart_box_nan", _BOX.format(c="value", t=SPARSE_EVENTS))
def _(spark, d):
    return rounded(charts.chart_box(nan_events(spark, d), ["value"]), 4, "q1", "median", "q3")


# ---- missing numbers as NaN in windows and points; many lags ----

_SPARSE_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query(
    "rolling_mean_nan",
    f"""SELECT event_id, CASE WHEN count(value) OVER w = 3 THEN round(avg(value) OVER w, 6) END AS rolling_mean
    FROM {SPARSE_EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    out = timeseries.rolling_mean(nan_events(spark, d), "value", 3, ["ts", "event_id"], ["user_id"])
    return rounded(out, 6, "rolling_mean").select("event_id", "rolling_mean")


@query("pct_change_nan", f"SELECT event_id, round(value / nullif(lag(value, 1) {_SPARSE_W}, 0) - 1, 9) AS pct_change FROM {SPARSE_EVENTS}")
def _(spark, d):
    out = timeseries.pct_change(nan_events(spark, d), "value", ["ts", "event_id"], ["user_id"])
    return rounded(out, 9, "pct_change").select("event_id", "pct_change")


@query(
    "lag_pairs_nan",
    f"""SELECT event_id, y, y_lagged FROM (SELECT event_id, value AS y, lead(value, 2) OVER w AS y_lagged, lead(1, 2) OVER w AS has
    FROM {SPARSE_EVENTS} WINDOW w AS (ORDER BY ts, event_id)) WHERE has IS NOT NULL""",
)
def _(spark, d):
    return timeseries.lag_pairs(nan_events(spark, d), "value", 2, ["ts", "event_id"]).select("event_id", "y", "y_lagged")


@query(
    "chart_trend_nan",
    f"""WITH e AS {SPARSE_EVENTS} SELECT event_id AS x, value AS y, round(s * event_id + i, 4) AS fitted FROM e,
    (SELECT regr_slope(value, event_id) AS s, regr_intercept(value, event_id) AS i FROM e)""",
)
def _(spark, d):
    return rounded(charts.chart_trend(nan_events(spark, d), "event_id", "value"), 4, "fitted")


@query("chart_scatter_nan", f"SELECT event_id AS x, value AS y FROM {SPARSE_EVENTS}")
def _(spark, d):
    return charts.chart_scatter(nan_events(spark, d), "event_id", "value")


def _lags_sql(source: str, most: int) -> str:
    return f"""WITH v AS (SELECT value - (SELECT avg(value) FROM {source}) AS y, row_number() OVER (ORDER BY ts, event_id) AS i FROM {source} WHERE value IS NOT NULL)
    SELECT CAST(k AS INTEGER) AS lag, round((SELECT sum(a.y * b.y) FROM v a JOIN v b ON a.i = b.i + k) / (SELECT sum(y * y) FROM v), 6) AS r
    FROM range(1, {most + 1}) t(k)"""


@query("autocorrelation_nan", _lags_sql(SPARSE_EVENTS, 4))
def _(spark, d):
    return rounded(timeseries.autocorrelation(nan_events(spark, d), "value", 4, ["ts", "event_id"]), 6, "r")


@query("autocorrelation_wide", _lags_sql(SPARSE_EVENTS, 500))
def _(spark, d):
    return rounded(timeseries.autocorrelation(nan_events(spark, d), "value", 500, ["ts", "event_id"]), 6, "r")


_FOUR = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]


@query("chart_box_many", " UNION ALL ".join(_BOX.format(c=c, t="lineitem") for c in _FOUR))
def _(spark, d):
    return rounded(charts.chart_box(table(spark, d, "lineitem"), _FOUR), 4, "q1", "median", "q3")
