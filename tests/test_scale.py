"""Same rows whatever the partitioning and skew; plans without single-task steps."""

import os
import subprocess
import sys

import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from sheetwise.functions import text
from sheetwise.operators import charts, hooks, joins, ordering, scale, stats, timeseries
from sheetwise.operators.quantiles import exact_quantiles
from sheetwise.plans.catalog import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(small):
    """Events of which about a half belong to one user; some have none."""
    user = F.when(F.col("event_id") % 2 == 0, 1).when(F.col("event_id") % 11 == 0, None).otherwise(F.col("user_id"))
    return small("events").select("event_id", "ts", user.cast("long").alias("user_id"), "value")


def test_row_index_is_dense_and_independent_of_partitions(small):
    base = small("orders").select("o_orderkey", "o_totalprice")
    one = rows_of(scale.row_index(base.coalesce(1), ["o_totalprice", "o_orderkey"]))
    many = rows_of(scale.row_index(base.repartition(8), ["o_totalprice", "o_orderkey"]))
    assert one == many
    assert sorted(r[2] for r in one) == list(range(1500))
    order = sorted(one, key=lambda r: r[2])
    assert order == sorted(one, key=lambda r: (r[1], r[0]))


def test_row_index_of_nothing(spark):
    assert scale.row_index(spark.createDataFrame([], "a int"), ["a"]).collect() == []


@pytest.mark.parametrize("block_rows", [1, 7, 100, 10_000])
def test_hot_groups_give_the_same_windows(skewed, block_rows):
    order, by = ["ts", "event_id"], ["user_id"]
    small_groups = {"group_rows": 20, "block_rows": block_rows}
    plain = timeseries.rolling_mean(skewed, "value", 3, order, by)
    blocks = timeseries.rolling_mean(skewed, "value", 3, order, by, **small_groups)
    assert rows_of(blocks) == rows_of(plain)
    for periods in (1, -2, 5):
        plain = timeseries.shift(skewed, "value", periods, order, by)
        assert rows_of(timeseries.shift(skewed, "value", periods, order, by, **small_groups)) == rows_of(plain)
    plain = timeseries.pct_change(skewed, "value", order, by)
    assert rows_of(timeseries.pct_change(skewed, "value", order, by, **small_groups)) == rows_of(plain)


def test_ungrouped_blocks_equal_one_window(skewed):
    values = [r["value"] for r in skewed.orderBy("ts", "event_id").collect()]
    out = timeseries.shift(skewed, "value", 3, ["ts", "event_id"], block_rows=50).orderBy("ts", "event_id").collect()
    assert [r["shifted"] for r in out] == [None] * 3 + values[:-3]


def test_missing_group_keys_have_no_group(skewed):
    out = timeseries.shift(skewed, "value", 1, ["ts", "event_id"], ["user_id"])
    assert out.count() == skewed.filter("user_id is not null").count()


def test_decomposition_does_not_depend_on_blocks(small):
    a = timeseries.seasonal_decompose(small("events"), "ts", "h", "value", 24)
    b = timeseries.seasonal_decompose(small("events"), "ts", "h", "value", 24, block_rows=13)
    pick = [F.round(c, 9).alias(c) for c in ("observed", "trend", "seasonal", "resid")]
    assert rows_of(a.select("bin_index", *pick)) == rows_of(b.select("bin_index", *pick))


@pytest.mark.parametrize("by", [[], ["p"], ["p", "o_orderstatus"]])
def test_narrowed_quantiles_are_exact(small, by):
    orders = small("orders").withColumn("p", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")))
    args = (orders, "o_totalprice", [0.0, 0.1, 0.5, 0.77, 1.0], ["a", "b", "c", "d", "e"], by)
    digits = [*by, *[F.round(n, 6).alias(n) for n in "abcde"]]
    assert rows_of(exact_quantiles(*args).select(digits)) == rows_of(exact_quantiles(*args, group_rows=5).select(digits))


def test_narrowed_quantiles_with_repeats_and_outliers(spark):
    values = [1.0] * 500 + [2.0] * 400 + [1e300, -1e300, 3.5, float("nan"), None]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    for by in ([], ["g"]):
        for q in (0.0, 0.3, 0.5, 0.552, 0.9, 1.0):
            full = exact_quantiles(df, "v", [q], ["q"], by).collect()[0]["q"]
            assert exact_quantiles(df, "v", [q], ["q"], by, group_rows=10).collect()[0]["q"] == full


def test_split_is_exact_disjoint_and_repeatable(small):
    orders = small("orders").select("o_orderkey", "o_totalprice")
    train, validation = ordering.split_train_validation(orders, 0.05, 1337, ["o_orderkey"])
    assert (validation.count(), train.count()) == (75, 1425)
    assert validation.join(train, "o_orderkey").count() == 0
    again = ordering.split_train_validation(orders.repartition(8), 0.05, 1337, ["o_orderkey"])[1]
    assert rows_of(again) == rows_of(validation)
    other = ordering.split_train_validation(orders, 0.05, 1, ["o_orderkey"])[1]
    assert rows_of(other) != rows_of(validation)
    assert ordering.split_train_validation(orders, 0.0, 1, ["o_orderkey"])[1].count() == 0
    assert ordering.split_train_validation(orders, 1.0, 1, ["o_orderkey"])[0].count() == 0


def test_shuffle_is_repeatable(small):
    orders = small("orders").select("o_orderkey")
    first = [r[0] for r in ordering.seeded_shuffle(orders, 228, ["o_orderkey"]).collect()]
    again = [r[0] for r in ordering.seeded_shuffle(orders.repartition(7), 228, ["o_orderkey"]).collect()]
    assert first == again and first != sorted(first)
    assert [r[0] for r in ordering.select_first(orders, 20, 228, ["o_orderkey"]).collect()] == first[:20]


def test_bootstrap_does_not_depend_on_partitions(small):
    orders = small("orders")
    a = charts.bootstrap_stats(orders, "o_totalprice", ["o_orderkey"], samples=20)
    b = charts.bootstrap_stats(orders.repartition(8), "o_totalprice", ["o_orderkey"], samples=20)
    assert rows_of(a) == rows_of(b)


@pytest.mark.parametrize("match_nulls", [False, True])
def test_salted_merge_equals_plain(spark, match_nulls):
    left = spark.range(300).selectExpr("if(id % 3 = 0, 1, if(id % 50 = 0, null, id)) as k", "id as a")
    right = spark.range(200).selectExpr("if(id = 77, null, id) as k", "id as b")
    plain = joins.merge(left, right, ["k"], match_nulls)
    salted = joins.merge(left, right, ["k"], match_nulls, salts=4, hot_rows=3)
    assert rows_of(salted) == rows_of(plain)


def test_hot_keys(skewed):
    assert [r[0] for r in scale.hot_keys(skewed, ["user_id"], 100).collect()] == [1]
    assert scale.hot_keys(skewed, ["user_id"], 10_000) is None


def test_solve_groups_takes_batches(skewed):
    from sheetwise.plans.questions import solve

    schema = "user_id long, n long, best double"
    got = hooks.solve_groups(skewed, "user_id", solve, schema)
    own = hooks.solve_groups(skewed, "user_id", None, schema, lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("best")))
    assert rows_of(got) == rows_of(own)


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_the_drivers_time_zone_does_not_matter(zone):
    code = """
import sys; sys.path.insert(0, %r)
from sheetwise.session import local_session
from __spark_entry__ import queries
from sheetwise.operators.scale import first_rows
spark = local_session(2)
d = "/root/testdata/sf0.001"
events = spark.read.parquet(d + "/events.parquet")
print(first_rows(events, 10, ["ts"]).count(), events.count())
for name in ("head_n", "resample_day", "seasonal_decompose"):
    df = queries()[name](spark, d)
    print(name, df.selectExpr("count(*)", "bit_xor(xxhash64(" + ",".join(f"cast(`{c}` as string)" for c in sorted(df.columns)) + "))").first())
""" % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = [subprocess.run([sys.executable, "-c", code], env=os.environ | {"TZ": z}, capture_output=True, text=True, timeout=250).stdout for z in ("UTC", zone)]
    assert said[0].startswith("10 ") and said[0] == said[1]


def test_small_side_hint_depends_on_size(spark):
    few = spark.range(5)
    assert scale.is_small(few, 5) and not scale.is_small(few, 4)


TEXT_QUERIES = [
    "norm_sep", "cut_end", "fenced_blocks", "dedent", "strip_reload", "protect_df", "drop_show", "comment_forbidden",
    "extract_code", "wrap_code", "filter_traceback", "number_errors", "strip_inst", "assemble_infill",
    "repair_completion", "body_after_solve", "strip_quotes", "escape_repr", "method_name", "plot_path", "parse_score",
    "indent_block", "trim_tail", "tag_queries", "format_training", "model_wrap", "render_prompts",
]


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_text_work_stays_in_the_jvm(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert not [w for w in ("EvalPython", "InPandas", "InArrow", "PythonUDF") if w in plan]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_or_whole_table_windows(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for line in plan.split("\n"):
        if "Window [" in line:
            assert ", [], [" not in line, line


def test_filters_and_columns_reach_the_scan(small):
    df = stats.mean_and_members(small("customer"), F.col("c_acctbal") > 9000, "c_acctbal", "c_name")
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(c_acctbal,9000.0)" in plan
    assert "c_mktsegment" not in plan.split("== Physical Plan ==")[1]


def test_chained_text_functions_use_their_input_once(spark):
    df = spark.range(1).select(text.extract_code(F.concat(F.lit("x"), F.col("id").cast("string")), "local").alias("c"))
    assert plan_of(df).count("cast(id#") <= 1


def test_first_rows(spark):
    rows = [(3, "c"), (1, "b"), (None, "n"), (1, "a"), (2, "d")]
    df = spark.createDataFrame(rows, "i int, s string")
    for n in range(7):
        expected = [tuple(r) for r in df.orderBy("i", "s").collect()][:n]
        assert [tuple(r) for r in scale.first_rows(df, n, ["i", "s"]).collect()] == expected
    assert [r["i"] for r in scale.first_rows(df, 2, [F.col("i").desc()]).collect()] == [3, 2]


def test_head_filter_reaches_the_scan(small):
    plan = scale.first_rows(small("orders"), 3, ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(o_orderkey" in plan


def test_missing_keys(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "k double")
    assert rows_of(scale.with_keys(df, ["k"])) == [(1.0,)]
