"""Known answers on the eleven-country table and other small cases."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sheetwise.operators import charts, cleaning, evaluate, joins, ordering, reshape, setops, stats, timeseries
from sheetwise.operators.profile import head_text, profile_table


def one(df):
    return df.collect()[0][0]


def test_correlation(gdp):
    assert one(stats.corr(gdp, "gdp", "happiness_index")) == pytest.approx(0.4002281936887687)


def test_minimum(gdp):
    assert one(stats.column_stat(gdp, "happiness_index", "min")) == 0


def test_median_and_std(gdp):
    assert one(stats.median(gdp, "gdp")) == 2411255037952.0
    assert one(stats.median(gdp, "gdp", approx=True)) == 2411255037952
    assert one(stats.column_stat(gdp, "gdp", "std")) == pytest.approx(6202755212565.886)


def test_mean_and_members(gdp):
    rows = rows_of(stats.mean_and_members(gdp, F.col("happiness_index") > 5.5, "gdp", "country"))
    assert [r[0] for r in rows] == ["Australia", "Canada", "China", "France"]
    assert {r[1] for r in rows} == {5035367366656.0}


def test_summary(gdp):
    found = {(r["column"], r["stat"]): r["value"] for r in stats.summary(gdp, ["gdp", "happiness_index"]).collect()}
    assert found["gdp", "max"] == 19294482071552
    assert found["gdp", "min"] == 3
    assert found["gdp", "mean"] == pytest.approx(4824616355281.728)
    assert found["happiness_index", "mean"] == pytest.approx(6.909090909090909)


def test_best_ratio_after_filter(gdp):
    rich = gdp.filter("gdp >= 4380756541439")
    best = stats.best_by(rich, F.try_divide("gdp", "happiness_index"), ["country"]).collect()[0]
    assert (best["country"], best["score"]) == ("United States", 9647241035776.0)


def test_ratio_with_zero_is_missing(gdp):
    rows = {r["country"]: r["r"] for r in cleaning.ratio_column(gdp, "gdp", "happiness_index", "r").collect()}
    assert rows["Russia"] is None
    assert rows["Japan"] == 876151308288.0


def test_top_and_bottom(gdp):
    assert [tuple(r) for r in ordering.top_k(gdp, "gdp", 3, ["country"], ["country", "gdp"]).collect()] == [
        ("United States", 19294482071552),
        ("China", 14631844184064),
        ("Japan", 4380756541440),
    ]
    low = ordering.bottom_k(gdp, "happiness_index", 5, ["country"], ["country"]).collect()
    assert [r[0] for r in low] == ["Russia", "United Kingdom", "United States", "Germany", "Italy"]


def test_top_ratio(gdp):
    rows = ordering.top_k_ratio(gdp, "gdp", "happiness_index", 2, ["country"], ["country"]).collect()
    assert [r["country"] for r in rows] == ["United States", "United Kingdom"]


def test_trend(gdp):
    line = stats.trend_line(gdp, "gdp", "happiness_index").collect()[0]
    assert line["slope"] == pytest.approx(298663305664.3742)
    assert line["intercept"] == pytest.approx(2761124425236.959)
    fitted = {r["x"]: r["fitted"] for r in charts.chart_trend(gdp, "happiness_index", "gdp").collect()}
    assert fitted[0] == pytest.approx(2761124425236.959)


def test_pie(gdp):
    rows = charts.chart_pie(gdp, "country", "gdp", 3).collect()
    assert sum(r["share"] for r in rows) == pytest.approx(1)
    assert [r["category"] for r in rows if r["is_max"]] == ["United States"]


def test_box_of_values_with_outlier(gdp):
    row = charts.chart_box(gdp, ["happiness_index"]).collect()[0]
    assert (row["q1"], row["median"], row["q3"]) == (2.5, 4.0, 8.5)
    assert (row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (0.0, 10.0, 1)


def test_hist_keeps_empty_bins_and_last_value(gdp):
    rows = charts.chart_hist(gdp, "happiness_index", 3).orderBy("bin").collect()
    assert [(r["low"], r["high"], r["n"]) for r in rows] == [(0.0, 10.0, 9), (10.0, 20.0, 1), (20.0, 30.0, 1)]


def test_hist_of_one_value(spark):
    rows = charts.chart_hist(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v", 2).orderBy("bin").collect()
    assert [(r["low"], r["high"], r["n"]) for r in rows] == [(4.5, 5.0, 0), (5.0, 5.5, 2)]


def test_value_counts_skip_missing(spark):
    df = spark.createDataFrame([("UCLA",), ("UCLA",), ("none",), (None,)], "college string")
    assert rows_of(stats.value_counts(df, "college")) == [("UCLA", 2), ("none", 1)]


def test_profile(spark):
    df = spark.createDataFrame([(1, 4, 7), (2, 5, 8), (3, 6, 9)], "A long, B long, C long")
    rows = profile_table(df, "t", 2, ["A"]).orderBy("position").collect()
    assert [(r["column_name"], r["sample_values"]) for r in rows] == [("A", ["1", "2"]), ("B", ["4", "5"]), ("C", ["7", "8"])]
    assert [r["sample_values"] for r in profile_table(df, "t", 0, ["A"]).collect()] == [None] * 3
    assert profile_table(df, "t", 0, ["A"], describe=False).count() == 0
    with pytest.raises(ValueError):
        profile_table(df, "t", 1, ["A"], describe=False)
    assert one(head_text(df, 2, ["A"])) == "A | B | C\n1 | 4 | 7\n2 | 5 | 8"
    assert one(head_text(df, 0, ["A"])) == ""


def test_merge_of_missing_keys_and_shared_names(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, v string")
    assert rows_of(joins.merge(a, b, ["k"])) == [(1, "x", "p")]
    assert rows_of(joins.merge(a, b, ["k"], match_nulls=True)) == [(1, "x", "p"), (None, "y", "q")]
    assert joins.merge(a, b, ["k"]).columns == ["k", "v_x", "v_y"]


def test_pair_answers_strict(spark):
    correct = spark.createDataFrame([(1, "general", "5"), (2, "general", "6")], "query_id long, tagged_query_type string, result_repl_stdout string")
    agent = spark.createDataFrame([(1, "5")], "query_id long, result_repl_stdout string")
    assert rows_of(joins.pair_answers(correct, agent), "query_id", "answer") == [(1, "5"), (2, None)]
    with pytest.raises(KeyError):
        joins.pair_answers(correct, agent, strict=True)
    assert tuple(evaluate.score_exact(joins.pair_answers(correct, agent)).first()) == (2, 0.5)
    assert tuple(evaluate.score_exact(joins.pair_answers(correct.limit(0), agent)).first()) == (0, None)


def test_overlay_keeps_old_cells_and_adds_columns(spark):
    sheet = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, plan string")
    details = spark.createDataFrame([(1, None, "c1")], "query_id long, plan string, code string")
    assert rows_of(joins.overlay_details(sheet, details)) == [(1, "a", "c1"), (2, "b", None)]


def test_group_keys_that_are_missing_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", None)], "k string, v double")
    assert rows_of(stats.group_stat(df, ["k"], ["v"], "sum")) == [("a", 1.0)]
    with pytest.raises(ValueError):
        stats.group_stat(df, ["k"], ["v"], "mode")


def test_group_members_are_whole(spark):
    df = spark.range(100).selectExpr("cast(1 as int) as k", "id")
    rows = stats.group_members(df, "k", "id", chunk=30).orderBy("chunk").collect()
    assert [len(r["members"]) for r in rows] == [30, 30, 30, 10]
    assert [m for r in rows for m in r["members"]] == list(range(100))
    with pytest.raises(ValueError):
        stats.group_members(df.selectExpr("k", "cast(id as string) id"), "k", "id")


def test_fill_and_drop_treat_nan_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.5)], "i int, v double")
    assert rows_of(cleaning.drop_missing(df)) == [(3, 1.5)]
    assert rows_of(cleaning.fill_missing(df, 0.0)) == [(1, 0.0), (2, 0.0), (3, 1.5)]


def test_blank_nan(spark):
    df = spark.createDataFrame([("NaN",), ("nan",), ("nano",), (None,)], "s string")
    assert rows_of(cleaning.blank_nan_text(df)) == [("",), ("",), ("nano",), (None,)]


def test_sort_puts_missing_last_both_ways(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    assert [r[0] for r in ordering.sort_by(df, ["v"]).collect()] == [1, 2, None]
    assert [r[0] for r in ordering.sort_by(df, ["v"], False).collect()] == [2, 1, None]


def test_reshape(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("b", "y", 5.0), ("b", None, 7.0)], "i string, c string, v double")
    assert rows_of(reshape.pivot_table(df, ["i"], "c", "v")) == [("a", 2.0, None), ("b", None, 5.0)]
    assert rows_of(reshape.crosstab(df, "i", "c")) == [("a", 2, 0), ("b", 0, 1)]
    dummies = reshape.get_dummies(df.select("i", "c"), "c", as_int=True)
    assert dummies.columns == ["i", "c_x", "c_y"]
    assert rows_of(dummies) == [("a", 1, 0), ("a", 1, 0), ("b", 0, 0), ("b", 0, 1)]
    long = reshape.pivot_long(df, ["i"], "c", "v")
    assert rows_of(long) == [("a", "x", 2.0), ("b", "y", 5.0)]


def test_frame_diff_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    b = spark.createDataFrame([(1,), (3,)], "v int")
    assert rows_of(setops.frame_diff(a, b)) == [(1, "left", 1), (2, "left", 1), (3, "right", 1)]
    setops.assert_frame_equal(a, a)
    with pytest.raises(AssertionError):
        setops.assert_frame_equal(a, b)
    with pytest.raises(AssertionError):
        setops.assert_frame_equal(a, a.selectExpr("cast(v as long) v"))
    setops.assert_frame_equal(a, a.selectExpr("cast(v as long) v"), check_types=False)


def test_rolling_needs_full_windows_of_present_values(spark):
    df = spark.createDataFrame([(i, None if i == 4 else float(i)) for i in range(8)], "t int, v double")
    out = {r["t"]: r["rolling_mean"] for r in timeseries.rolling_mean(df, "v", 3, ["t"]).collect()}
    assert out == {0: None, 1: None, 2: 1.0, 3: 2.0, 4: None, 5: None, 6: None, 7: 6.0}


def test_resample_fills_the_calendar(spark):
    df = spark.sql("select timestamp_ntz'2024-01-30 10:00:00' ts, 1.0D v union all select timestamp_ntz'2024-02-02 01:00:00', 3.0D")
    days = timeseries.resample(df, "ts", "D", "v").orderBy("bin_index").collect()
    assert [r["value"] for r in days] == [1.0, None, None, 3.0]
    assert [r["value"] for r in timeseries.resample(df, "ts", "D", "v", "sum").orderBy("bin").collect()] == [1.0, 0.0, 0.0, 3.0]
    months = timeseries.resample(df, "ts", "MS", "v").orderBy("bin").collect()
    assert [(str(r["bin"]), r["value"]) for r in months] == [("2024-01-01 00:00:00", 1.0), ("2024-02-01 00:00:00", 3.0)]
    with pytest.raises(ValueError):
        timeseries.resample(df, "ts", "fortnight", "v")
    assert timeseries.resample(df.limit(0), "ts", "D", "v").count() == 0


def test_decomposition_finds_a_known_season(spark):
    pattern = [3.0, -1.0, -2.0]
    rows = [(i, 10.0 + i + pattern[i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, v double").selectExpr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,i) as ts", "v")
    out = timeseries.seasonal_decompose(df, "ts", "D", "v", 3).orderBy("bin_index").collect()
    assert out[0]["trend"] is None and out[-1]["trend"] is None
    assert [round(r["seasonal"], 9) for r in out[:3]] == pattern
    assert all(abs(r["resid"]) < 1e-9 for r in out[1:-1])
    assert out[5]["trend"] == pytest.approx(15.0)


def test_autocorrelation_of_an_alternating_series(spark):
    df = spark.createDataFrame([(i, float((-1) ** i)) for i in range(10)], "t int, v double")
    r = {x["lag"]: x["r"] for x in timeseries.autocorrelation(df, "v", 2, ["t"]).collect()}
    assert r[1] == pytest.approx(-0.9) and r[2] == pytest.approx(0.8)


def test_to_datetime_bad_text(spark):
    df = spark.createDataFrame([("2024-01-05",), ("soon",)], "d string")
    assert [str(r[0]) for r in timeseries.to_datetime(df, "d").collect()] == ["2024-01-05 00:00:00", "None"]


def test_bootstrap_bounds(gdp):
    out = charts.bootstrap_stats(gdp, "happiness_index", ["country"], size=5, samples=40, seed=3)
    rows = out.collect()
    assert len(rows) == 40
    assert all(0 <= r["mean"] <= 30 and 0 <= r["median"] <= 30 and 0 <= r["midrange"] <= 30 for r in rows)
    assert len({r["mean"] for r in rows}) > 5
    full = charts.bootstrap_stats(gdp, "happiness_index", ["country"], size=11, samples=3).collect()
    assert {r["mean"] for r in full} == {76 / 11}


TABLE = """       Faculty Name Academic Year  Number of Students
0        Electrical     2022-2023                1588
1  Computer Science     2022-2023                1513
2        Mechanical     2022-2023                1965
"""
DATES = "0   2023-02-19\n1   2023-03-11\n8   2023-03-31\nName: Last restock date, dtype: datetime64[ns]\n"
ROCK = "    Location ID Rock Type  Depth  Density\n10           11   Granite  451.0   11.5  1337.8\n"


@pytest.mark.parametrize(
    "correct, answer, score",
    [
        ("228.0", "The maximal weight is 228", 1),
        (TABLE, "[1588, 1513, 1965]", 1),
        ("[2023-03-11, 2023-03-31, 2023-02-19]", DATES, 1),
        ("CGATCGCCGT", "TGCTTACGGA", 0),
        ("0.85", "0.8494521", 1),
        ("341.0", ROCK, 0),
        ("0.85", "0.87", 0),
        ("[1, 2]", "2 and then 1", 1),
        ("[1, 2]", "1", 0),
        ("yes", " Yes, it is", 1),
        ("yes", None, 0),
        (TABLE, "[1588, 7]", 0),
    ],
)
def test_tolerant_scoring(spark, correct, answer, score):
    row = spark.createDataFrame([(correct, answer)], "c string, a string")
    assert row.select(evaluate.tolerant_match("c", "a")).first()[0] == score


PLOTS = [
    "Find top 10 largest charging cycles and pieplot them. Add values. Use red color for the biggest one. Title it 'Ch. Cycles'.",
    "Plot happiness_index values",
    "Create a pie plot of the top 5 minimal values in the happiness index column in shades of blue.",
    "Pie plot top 11 accelerations",
    "Pie plot 3 largest gdps. Title it 'GDP'.",
    "Create a barplot of the 3 largest values in the Energy Throughput divided by DoD columns.",
    "Approximate the gdp to happiness index trend with a line and plot it.",
]
GENERAL = [
    "What is the maximum Temperature?",
    "the correlation between current and voltage",
    "minimal value of rate of happy",
    "Find the correlation between gdp and happiness index.",
    "I want to know the average gdp of countries that have happiness index greater than 5.5. I also need these countries.",
    "Can you do statistics about happiness index and gdp relationship? like their max, min and mean",
    "filter out the countries with gdp less than 4380756541439 and find the best country in terms of gdp relative to the happy",
    "What are 3 best accelerations relative to the length of charging cycles?",
    "print the whole dataframe",
    "average depth in the 'Plot' column",
]


def test_tagging(spark):
    rows = [(q, t) for t, qs in (("plot", PLOTS), ("general", GENERAL)) for q in qs]
    df = spark.createDataFrame(rows, "user_query string, known string")
    tagged = evaluate.tag_queries(df).withColumn("has_plot_answer", F.col("known") == "plot")
    assert [r["user_query"] for r in tagged.filter("known <> tagged_query_type").collect()] == []
    assert tuple(evaluate.tagging_accuracy(tagged).first()) == (17, 1.0, 1.0, 1.0)
    assert evaluate.tag_queries(df, fixed="plot").filter("tagged_query_type <> 'plot'").count() == 0
    with pytest.raises(ValueError):
        evaluate.tag_queries(df, fixed="map")
    with pytest.raises(ValueError):
        evaluate.tag_queries(df, tagger="other")


def test_executable_rate_counts_crashes(spark):
    rows = [(1, "true", True), (2, "true", None), (3, "false", False)]
    df = spark.createDataFrame(rows, "query_id long, text2analysis string, successful_code_execution boolean")
    found = {r["cohort"]: tuple(r)[1:] for r in evaluate.executable_rate(df, "text2analysis", ["true", "false", "none"]).collect()}
    assert found == {"true": (2, 1, 0.5), "false": (1, 0, 0.0), "none": (0, 0, 0.0)}
    found = evaluate.executable_rate(df, "text2analysis", ["true"], exclude_crashed=True).collect()
    assert tuple(found[0]) == ("true", 1, 1, 1.0)


def test_reuse_plans_flags_half_a_plan(spark):
    sheet = spark.createDataFrame([(1,), (2,)], "query_id long")
    former = spark.createDataFrame(
        [(1, "p", "plot", None, "a.png"), (2, "p", None, None, None)],
        "query_id long, plan string, tagged_query_type string, prompt_user_for_planner string, plot_filename string",
    )
    assert [r["error"] is None for r in evaluate.reuse_plans(sheet, former).orderBy("query_id").collect()] == [True, False]


@pytest.mark.parametrize(
    "correct, given, score",
    [("1000000", "1e6", 1), ("1234.5", "1,234.5", 1), ("-3", "5-3", 0), ("[1, 1, 2]", "[1, 2, 2]", 0), ("[2, 1, 2]", "[1, 2, 2]", 1)],
)
def test_numbers_are_read_as_printed(spark, correct, given, score):
    df = spark.createDataFrame([(correct, given)], "a string, b string")
    assert df.select(evaluate.tolerant_match("a", "b")).first()[0] == score


def test_drawing_words(spark):
    asked = ["Draw a histogram of age", "make a figure", "scatter of a vs b", "a diagram please", "mean of 'Figure'"]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert [r[0] for r in df.select(evaluate.tag_question("q")).collect()] == ["plot"] * 4 + ["general"]


def test_first_and_last_follow_an_order(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, float("nan")), (4, 7.0), (5, None)], "k int, v double")
    assert tuple(stats.multi_agg(df, {"v": ["first", "last"]}, order=["k"]).first()) == (5.0, 7.0)
    with pytest.raises(ValueError):
        stats.multi_agg(df, {"v": ["first"]})


def test_group_median_keeps_groups_without_a_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", None), (None, 2.0)], "g string, v double")
    assert rows_of(stats.median(df, "v", ["g"])) == [("a", 1.0), ("b", None)]
