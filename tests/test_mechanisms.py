"""Numbering by ranges, two-scan quantiles, scoring from rows, frequent keys, repeated keys and many lags."""

import itertools
import json
import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from __spark_entry__ import queries
from sheetwise.operators import charts, corpus, joins, reshape, row_scores, scale, setops, timeseries
from sheetwise.operators.quantiles import column_quantiles

# ---- numbering ----


@pytest.fixture(scope="module")
def skewed(spark):
    """Leading keys: a third missing, a third alike; NaN, both zeros and infinities among the second ones."""
    odd = [None, float("nan"), 0.0, -0.0, float("inf"), float("-inf")]
    rows = [(None if i % 3 == 0 else (7 if i % 3 == 1 else i), odd[i % 6] if i % 5 == 0 else i / 7, f"k{i:05d}") for i in range(3000)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "a long, b double, c string").repartition(7)


@pytest.mark.parametrize("part_rows", [10_000, 400, 17])
def test_row_index_over_ranges(spark, skewed, part_rows):
    got = scale.row_index(skewed, ["a", "b", "c"], part_rows=part_rows)
    rows = [tuple(r) for r in got.orderBy("row_index").collect()]
    assert [r[3] for r in rows] == list(range(3000))
    wanted = [tuple(r) for r in skewed.orderBy("a", "b", "c").collect()]
    assert [r[2] for r in rows] == [w[2] for w in wanted]


def test_row_index_writes_nothing_and_spreads_a_common_key(spark, skewed, monkeypatch):
    monkeypatch.setattr(scale, "settle", lambda df: pytest.fail("rows were written"))
    assert scale.row_index(skewed, ["a", "c"], part_rows=100).count() == 3000
    sizes = [r["count"] for r in skewed.groupBy(scale.range_part(skewed, ["a", "c"], part_rows=100)).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400


def test_row_index_of_odd_tables(spark):
    assert scale.row_index(spark.range(0), ["id"], part_rows=1).count() == 0
    same = spark.range(50).select(F.lit(1).alias("x"), "id")
    assert sorted(r["row_index"] for r in scale.row_index(same, ["x"], part_rows=5).collect()) == list(range(50))
    times = spark.range(40).selectExpr("timestamp_ntz'2024-03-31 00:30:00' + make_dt_interval(0, 0, id) AS t", "timestamp_micros(id) AS u", "date_add(date'2024-01-01', int(id)) AS d", "id")
    for c in ("t", "u", "d"):
        assert all(r["id"] == r["row_index"] for r in scale.row_index(times, [c], part_rows=6).collect())


def test_ranks_within_common_and_missing_keys(spark, skewed):
    calm = rows_of(scale.rank_in_group(skewed, ["a"], ["c"], "r"), "c", "r")
    assert calm == rows_of(scale.rank_in_group(skewed, ["a"], ["c"], "r", group_rows=10), "c", "r")


# ---- quantiles ----


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_of_many_columns(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    data = {"a": rng.normal(size=5000), "b": rng.integers(0, 3, 5000).astype(float), "c": np.exp(rng.normal(size=5000) * 9), "d": np.full(5000, 2.5)}
    data["c"][::4] = np.nan
    rows = [tuple(float(data[c][i]) for c in "abcd") + (None,) for i in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = column_quantiles(df, list("abcde"), probs, accuracy=accuracy)
    assert got["e"] is None
    for c in "abcd":
        assert got[c] == pytest.approx(np.quantile(data[c][~np.isnan(data[c])], probs), rel=1e-12)
    assert column_quantiles(df, ["a", "c"], probs, accuracy=accuracy, inside_rows=3)["c"] == got["c"]


@pytest.mark.parametrize("columns", [1, 6])
def test_quantiles_take_two_scans_whatever_the_columns(spark, columns):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(50_000).select(*[(F.xxhash64("id", F.lit(i)) % 10_000).alias(f"c{i}") for i in range(columns)])
    df = df.mapInArrow(seen, df.schema)
    column_quantiles(df, df.columns, [0.25, 0.5, 0.75], accuracy=100)
    assert read.value == 2 * 50_000


def test_box_of_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (float("nan"), None)], "a double, b double")
    assert [r["column"] for r in charts.chart_box(df, ["a", "b"]).collect()] == ["a"]
    with pytest.raises(ValueError):
        charts.chart_box(df, ["b"])


# ---- answers from rows ----


def best_matching(need, have, eps):
    """Whether every needed number finds one of its own: augmenting paths."""
    taken = {}

    def find(i, seen):
        for j, h in enumerate(have):
            if abs(need[i] - h) <= eps + 1e-9 and j not in seen:
                seen.add(j)
                if j not in taken or find(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return all(find(i, set()) for i in range(len(need)))


def lines_of(spark, answers):
    rows = [(q, json.dumps({f"c{i}": v for i, v in enumerate(row)})) for q, table in answers.items() for row in table]
    return spark.createDataFrame(rows, "query_id long, line string")


@pytest.mark.parametrize("part_rows", [100_000, 5])
def test_scores_agree_with_a_matching(spark, part_rows):
    rng = random.Random(part_rows)
    correct, given = {}, {}
    for q in range(60):
        a = [round(rng.uniform(0, 0.3), 3) for _ in range(rng.randint(1, 9))]
        b = [x + rng.choice([0, 0.01, -0.01, 0.004, 0.02]) for x in a] + [round(rng.uniform(0, 0.3), 3)] * rng.randint(0, 1)
        rng.shuffle(b)
        words = ["some", "words"] if q % 2 else []
        correct[q], given[q] = [[x] for x in a] + [[w] for w in words], [[x] for x in (b if q % 3 else b[:-1])]
    got = {r["query_id"]: r["score"] for r in row_scores.score_rows(lines_of(spark, correct), lines_of(spark, given), part_rows=part_rows).collect()}
    for q in correct:
        a, b = ([x for (x,) in t if not isinstance(x, str)] for t in (correct[q], given[q]))
        wanted = (len(b) > 0 and best_matching(b, a, 0.01)) if q % 2 else best_matching(a, b, 0.01)
        assert got[q] == int(wanted), (q, a, b)
    assert 5 < sum(got.values()) < 55


def test_scores_of_odd_answers(spark):
    correct = {1: [["a", 1], ["b", 2]], 2: [["a"], ["a"]], 3: [[None]], 4: [[5]], 5: [["x"]], 6: [[1e10]], 7: [[3]]}
    given = {1: [[2], ["b"]], 2: [["a"], ["a"], ["a"]], 3: [], 4: [], 5: [[" x "]], 6: [["1e10"], [float("nan")], [None]]}
    plain = spark.createDataFrame([(7, "3.0")], "query_id long, line string")
    got = row_scores.score_rows(lines_of(spark, correct), lines_of(spark, given).unionByName(plain))
    assert {r["query_id"]: r["score"] for r in got.collect()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1, 6: 1, 7: 1}
    assert row_scores.score_rows(plain.limit(0), plain).count() == 0


def test_a_large_answer_is_never_one_cell(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("query_id"), F.to_json(F.struct("id", (F.col("id") * 0.5).alias("half"))).alias("line"))
    scored = row_scores.score_rows(rows, rows, part_rows=5_000)
    assert scored.collect()[0][1:] == (120_000, 120_000, 1)
    assert "collect_list" not in scored._jdf.queryExecution().optimizedPlan().toString()


# ---- frequent keys ----


def test_merge_finds_frequent_keys_of_both_sides(spark):
    left = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 500 END AS k", "CASE WHEN id % 2 = 0 THEN 0.0D ELSE -0.0D END AS z", "id AS x")
    right = spark.range(300).selectExpr("CAST(CASE WHEN id % 3 = 0 THEN NULL ELSE id % 500 END AS int) AS k", "0.0D AS z", "id AS y")
    plain = joins.merge(left, right, ["k", "z"], match_nulls=True)
    auto = joins.merge(left, right, ["k", "z"], match_nulls=True, salts="auto", hot_rows=50)
    assert auto.columns == plain.columns and rows_of(auto, "x", "y") == rows_of(plain, "x", "y")
    a, b, keys = joins.spread_hot_keys(left, right, ["k", "z"], 50)
    for side in (a, b):
        # a thousand left rows and a hundred right rows share the missing key
        assert max(r["count"] for r in side.groupBy(*keys).count().collect()) < 120
    inner = joins.merge(left, right, ["k", "z"], salts="auto", hot_rows=50)
    assert rows_of(inner, "x", "y") == rows_of(joins.merge(left, right, ["k", "z"]), "x", "y")


def test_repeats_of_frequent_keys_grow_like_the_tables(spark):
    sizes = []
    for n in (1, 3):
        left = spark.range(20_000 * n).selectExpr("if(id % 2 = 0, null, id % 5) AS k", "id AS x")
        right = spark.range(2_000 * n).selectExpr("if(id % 2 = 0, null, id % 5) AS k", "id AS y")
        a, b, keys = joins.spread_hot_keys(left, right, ["k"], 10)
        sizes.append([a.count(), b.count()])
    assert all(later < 4 * first for first, later in zip(*sizes)), sizes
    small = [spark.range(m).selectExpr("if(id % 2 = 0, null, id % 5) AS k", f"id AS {c}") for m, c in ((3_000, "x"), (400, "y"))]
    assert joins._grid(1_500, 200, 1)[0] * joins._grid(1_500, 200, 1)[1] <= joins.MOST_CELLS
    plain, auto = (joins.merge(*small, ["k"], match_nulls=True, **more) for more in ({}, {"salts": "auto", "hot_rows": 1}))
    assert auto.exceptAll(plain).isEmpty() and plain.exceptAll(auto).isEmpty()


def test_all_frequent_keys_share_the_cells(spark):
    left = spark.range(20_000).selectExpr("id % 20 AS k", "id AS x")
    right = spark.range(4_000).selectExpr("id % 20 AS k", "id AS y")
    a, b, _ = joins.spread_hot_keys(left, right, ["k"], 5)
    assert a.count() + b.count() < 2.5 * (20 * 1_000 * 200 * joins.MOST_CELLS) ** 0.5


def test_frequent_keys_are_put_out_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE_ROWS", 8, raising=False)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    left = spark.range(60).selectExpr("CAST(NULL AS int) AS k", "id AS x")
    right = spark.range(200).selectExpr("CAST(NULL AS int) AS k", "id AS y")
    rows = [(r["x"], r["y"]) for r in joins.merge(left, right, ["k"], match_nulls=True, salts="auto", hot_rows=50).collect()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert sorted(rows) == [(x, y) for x in range(60) for y in range(200)]
    # the same few rows of the right side with one row of the left side after another
    assert max(len(list(run)) for _, run in itertools.groupby(x for x, _ in rows)) <= 16


@pytest.mark.parametrize("match_nulls", [True, False])
def test_tiles_keep_repeated_rows_and_odd_columns(spark, match_nulls):
    left = spark.range(900).selectExpr("IF(id % 3 = 0, NULL, IF(id % 2 = 0, -0.0D, 0.0D)) AS k", "IF(id < 800, 7, id) AS x", "map('a', id % 2) AS m", "IF(id % 5 = 0, NULL, 'v') AS v")
    right = spark.range(600).selectExpr("IF(id % 4 = 0, NULL, CAST(id % 2 AS float)) AS k")
    more = right.selectExpr("k", "CAST(NULL AS string) AS v", "IF(k IS NULL, NULL, 1) AS y")
    for other in (right, more):
        names = ["k", "x", "m['a']", *(["v_x", "v_y", "y"] if other is more else ["v"])]
        merged = [joins.merge(left, other, ["k"], match_nulls, **with_salts) for with_salts in ({}, {"salts": "auto", "hot_rows": 40})]
        assert merged[0].dtypes == merged[1].dtypes
        plain, auto = (m.groupBy(*[F.expr(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)]).count() for m in merged)
        assert rows_of(auto) == rows_of(plain) and auto.count() > 0


# ---- repeated keys ----


def test_frames_with_repeated_and_missing_keys(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (1, "b", 2.0), (None, "x", 3.0), (2, "c", float("nan")), (3, "d", None)], "k long, t string, v double")
    b = spark.createDataFrame([(1, "b", 2.0 + 1e-9), (1, "a", 1.0), (None, "x", 4.0), (2, "c", float("nan")), (3, "d", None), (4, "e", 1.0)], "k long, t string, v double")
    for group_rows in (1, 1000):
        assert rows_of(setops.frame_close(a, b, ["k"], group_rows=group_rows)) == sorted(
            [(1, "t", "a", "b"), (1, "v", "1.0", "2.000000001"), (1, "__row", "present", None), (None, "v", "3.0", "4.0"), (4, "__row", None, "present")], key=repr
        )
    assert setops.frame_close(a, a, ["k"]).count() == 0


# ---- wide forms, lags, missing numbers ----


def test_sparse_rows_have_the_cells_of_the_long_form(spark):
    df = spark.range(400).selectExpr("id % 7 AS i", "CASE WHEN id % 11 = 0 THEN NULL ELSE id % 90 END AS c", "CASE WHEN id % 13 = 0 THEN NULL ELSE double(id) END AS v")
    rows, known = reshape.pivot_sparse(df, ["i"], "c", "v", "sum", width=8)
    name = {r["number"]: r["c"] for r in known.collect()}
    assert sorted(name) == list(range(len(name))) and [r["n"] for r in known.orderBy("number").collect()] == sorted((r["n"] for r in known.collect()), reverse=True)
    cells = {(r["i"], name[n], v) for r in rows.collect() for n, v in zip(r["numbers"], r["cells"])}
    assert cells == {tuple(r) for r in reshape.pivot_long(df, ["i"], "c", "v", "sum").filter("value is not null").collect()}
    assert all(n // 8 == r["chunk"] for r in rows.collect() for n in r["numbers"])


def test_wide_form_in_blocks_has_all_cells(spark):
    rows = [(i % 3, f"c{i % 41}" if i % 13 else None, float(i) if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, c string, v double")
    wide, known = reshape.pivot_blocks(df, ["i"], "c", "v", "sum", width=8)
    assert wide.columns == ["i", "chunk", *map(str, range(8))] and known.count() == 41
    cells = reshape.melt_blocks(wide, known, ["i"], "c")
    assert rows_of(cells) == rows_of(reshape.pivot_long(df, ["i"], "c", "v", "sum").filter("value is not null"))
    none, known = reshape.pivot_blocks(df.limit(0), ["i"], "c", "v")
    assert reshape.melt_blocks(none, known, ["i"], "c").count() == 0


def test_pivot_wide_has_every_customer(spark, tmp_path):
    rows = [(k, k % 25, k / 4) for k in range(1, 1301)] + [(7, 7, 99.0), (7, 8, None), (None, 3, 1.0), (5000, None, 1.0), (6000, 2, None)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries()["pivot_wide"](spark, str(tmp_path))
    wanted = {(k % 25, k, k / 4) for k in range(1, 1301) if k != 7} | {(7, 7, 99.0)}
    assert got.columns == ["c_nationkey", "c_custkey", "value"] and sorted(map(tuple, got.collect())) == sorted(wanted)


@pytest.mark.parametrize("block_rows", [40, 100_000])
def test_many_lags_agree_with_few(spark, block_rows):
    rng = np.random.default_rng(3)
    y = rng.normal(size=700).cumsum()
    df = spark.createDataFrame([(i, float(v) if i % 17 else float("nan")) for i, v in enumerate(y)], "i long, y double")
    kept = np.array([v for i, v in enumerate(y) if i % 17])
    x = kept - kept.mean()
    got = {r["lag"]: r["r"] for r in timeseries.autocorrelation(df, "y", 60, ["i"], block_rows=block_rows).collect()}
    assert got == pytest.approx({k: float((x[k:] * x[:-k]).sum() / (x * x).sum()) for k in range(1, 61)}, abs=1e-9)
    flat = spark.range(50).selectExpr("id AS i", "1.0D AS y")
    assert {r["r"] for r in timeseries.autocorrelation(flat, "y", 40, ["i"]).collect()} == {None}


def test_one_missing_number_spoils_no_window(spark):
    df = spark.createDataFrame([(i, float("nan") if i == 5 else float(i)) for i in range(12)], "i long, v double")
    mean = [r["rolling_mean"] for r in timeseries.rolling_mean(df, "v", 2, ["i"]).orderBy("i").collect()]
    assert mean == [None, 0.5, 1.5, 2.5, 3.5, None, None, 6.5, 7.5, 8.5, 9.5, 10.5]
    assert [r["pct_change"] for r in timeseries.pct_change(df, "v", ["i"]).orderBy("i").collect()][5:7] == [None, None]
    fitted = [r["fitted"] for r in charts.chart_trend(df, "i", "v").orderBy("x").collect()]
    assert fitted == pytest.approx(list(range(12)))


# ---- nested sections ----


def test_examples_end_at_a_heading_of_their_own_level_only(spark):
    inner = "<div class='x'><h2>Inner</h2><pre>b</pre></div>"
    pages = [
        (1, f"<h1>m</h1><section><p>Examples</p><pre>a</pre>{inner}<p>open<li>item<pre>c</pre><br><img src='y'><h2>Next</h2><pre>no</pre></section>"),
        (2, f"<h1>m</h1><section><p>Examples</p><pre>a</pre>{inner}</section><pre>outside</pre>"),
        (3, "<h1>m</h1><p>Examples</p>"),
        (4, "<h1>m</h1><p>nothing</p><pre>x</pre>"),
        (5, None),
    ]
    df = spark.createDataFrame([(i, h, "u") for i, h in pages], "page_id long, html string, url string")
    got = {r["page_id"]: r["examples"] for r in corpus.doc_examples(df, nested=True).collect()}
    assert got[1] == "a\nb\nc" and got[2] == "a\nb" and got[3] == "" and "not found" in got[4]
    assert {r["page_id"]: r["examples"] for r in corpus.doc_examples(df).collect()}[1] == "a"
