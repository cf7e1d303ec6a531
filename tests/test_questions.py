"""Prompts, hooks, corpus work and the answering loop."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sheetwise.operators import corpus, hooks, prompts
from sheetwise.operators.answering import ANSWER_ROWS, EMPTY_ANSWER, answer, answer_batch, detail_record
from sheetwise.operators.evaluate import executable_rate, score_exact
from sheetwise.operators.joins import overlay_details, pair_answers
from sheetwise.operators.profile import annotation_json, head_text, profile_json, profile_table
from sheetwise.sources.registry import TableRegistry
from sheetwise.sources.tables import read_jsonl


@pytest.fixture(scope="module")
def asked(spark):
    rows = [
        (1, "t", "Plot happiness_index values", "plot", "plots/t1.png"),
        (2, "t", "mean of A?", "general", None),
        (3, "t", "Draw a chart", "plot", None),
    ]
    return spark.createDataFrame(
        rows, "query_id long, table_name string, user_query string, tagged_query_type string, plot_filename string"
    )


@pytest.fixture(scope="module")
def known(spark):
    df = spark.createDataFrame([(1, 4, 7), (2, 5, 8), (3, 6, 9)], "A long, B long, C long")
    columns = profile_json(profile_table(df, "t", 2, ["A"]))
    notes = annotation_json(spark.createDataFrame([("A", "first")], "column string, description string"))
    head = head_text(df, 2, ["A"])
    row = (columns.first()["column_text"], head.first()[0], notes.first()[0])
    return spark.createDataFrame([("t", *row)], "table_name string, column_text string, head_text string, annotation_text string")


@pytest.mark.parametrize("strategy", prompts.STRATEGIES)
@pytest.mark.parametrize("mode", prompts.MODES)
def test_every_prompt_names_question_and_table(asked, known, strategy, mode):
    rows = prompts.render_prompts(asked, known, strategy, mode).orderBy("query_id").collect()
    if mode == "plot_save":
        assert [r["error"] is None for r in rows] == [True, False, False]
        assert "plots/t1.png" in rows[0]["prompt"] and rows[1]["prompt"] is None
    else:
        assert all(r["error"] is None for r in rows)
    shown = rows[0]["prompt"]
    assert "Plot happiness_index values" in shown and '"column_name":"A"' in shown and '"A":"first"' in shown
    assert "1 | 4 | 7" in shown
    assert ("<FILL_ME>" in shown) == ("infilling" in strategy)
    if "infilling" in strategy or "completion" in strategy:
        assert "\n    1 | 4 | 7" in shown


def test_auto_mode_follows_the_tag(asked, known):
    saved = prompts.render_prompts(asked, known, "coder_only_simple").orderBy("query_id").collect()
    assert "savefig('plots/t1.png')" in saved[0]["prompt"]
    assert "Print the final result" in saved[1]["prompt"]
    assert saved[2]["prompt"] is None and saved[2]["error"]
    shown = prompts.render_prompts(asked, known, "coder_only_simple", show_plot=True).orderBy("query_id").collect()
    assert "plt.show()" in shown[2]["prompt"]


def test_guards(asked, known):
    with pytest.raises(ValueError):
        prompts.render_prompts(asked, known, "coder_only_simple", planning=True)
    with pytest.raises(ValueError):
        prompts.render_prompts(asked, known, "fancy")
    with pytest.raises(ValueError):
        prompts.code_template("simple", "sing")
    with pytest.raises(ValueError):
        prompts.format_training(asked, "poem")
    with pytest.raises(ValueError):
        prompts.render_debug_prompts(asked, "guess")
    planned = asked.withColumn("plan", F.when(F.col("query_id") == 2, "1. add"))
    rows = prompts.render_prompts(planned, known, "coder_only_functions", "general").orderBy("query_id").collect()
    assert [r["error"] for r in rows] == [None, "this strategy takes no plan", None]
    rows = prompts.render_prompts(planned, known, "functions", "general").orderBy("query_id").collect()
    assert "1. add" in rows[1]["prompt"]


def test_plan_prompts(asked, known):
    rows = prompts.render_prompts(asked, known, "functions", planning=True).orderBy("query_id").collect()
    assert "at most six" in rows[0]["prompt"] and "plots/t1.png" in rows[0]["prompt"]


def test_debug_prompts(asked, known):
    failed = asked.withColumn("code_errors", F.when(F.col("query_id") == 2, "KeyError: 'A'")).withColumn(
        "code", F.lit("df['A ']")
    )
    failed = failed.withColumn("coder_prompt", F.lit("def solve(df):"))
    basic = prompts.render_debug_prompts(failed, "basic", known).collect()
    assert len(basic) == 1 and "KeyError: 'A'" in basic[0]["debug_prompt"] and "df['A ']" in basic[0]["debug_prompt"]
    completion = prompts.render_debug_prompts(failed, "completion", known).first()["debug_prompt"]
    assert completion.endswith("def solve(df):\n")


def test_collect_inputs_writes_json_lines(spark, asked, known, tmp_path):
    coded = asked.withColumn("code", F.lit("return 1"))
    pairs = prompts.collect_inputs(coded, known, "coder_only_completion_functions", str(tmp_path / "in"), mode="general")
    back = read_jsonl(spark, str(tmp_path / "in"), "input string, output string")
    assert rows_of(pairs, "input", "output") == rows_of(back)
    assert all(r["input"].endswith('"""\n') and r["output"] == "return 1\n```" for r in back.collect())


def test_completions_isolate_a_bad_prompt(spark):
    def set_up():
        def complete(batch):
            if "bad" in batch:
                raise RuntimeError("refused")
            return [p.upper() for p in batch]

        return complete

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string").coalesce(1)
    out = hooks.map_completions(df, "prompt", hooks.completion_for("up-7b", {"up": set_up, "u": None}))
    assert rows_of(out) == [("a", "A", None), ("bad", None, "RuntimeError: refused"), ("c", "C", None)]
    with pytest.raises(ValueError):
        hooks.completion_for("other", {"up": set_up})


PAGE = """<html><body><h1> pandas.DataFrame.sum<a href="#x">#</a></h1><p>Total.</p><pre>not this</pre>
<p class="rubric">Examples</p><div><pre><span>&gt;&gt;&gt; df</span>.sum()</pre></div><p>Then</p><pre>6 &amp; 7</pre>
<h2>Notes</h2><pre>nor this</pre><a href="api/pandas.sum.html">s</a> <a class="x" href='b.txt'>t</a></body></html>"""


def test_documentation_pages(spark):
    rows = [(1, "https://x/api/pandas.sum", PAGE), (2, "https://x/api/pandas.none", "<p>no heading</p>"), (3, "https://x/other", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = rows_of(corpus.doc_examples(pages, url_part="api/pandas"))
    assert found == [
        (1, "pandas.DataFrame.sum", ">>> df.sum()\n6 & 7"),
        (2, "Method name not found", "Examples section not found"),
    ]
    links = corpus.page_links(pages.filter("page_id = 1"), ".html", "https://x/reference/").collect()
    assert [r["full_url"] for r in links] == ["https://x/reference/api/pandas.sum.html"]
    prompt = corpus.example_prompts(corpus.doc_examples(pages, url_part="api/pandas")).orderBy("page_id").first()["prompt"]
    assert "'pandas.DataFrame.sum'" in prompt and "6 & 7" in prompt


def test_resume_without_marker_skips_all(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, k string")
    assert rows_of(corpus.resume_after(df, "k", "b", "i")) == [(3, "c")]
    assert corpus.resume_after(df, "k", "z", "i").count() == 0


def test_chart_text(spark):
    df = spark.createDataFrame([(1, "TITLE | Happy <0x0A>Country | Index<0x0A>Italy | 4<0x0A>a | b | c<0x0A>x")], "id int, t string")
    assert rows_of(corpus.parse_chart_table(df, "id", "t")) == [
        (1, "Happy", 1, "Country", "Index"),
        (1, "Happy", 2, "Italy", "4"),
    ]


@pytest.fixture
def registry(spark, gdp):
    tables = TableRegistry(spark)
    tables.put("countries", gdp)
    return tables


GOOD = "select max(gdp) as top from countries"
BAD = "select max(gpd) as top from countries"


def late_failure(df):
    """Fails while running, not while planning."""
    return df.select(F.raise_error(F.lit("broken cell")).alias("x"))


def test_answer_repairs_until_a_candidate_runs(registry):
    result, detail = answer(registry, "countries", "Largest gdp?", [BAD, late_failure, GOOD], query_id=5)
    assert result.collect()[0]["top"] == 19294482071552
    assert detail["successful_code_execution"] and detail["count_of_fixing_errors"] == 2
    assert detail["first_generated_code"] == BAD and detail["final_generated_code"] == GOOD
    assert detail["code_errors"] == "" and detail["result_repl_stdout"] == '{"top":19294482071552}'
    assert detail["tagged_query_type"] == "general" and detail["plot_filename"] == ""


def test_answer_gives_up_after_the_allowed_repairs(registry):
    result, detail = answer(registry, "countries", "Plot gdp", [BAD, BAD, BAD, GOOD], max_retry=2)
    assert result == "ERROR" and not detail["successful_code_execution"]
    assert detail["count_of_fixing_errors"] == 2
    assert detail["code_errors"].startswith('0. "AnalysisException') and "\n2. " in detail["code_errors"]
    assert detail["tagged_query_type"] == "plot" and detail["plot_filename"].startswith("plots/countries0-")


def test_answer_of_an_empty_result_and_of_a_missing_table(registry):
    result, detail = answer(registry, "countries", "Which?", [lambda df: df.limit(0)])
    assert result == EMPTY_ANSWER and detail["successful_code_execution"]
    assert answer(registry, "absent", "Which?", [GOOD]) == (None, None)
    assert answer(registry, "countries", "Which?", [GOOD], collect_only=True, coder_prompt="P") == ("P", None)


def test_batch_goes_on_after_a_bad_row(spark, registry, tmp_path):
    rows = [
        (1, "countries", "Largest gdp?", "general"),
        (2, "countries", "nan", "general"),
        (3, "absent", "Anything?", "general"),
        (4, "countries", "Smallest gdp?", "general"),
        (5, "countries", "Plot all", "plot"),
    ]
    sheet = spark.createDataFrame(rows, "query_id long, table_name string, user_query string, tagged_query_type string")

    def candidates(row):
        if row["query_id"] == 5:
            raise RuntimeError("no idea")
        return [BAD] if row["query_id"] == 4 else [BAD, GOOD]

    for path in (None, str(tmp_path / "run")):
        details = answer_batch(sheet, registry, candidates, path, save_every=1)
        assert rows_of(details, "query_id", "successful_code_execution") == [(1, True), (4, False)]
    merged = overlay_details(sheet, details).filter("user_query <> 'nan'")
    rate = executable_rate(merged.withColumn("cohort", F.lit("all")), "cohort", ["all"]).first()
    assert tuple(rate) == ("all", 4, 1, 0.25)


def test_large_answers_are_stored_and_scored_whole(spark, registry, tmp_path):
    work = "SELECT id, repeat('x', 60) AS filler FROM range(20000) ORDER BY id"
    whole = "\n".join(f'{{"id":{i},"filler":"{"x" * 60}"}}' for i in range(20_000))
    rows = [(1, "countries", "Which?", "general"), (2, "countries", "Which?", "general"), (3, "countries", "Largest gdp?", "general")]
    sheet = spark.createDataFrame(rows, "query_id long, table_name string, user_query string, tagged_query_type string")
    gold = spark.createDataFrame([(1, "general", whole), (2, "general", whole)], "query_id long, tagged_query_type string, result_repl_stdout string")
    path = str(tmp_path / "details")
    details = answer_batch(sheet, registry, lambda r: [GOOD if r["query_id"] == 3 else work], path)
    assert rows_of(details, "query_id", "result_repl_stdout") == [(1, whole), (2, whole), (3, '{"top":19294482071552}')]
    assert tuple(score_exact(pair_answers(gold, spark.read.parquet(path))).first()) == (2, 1.0)
    _, detail = answer(registry, "countries", "Which?", [work], query_id=1)  # its rows go to a table that it names
    lines = spark.read.schema(ANSWER_ROWS).parquet(detail["result_repl_stdout"].split()[-1])
    assert lines.count() == 20_000
    given = spark.createDataFrame([(1, detail["result_repl_stdout"])], "query_id long, result_repl_stdout string")
    assert tuple(score_exact(pair_answers(gold.filter("query_id = 1"), given, answers=lines)).first()) == (1, 1.0)


def test_detail_record_without_attempts():
    detail = detail_record(1, "general", [], ["x"], False, "ERROR")
    assert detail["count_of_fixing_errors"] == 0 and detail["code_errors"] == '0. "x"'
