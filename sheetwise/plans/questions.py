"""Profiles, prompts, tagging, scoring, answering, corpus work and caller hooks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from sheetwise.functions import text
from sheetwise.operators import corpus, evaluate, hooks, joins, profile, prompts, row_scores
from sheetwise.operators.answering import ANSWER_ROWS, EMPTY_ANSWER, answer, answer_batch
from sheetwise.plans.flagship import correlation_answer
from sheetwise.plans.registry import query, rounded, sql, table
from sheetwise.plans.tables import PAIRS, answer_sheets
from sheetwise.session import checkpoint_folder
from sheetwise.sources import tables
from sheetwise.sources.registry import TableRegistry
from sheetwise.sources.results import DETAIL, write_report, write_results


def filled_sql(template: str, values: dict[str, str]) -> str:
    """The SQL concatenation that fills a template like ``text.fill``."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        parts.append("'" + piece.replace("'", "''") + "'" if i % 2 == 0 else f"coalesce(CAST({values[piece]} AS VARCHAR), '')")
    return " || ".join(parts)


# ---- profiles and prompts ----

TABLES = {
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
}


def _samples_sql(name: str) -> str:
    columns = TABLES[name]
    key = next(iter(columns))
    first = f"(SELECT * FROM {name} ORDER BY {key} LIMIT 2)"
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, '{c}' AS column_name, {i} AS position, '{t}' AS data_type,
        string_agg(CAST({c} AS VARCHAR), '|' ORDER BY {key}) AS samples FROM {first}"""
        for i, (c, t) in enumerate(columns.items())
    )


_SAMPLES = " UNION ALL ".join(_samples_sql(name) for name in TABLES)


def _profile_rows(spark, d):
    out = None
    for name, columns in TABLES.items():
        found = profile.profile_table(table(spark, d, name), name, 2, list(columns)[:1])
        out = found if out is None else out.unionByName(found)
    return out


@query("profile_table", _SAMPLES)
def _(spark, d):
    found = _profile_rows(spark, d)
    return found.withColumn("sample_values", F.array_join("sample_values", "|")).withColumnRenamed("sample_values", "samples")


_PROFILE_JSON = f"""SELECT table_name, '[' || string_agg('{{"column_name":"' || column_name || '","sample_values":["'
 || replace(samples, '|', '","') || '"]}}', ',' ORDER BY position) || ']' AS column_text FROM ({_SAMPLES}) GROUP BY table_name"""


@query("profile_json", _PROFILE_JSON)
def _(spark, d):
    return profile.profile_json(_profile_rows(spark, d))


_HEAD = "(" + " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, '{" | ".join(columns)}' || chr(10) ||
    string_agg(concat_ws(' | ', {", ".join(columns)}), chr(10) ORDER BY {next(iter(columns))}) AS head_text
    FROM (SELECT * FROM {name} ORDER BY {next(iter(columns))} LIMIT 2)"""
    for name, columns in TABLES.items()
) + ")"


def _heads(spark, d):
    out = None
    for name, columns in TABLES.items():
        head = profile.head_text(table(spark, d, name), 2, list(columns)[:1]).withColumn("table_name", F.lit(name))
        out = head if out is None else out.unionByName(head)
    return out


@query("head_text", f"SELECT * FROM {_HEAD}")
def _(spark, d):
    return _heads(spark, d)


def _profiles(spark, d):
    """What is known of the two tables, as a row each."""
    return profile.profile_json(_profile_rows(spark, d)).join(_heads(spark, d), "table_name")


# questions of all kinds: the user turns, some of them worded as wishes for a plot
_WORDED = """CASE conv_id % 4 WHEN 0 THEN 'Plot ' || text WHEN 1 THEN text || ' as a barplot'
  WHEN 2 THEN 'average depth in the "Plot" column ' || text ELSE text END"""
_ABOUT = "CASE WHEN turn % 3 = 1 THEN 'customer' ELSE 'supplier' END"
_KIND = "CASE WHEN conv_id % 4 < 2 THEN 'plot' ELSE 'general' END"
_QUESTIONS = f"""(SELECT conv_id * 1000 + turn AS query_id, {_ABOUT} AS table_name, {_WORDED} AS user_query,
  {_KIND} AS tagged_query_type, 'plots/' || conv_id || '.png' AS plot_filename, 'return df' AS code, conv_id FROM conversations WHERE role = 'user')"""


def questions(spark, d):
    talk = table(spark, d, "conversations").filter("role = 'user'")
    return talk.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        sql(_ABOUT).alias("table_name"),
        sql(_WORDED).alias("user_query"),
        sql(_KIND).alias("tagged_query_type"),
        sql("'plots/' || conv_id || '.png'").alias("plot_filename"),
        F.lit("return df").alias("code"),
        "conv_id",
    )


_KNOWN = {"question": "user_query", "head": "head_text", "columns": "column_text", "annotation": "''", "plan": "plan", "plot": "plot_filename"}
_JOINED = f"{_QUESTIONS} q JOIN ({_PROFILE_JSON}) p USING (table_name) JOIN {_HEAD} h USING (table_name)"


@query(
    "render_prompts",
    f"""SELECT query_id, CASE WHEN tagged_query_type = 'plot'
      THEN {filled_sql(prompts.code_template("coder_only_functions", "plot_save"), _KNOWN)}
      ELSE {filled_sql(prompts.code_template("coder_only_functions", "general"), _KNOWN)} END AS prompt FROM {_JOINED}""",
)
def _(spark, d):
    return prompts.render_prompts(questions(spark, d), _profiles(spark, d), "coder_only_functions").select("query_id", "prompt")


@query(
    "render_plans",
    f"""SELECT query_id, {filled_sql(prompts.plan_template("simple", "general"), _KNOWN)} AS prompt FROM {_JOINED}""",
)
def _(spark, d):
    rendered = prompts.render_prompts(questions(spark, d), _profiles(spark, d), "simple", "general", planning=True)
    return rendered.select("query_id", "prompt")


_INDENT = "'    ' || replace({0}, chr(10), chr(10) || '    ')"
_DOC = {**_KNOWN, "head": _INDENT.format("head_text"), "columns": _INDENT.format("column_text")}


@query(
    "collect_inputs",
    f"""SELECT query_id, substr(prompt, 1, length(prompt) - 4) AS input, code || chr(10) || '```' AS output FROM
    (SELECT query_id, code, {filled_sql(prompts.code_template("coder_only_completion_functions", "general"), _DOC)} AS prompt FROM {_JOINED})""",
)
def _(spark, d):
    return prompts.collect_inputs(questions(spark, d), _profiles(spark, d), "coder_only_completion_functions", mode="general")


@query(
    "render_debug_prompts",
    f"""SELECT query_id, {filled_sql(prompts._DEBUG["basic"], {**_KNOWN, "code": "code", "error": "'KeyError: ' || conv_id"})} AS debug_prompt
    FROM {_JOINED} WHERE conv_id % 3 <> 0""",
)
def _(spark, d):
    failed = questions(spark, d).withColumn("code_errors", sql("CASE WHEN conv_id % 3 <> 0 THEN 'KeyError: ' || conv_id ELSE '' END"))
    return prompts.render_debug_prompts(failed, "basic", _profiles(spark, d)).select("query_id", "debug_prompt")


_EXCHANGE = """(SELECT u.conv_id, u.turn, u.text AS input, a.text AS output FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def exchanges(spark, d):
    talk = table(spark, d, "conversations")
    asked = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    given = talk.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return asked.join(given, ["conv_id", "turn"])


@query(
    "format_training",
    f"""SELECT conv_id, turn, input || output || '</s>' AS completion, '<s>[INST] ' || input || ' [/INST]' || chr(10) || output || '</s>' AS instruct,
    input || '# Code:' || chr(10) || '    ' || output || '</s>' AS marker, output AS raw FROM {_EXCHANGE}""",
)
def _(spark, d):
    rows = exchanges(spark, d)
    for style in ("completion", "instruct", "marker", "raw"):
        rows = prompts.format_training(rows, style).withColumnRenamed("training_text", style)
    return rows.drop("input", "output")


_MODELS = """CASE doc_id % 5 WHEN 0 THEN 'codellama/CodeLlama-7b-Instruct-hf' WHEN 1 THEN 'codellama/CodeLlama-13b-Python-hf'
  WHEN 2 THEN 'ise-uiuc/Magicoder-S-CL-7B' WHEN 3 THEN 'WizardLM/WizardCoder-15B-V1.0' ELSE 'gpt-3.5-turbo' END"""


@query(
    "model_wrap",
    f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '<s>[INST] ' || text || ' [/INST]' WHEN 1 THEN '<s>' || text
    WHEN 2 THEN {filled_sql(prompts._MAGICODER, {"prompt": "text"})} WHEN 3 THEN {filled_sql(prompts._WIZARD, {"prompt": "text"})}
    ELSE text END AS wrapped FROM documents""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", sql(_MODELS).alias("model"))
    return docs.select("doc_id", prompts.model_wrap("text", "model").alias("wrapped"))


# ---- tagging, scoring, answering ----

_BARE = r"""regexp_replace({0}, '(^|[^\w])(?:''[^''\n]*''|"[^"\n]*")([^\w]|$)', '\1 \2', 'g')"""
_TAG = rf"""CASE WHEN regexp_matches({_BARE}, '(?i)(?:plot|chart)(?:s|ed|ted|ing|ting)?\b|\bgraphs?\b|\bvisuali[sz]|\bhistograms?\b|\bscatter|\bfigures?\b|\bdiagrams?\b|\bdraw(?:s|n|ing)?\b') THEN 'plot' ELSE 'general' END"""


@query("tag_queries", f"SELECT query_id, {_TAG.format('user_query')} AS tagged_query_type FROM {_QUESTIONS}")
def _(spark, d):
    untagged = questions(spark, d).drop("tagged_query_type")
    return evaluate.tag_queries(untagged).select("query_id", "tagged_query_type")


@query(
    "score_exact",
    f"""SELECT count(*) AS n, round(avg(CASE WHEN trim(correct) = trim(answer) THEN 1 ELSE 0 END), 6) AS score
    FROM {PAIRS} WHERE tagged_query_type = 'general'""",
)
def _(spark, d):
    return rounded(evaluate.score_exact(joins.pair_answers(*answer_sheets(spark, d))), 6, "score")


_NUMERIC = """(SELECT l_orderkey AS query_id, 'general' AS tagged_query_type, CAST(l_extendedprice AS VARCHAR) AS correct,
  l_extendedprice AS price, CASE l_linenumber % 4 WHEN 0 THEN 'The price is ' || CAST(l_extendedprice AS VARCHAR)
  WHEN 1 THEN 'between ' || CAST(l_quantity AS VARCHAR) || ' and ' || CAST(l_tax AS VARCHAR)
  WHEN 2 THEN '[' || CAST(round(l_extendedprice + 0.004, 3) AS VARCHAR) || ', ' || CAST(l_quantity AS VARCHAR) || ']'
  ELSE CAST(round(l_extendedprice + 0.02, 2) AS VARCHAR) END AS answer, l_quantity, l_tax, l_linenumber FROM lineitem)"""


@query(
    "score_tolerant",
    rf"""SELECT count(*) AS n, round(avg(s), 6) AS score FROM (SELECT CASE WHEN len(list_filter(
      list_transform(regexp_extract_all(answer, '-?\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE)),
      lambda x: abs(x - price) <= 0.01 + 1e-9)) > 0 THEN 1 ELSE 0 END AS s FROM {_NUMERIC})""",
)
def _(spark, d):
    number = "CAST({} AS STRING)".format
    items = table(spark, d, "lineitem").select(
        F.lit("general").alias("tagged_query_type"),
        sql(number("CAST(l_extendedprice AS DECIMAL(18, 2))")).alias("correct"),
        sql(
            f"""CASE l_linenumber % 4 WHEN 0 THEN 'The price is ' || {number("CAST(l_extendedprice AS DECIMAL(18, 2))")}
            WHEN 1 THEN 'between ' || {number("l_quantity")} || ' and ' || {number("l_tax")}
            WHEN 2 THEN '[' || {number("CAST(round(l_extendedprice + 0.004, 3) AS DECIMAL(18, 3))")} || ', ' || {number("l_quantity")} || ']'
            ELSE {number("CAST(round(l_extendedprice + 0.02, 2) AS DECIMAL(18, 2))")} END"""
        ).alias("answer"),
    )
    return rounded(evaluate.score_tolerant(items), 6, "score")


@query(
    "executable_rate",
    """SELECT c.cohort, coalesce(n, 0) AS n_queries, coalesce(ok, 0) AS n_executable, coalesce(rate, 0) AS rate FROM
    (SELECT unnest(['src0', 'src1', 'src2', 'src999']) AS cohort) c LEFT JOIN
    (SELECT source AS cohort, count(*) AS n, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ok,
     round(avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 6) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) r
    ON c.cohort = r.cohort""",
)
def _(spark, d):
    runs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    runs = runs.withColumn("successful_code_execution", F.col("quality") == 1)
    return rounded(evaluate.executable_rate(runs, "source", ["src0", "src1", "src2", "src999"]), 6, "rate")


@query(
    "tagging_accuracy",
    rf"""WITH t AS (SELECT {_TAG.format("text")} = 'plot' AS tag, quality = 1 AS truth FROM
      (SELECT CASE WHEN doc_id % 2 = 0 THEN 'plot ' || text ELSE text END AS text, quality FROM documents JOIN labels USING (doc_id)))
    SELECT count(*) AS n, round(avg(CASE WHEN tag = truth THEN 1 ELSE 0 END), 6) AS accuracy,
    round(avg(CASE WHEN tag = truth THEN 1 ELSE 0 END) FILTER (truth), 6) AS accuracy_plot,
    round(avg(CASE WHEN tag = truth THEN 1 ELSE 0 END) FILTER (NOT truth), 6) AS accuracy_general FROM t""",
)
def _(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    asked = docs.select(
        sql("CASE WHEN doc_id % 2 = 0 THEN 'plot ' || text ELSE text END").alias("user_query"),
        (F.col("quality") == 1).alias("has_plot_answer"),
    )
    found = evaluate.tagging_accuracy(evaluate.tag_queries(asked))
    return rounded(found, 6, "accuracy", "accuracy_plot", "accuracy_general")


@query("flagship", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem")
def _(spark, d):
    return rounded(correlation_answer(spark, d), 6, "corr")


_ANSWER = "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority"


@query("answer_sql", _ANSWER)
def _(spark, d):
    registry = TableRegistry(spark)
    registry.register("orders", f"{d}/orders.parquet")
    wrong = "SELECT o_priority, count(*) FROM orders GROUP BY o_priority"
    result, detail = answer(registry, "orders", "Mean price per priority?", [wrong, _ANSWER])
    if detail is None or detail["count_of_fixing_errors"] != 1:
        raise RuntimeError(f"unexpected run: {detail}")
    return result


@query(
    "reuse_plans",
    """SELECT d.doc_id AS query_id, source AS user_query, CASE WHEN quality = 1 THEN 'plan' END AS plan,
    CASE WHEN toxic = 0 THEN 'general' END AS tagged_query_type, CASE WHEN quality = 1 THEN 'asked' END AS prompt_user_for_planner,
    CAST(NULL AS VARCHAR) AS plot_filename,
    CASE WHEN (coalesce(quality, 0) <> 1) <> (coalesce(toxic, 1) <> 0) THEN 'plan and tag must both be given or both be absent' END AS error
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, d):
    sheet = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("user_query"))
    former = table(spark, d, "labels").select(
        F.col("doc_id").alias("query_id"),
        F.when(F.col("quality") == 1, "plan").alias("plan"),
        F.when(F.col("toxic") == 0, "general").alias("tagged_query_type"),
        F.when(F.col("quality") == 1, "asked").alias("prompt_user_for_planner"),
        F.lit(None).cast("string").alias("plot_filename"),
    )
    return evaluate.reuse_plans(sheet, former)


# ---- corpus ----

_BASE = "https://docs.example.org/reference"


def _entities(c: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    return c


@query(
    "page_links",
    rf"""SELECT page_id, url, href, '{_BASE}' || href AS full_url FROM (SELECT page_id, url, {_entities("h")} AS href FROM
    (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS h FROM pages))
    WHERE href LIKE '%n'""",
)
def _(spark, d):
    return corpus.page_links(table(spark, d, "pages"), "n", _BASE)


_PLAIN = lambda c: _entities(f"regexp_replace({c}, '<[^>]*>', '', 'g')")
_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


@query(
    "doc_examples",
    rf"""WITH s AS (SELECT page_id, html, string_split(regexp_replace(html, '(<[pP][\s>])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM pages),
    f AS (SELECT page_id, html, parts, coalesce(list_position(list_transform(parts, lambda p: regexp_matches(p, '^<[pP][\s>]')
           AND contains({_PLAIN("string_split(p, '</p>')[1]")}, 'ion ')), true), 0) AS pos FROM s),
    r AS (SELECT page_id, html, pos, regexp_replace(array_to_string(parts[greatest(pos, 1):], ''), '(?is)^.*?</p>', '') AS rest FROM f),
    c AS (SELECT *, string_split(regexp_replace(rest, '(?i)<(?:footer|h2)[\s>]', chr(1)), chr(1))[1] AS region FROM r)
    SELECT page_id, string_split(trim({_PLAIN("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, {_WS}), '#')[1] AS method_name,
    CASE WHEN pos > 0 THEN array_to_string(list_transform(regexp_extract_all(region, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda b: {_PLAIN("b")}), chr(10))
      ELSE 'Examples section not found' END AS examples FROM c""",
)
def _(spark, d):
    return corpus.doc_examples(table(spark, d, "pages"), heading="ion ", block_tag="p", stop_tags=("footer", "h2"))


@query(
    "example_prompts",
    f"SELECT doc_id, {filled_sql(corpus.EXAMPLE_PROMPT, {'method_name': 'source', 'examples': 'text'})} AS prompt FROM documents",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("method_name"), F.col("text").alias("examples"))
    return corpus.example_prompts(docs).select("doc_id", "prompt")


@query(
    "resume_after",
    "SELECT * FROM orders WHERE o_orderkey > (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')",
)
def _(spark, d):
    return corpus.resume_after(table(spark, d, "orders"), "o_orderstatus", "P", "o_orderkey")


@query(
    "coder_records",
    "SELECT text AS coder_prompt, source AS plan, lang AS generated_code, doc_id AS query_id FROM documents",
)
def _(spark, d):
    sheet = table(spark, d, "documents").select(
        F.col("doc_id").alias("query_id"),
        F.col("text").alias("coder_prompt"),
        F.col("source").alias("plan"),
        F.col("lang").alias("final_generated_code"),
    )
    return corpus.coder_records(sheet)


_CHART = """'TITLE | ' || source || '<0x0A>' || lang || ' | ' || n_chars || '<0x0A>a | b | c<0x0A>' || replace(text, chr(10), '<0x0A>') || '<0x0A> last |' || doc_id"""


@query(
    "parse_chart_table",
    f"""WITH l AS (SELECT doc_id, trim(source) AS title, string_split(replace({_CHART}, '<0x0A>', chr(10)), chr(10)) AS lines FROM documents),
    p AS (SELECT doc_id, title, unnest(lines) AS line, CAST(unnest(range(len(lines))) AS INTEGER) AS position FROM l)
    SELECT doc_id, title, position, trim(string_split(line, '|')[1]) AS label, trim(string_split(line, '|')[2]) AS value FROM p
    WHERE position > 0 AND len(string_split(line, '|')) = 2""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", sql(_CHART).alias("chart"))
    return corpus.parse_chart_table(docs, "doc_id", "chart")


# ---- hooks ----


@query("map_completions", "SELECT doc_id, 'echo: ' || text AS response, CAST(NULL AS VARCHAR) AS error FROM documents")
def _(spark, d):
    def set_up():
        return lambda asked: ["echo: " + p for p in asked]

    make = hooks.completion_for("echo-1", {"echo": set_up})
    return hooks.map_completions(table(spark, d, "documents").select("doc_id", "text"), "text", make).drop("text")


def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    user, n, best = None, 0, None
    for pdf in batches:
        user, n, top = pdf["user_id"].iloc[0], n + len(pdf), pdf["value"].max()
        best = top if best is None else max(best, top)
    yield pd.DataFrame({"user_id": [user], "n": [n], "best": [best]})


@query("solve_groups", "SELECT user_id, count(*) AS n, max(value) AS best FROM events GROUP BY user_id")
def _(spark, d):
    events = table(spark, d, "events").select("user_id", "value")
    return hooks.solve_groups(events, "user_id", solve, "user_id long, n long, best double")


# ---- answers and scores with content ----


def _scored(df, correct: str, answer: str):
    pairs = df.select(sql(correct).alias("correct"), sql(answer).alias("answer"), F.lit("general").alias("tagged_query_type"), "key")
    return pairs.select("key", evaluate.tolerant_match("correct", "answer").alias("score"))


@query("score_dates", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS score FROM orders")
def _(spark, d):
    orders = table(spark, d, "orders").withColumn("key", F.col("o_orderkey")).withColumn("day", F.to_date("o_orderdate"))
    other = "CAST(date_add(day, CASE WHEN key % 3 = 0 THEN 2 ELSE 1 END) AS STRING)"
    first, second = "CAST(day AS STRING)", "CAST(date_add(day, 1) AS STRING)"
    return _scored(orders, f"'[' || {first} || ', ' || {second} || ']'", f"'0    ' || {other} || '\n1    ' || {first}")


@query(
    "score_lists",
    """SELECT l_orderkey * 10 + l_linenumber AS key,
    CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN abs(l_quantity - l_tax) <= 0.01 THEN 1 ELSE 0 END ELSE 1 END AS score FROM lineitem""",
)
def _(spark, d):
    items = table(spark, d, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    q, t = "CAST(l_quantity AS STRING)", "CAST(l_tax AS STRING)"
    given = f"""CASE l_linenumber % 3 WHEN 0 THEN '[' || {t} || ', ' || {q} || ', ' || {q} || ']'
      WHEN 1 THEN '[' || {q} || ', ' || {t} || ', ' || {t} || ']' ELSE '[' || {q} || ', ' || {t} || ', 77, ' || {q} || ']' END"""
    return _scored(items, f"'[' || {q} || ', ' || {q} || ', ' || {t} || ']'", given)


@query("score_text", "SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS score FROM part")
def _(spark, d):
    parts = table(spark, d, "part").withColumn("key", F.col("p_partkey"))
    kind = "translate(p_type, '0123456789', 'abcdefghij')"
    return _scored(parts, kind, f"CASE WHEN p_partkey % 2 = 0 THEN 'It is ' || upper({kind}) || '.' ELSE 'zz' END")


@query("score_sci", "SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS score FROM part")
def _(spark, d):
    parts = table(spark, d, "part").withColumn("key", F.col("p_partkey"))
    grouped = "CASE WHEN p_partkey % 2 = 0 THEN format_number(p_partkey * 1000 + 0.5, 1) ELSE '5-' || CAST(p_partkey AS STRING) END"
    plain = "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey * 1000 + 0.5 AS STRING) ELSE '-' || CAST(p_partkey AS STRING) END"
    return _scored(parts, plain, grouped)


def _checkpointed(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"


@query("answer_rows", "SELECT 7 AS query_id, row_number() OVER (ORDER BY c_custkey) - 1 AS row, c_custkey, c_name FROM customer")
def _(spark, d):
    registry, path = TableRegistry(spark), _checkpointed(spark, "answers")
    registry.register("customer", f"{d}/customer.parquet")
    answer(registry, "customer", "Who are the customers?", ["SELECT c_custkey, c_name FROM customer ORDER BY c_custkey"], query_id=7, answers=path)
    lines = spark.read.schema(ANSWER_ROWS).parquet(path)
    fields = F.from_json("line", "c_custkey long, c_name string")
    return lines.select("query_id", "row", fields.alias("f")).select("query_id", "row", "f.*")


@query(
    "detail_row",
    """SELECT CAST(3 AS BIGINT) AS query_id, 'general' AS tagged_query_type, 2 AS count_of_fixing_errors, true AS successful_code_execution,
    'plan it' AS prompt_user_for_planner, '' AS plot_filename, '' AS code_errors,
    '{"n":' || CAST(count(*) AS VARCHAR) || '}' AS result_repl_stdout, true AS repaired FROM nation""",
)
def _(spark, d):
    registry = TableRegistry(spark)
    registry.register("nation", f"{d}/nation.parquet")
    tried = ["SELECT count(*) AS n FROM nations_of_old", "SELECT n_name FROM nation WHERE n_nationkey < 0", "SELECT count(*) AS n FROM nation"]
    _, detail = answer(registry, "nation", "How many nations?", tried, query_id=3, planner_prompt="plan it")
    row = spark.createDataFrame([tuple(detail.values())], DETAIL)
    repaired = F.col("last_debug_prompt").contains(EMPTY_ANSWER) & F.col("last_debug_prompt").contains(tried[1])
    kept = ["query_id", "tagged_query_type", "count_of_fixing_errors", "successful_code_execution", "prompt_user_for_planner"]
    return row.select(*kept, "plot_filename", "code_errors", "result_repl_stdout", repaired.alias("repaired"))


@query(
    "answer_batch",
    """SELECT CAST(r_regionkey AS BIGINT) AS query_id, CASE WHEN r_regionkey % 2 = 0 THEN 'plot' ELSE 'general' END AS tagged_query_type,
    '{"n":' || CAST((SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS VARCHAR) || '}' AS result_repl_stdout FROM region""",
)
def _(spark, d):
    registry = TableRegistry(spark)
    registry.register("nation", f"{d}/nation.parquet")
    asked = sql("CASE WHEN r_regionkey % 2 = 0 THEN 'Draw a histogram of the nations' ELSE 'How many nations?' END")
    sheet = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.lit("nation").alias("table_name"), asked.alias("user_query"))
    found = answer_batch(sheet, registry, lambda r: [f"SELECT count(*) AS n FROM nation WHERE n_regionkey = {r['query_id']}"])
    return found.select("query_id", "tagged_query_type", "result_repl_stdout")


@query(
    "prompt_errors",
    """SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'a plot that is saved needs a path' END AS error
    FROM documents""",
)
def _(spark, d):
    sheet = table(spark, d, "documents").select(
        F.col("doc_id").alias("query_id"),
        F.col("source").alias("user_query"),
        sql("CASE WHEN doc_id % 2 = 0 THEN 'plot' ELSE 'general' END").alias("tagged_query_type"),
        sql("CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'a.png' END").alias("plot_filename"),
    )
    return prompts.render_prompts(sheet, None, "coder_only_simple").select("query_id", "error")


@query("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    path = _checkpointed(spark, "csv")
    few = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    tables.write_csv(few, path)
    return tables.read_csv(spark, path, few.schema)


@query("jsonl_round_trip", "SELECT doc_id, text FROM documents")
def _(spark, d):
    path = _checkpointed(spark, "jsonl")
    few = table(spark, d, "documents").select("doc_id", "text")
    tables.write_jsonl(few, path)
    return tables.read_jsonl(spark, path, few.schema)


@query("results_round_trip", "SELECT doc_id AS query_id, source AS plan, 'r1' AS run_id FROM documents")
def _(spark, d):
    path = _checkpointed(spark, "results")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("plan"))
    write_results(rows, path, "r1")
    return spark.read.parquet(path).select("query_id", "plan", "run_id")


@query(
    "report_round_trip",
    """SELECT r_name || ': ' || CAST((SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS VARCHAR) || ' questions' AS value
    FROM region""",
)
def _(spark, d):
    path = _checkpointed(spark, "report")
    counted = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name")
    metrics = counted.agg(F.count("*").alias("n_queries")).select(
        F.col("r_name").alias("cohort"), "n_queries", F.col("n_queries").alias("n_executable"), F.lit(1.0).alias("rate")
    )
    write_report(metrics, path)
    return spark.read.text(path).filter(F.col("value").endswith(" questions"))


# ---- answers scored from rows ----

# by question: what changes in the answer that is given to "the customers" (columns number, balance, name) or their balances
_GIVEN = {
    1: ("k, bal + 0.004, name", "true"),  # all there, in another order
    2: ("k, bal + CASE WHEN k % 500 = 7 THEN 0.5 ELSE 0 END, name", "true"),
    3: ("NULL, bal + 0.0095, NULL", "true"),
    4: ("NULL, bal, NULL", "k % 700 <> 5"),  # some are missing
    5: ("k, NULL, NULL", "k % 3 = 0"),  # a list of numbers of the table
    6: ("k, bal, CASE WHEN k = 11 THEN 'nobody' ELSE name END", "true"),
}
_BARE = (3, 4)  # questions whose correct answer is the balances alone


def _answers(spark, d, given: bool):
    rows = table(spark, d, "customer").selectExpr("c_custkey AS k", "c_acctbal AS bal", "c_name AS name")
    parts = []
    for q, (values, where) in _GIVEN.items():
        kept = rows.filter(where) if given else rows
        k, bal, name = values.split(", ", 2) if given else ("k", "bal", "name")
        if not given and q in _BARE:
            k, name = "NULL", "NULL"
        parts.append(kept.selectExpr(f"{q} AS query_id", f"to_json(named_struct('k', {k}, 'bal', {bal}, 'name', {name})) AS line"))
    if not given:
        parts.append(rows.selectExpr("7 AS query_id", "to_json(named_struct('k', k)) AS line"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _answers_sql(given: bool) -> str:
    parts = []
    for q, (values, where) in _GIVEN.items():
        bare = not given and q in _BARE
        k, bal, name = (values.split(", ", 2)) if given else ("NULL" if bare else "k", "bal", "NULL" if bare else "name")
        source = f"(SELECT c_custkey AS k, c_acctbal AS bal, c_name AS name FROM customer) WHERE {where if given else 'true'}"
        parts += [f"SELECT {q} AS q, CAST({x} AS DOUBLE) AS v, CAST(NULL AS VARCHAR) AS w FROM {source}" for x in (k, bal) if x != "NULL"]
        if name != "NULL":
            parts.append(f"SELECT {q}, NULL, {name} FROM {source}")
    return " UNION ALL ".join(parts + ([] if given else ["SELECT 7, c_custkey, NULL FROM customer"]))


# every stretch of needed numbers is compared with the numbers at hand around it
_SCORE_ROWS = f"""
WITH c AS ({_answers_sql(False)}), g AS ({_answers_sql(True)}),
sides AS (SELECT 0 AS way, q, v, 1 AS need FROM g WHERE v IS NOT NULL UNION ALL SELECT 0, q, v, 0 FROM c WHERE v IS NOT NULL
  UNION ALL SELECT 1, q, v, 1 FROM c WHERE v IS NOT NULL UNION ALL SELECT 1, q, v, 0 FROM g WHERE v IS NOT NULL),
needed AS (SELECT way, q, v, count(*) AS n FROM sides WHERE need = 1 GROUP BY ALL),
held AS (SELECT way, q, v, count(*) AS n FROM sides WHERE need = 0 GROUP BY ALL),
held_up AS (SELECT way, q, v, sum(n) OVER (PARTITION BY way, q ORDER BY v) AS up FROM held),
points AS (
  SELECT n.way, n.q, n.v, sum(n.n) OVER (PARTITION BY n.way, n.q ORDER BY n.v) AS up, n.n,
         coalesce(b.up, 0) AS below, coalesce(a.up, 0) AS reached
  FROM needed n ASOF LEFT JOIN held_up b ON n.way = b.way AND n.q = b.q AND n.v - 0.010000001 > b.v
  ASOF LEFT JOIN held_up a ON n.way = a.way AND n.q = a.q AND n.v + 0.010000001 >= a.v
),
short AS (
  SELECT DISTINCT x.way, x.q FROM points x JOIN points y ON x.way = y.way AND x.q = y.q AND x.v <= y.v
  WHERE y.up - (x.up - x.n) > y.reached - x.below
),
strange AS (SELECT DISTINCT q FROM (SELECT q, w, count(*) AS n FROM g WHERE w IS NOT NULL GROUP BY ALL) a
  LEFT JOIN (SELECT q, w, count(*) AS n FROM c WHERE w IS NOT NULL GROUP BY ALL) b USING (q, w) WHERE a.n > coalesce(b.n, 0)),
sizes AS (SELECT q, count(*) AS n_correct, bool_or(w IS NOT NULL) AS worded FROM c GROUP BY q)
SELECT CAST(q AS INTEGER) AS query_id, n_correct, coalesce((SELECT count(*) FROM g WHERE g.q = s.q), 0) AS n_given,
  CASE WHEN worded THEN CASE WHEN q IN (SELECT q FROM g) AND q NOT IN (SELECT q FROM strange) AND q NOT IN (SELECT q FROM short WHERE way = 0) THEN 1 ELSE 0 END
  ELSE CASE WHEN q NOT IN (SELECT q FROM short WHERE way = 1) THEN 1 ELSE 0 END END AS score
FROM sizes s"""


@query("score_rows", _SCORE_ROWS)
def _(spark, d):
    return row_scores.score_rows(_answers(spark, d, False), _answers(spark, d, True))


# ---- pages with sections inside elements ----

# every paragraph is followed by a section of its own, whose heading lies inside an element
_INNER = '</p><div class="s"><h2>inside</h2><br><p>inner <img src="x"> text</div>'
_FLAT = "'" + "', '".join([*corpus.VOID, *corpus.OPEN_ENDED]) + "'"


@query(
    "doc_examples_nested",
    rf"""WITH s AS (SELECT page_id, string_split(regexp_replace(replace(html, '</p>', '{_INNER}'), '(<[pP][\s>])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM pages),
    f AS (SELECT page_id, parts, coalesce(list_position(list_transform(parts, lambda p: regexp_matches(p, '^<[pP][\s>]')
           AND contains({_PLAIN("string_split(p, '</p>')[1]")}, 'ion ')), true), 0) AS pos FROM s),
    r AS (SELECT page_id, pos, regexp_replace(array_to_string(parts[greatest(pos, 1):], ''), '(?is)^.*?</p>', '') AS rest FROM f),
    t AS (SELECT page_id, i, tags[i] AS p, lower(regexp_extract(tags[i], '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM
      (SELECT page_id, string_split(regexp_replace(rest, '(<[/a-zA-Z])', chr(1) || '\1', 'g'), chr(1)) AS tags FROM r), unnest(range(1, len(tags) + 1)) u(i)),
    k AS (SELECT *, CASE WHEN name = '' OR name IN ({_FLAT}) OR regexp_matches(p, '^<[^>]*/>') THEN 0 WHEN starts_with(p, '</') THEN -1 ELSE 1 END AS step FROM t),
    d AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM k),
    e AS (SELECT page_id, min(i) FILTER (depth = 0 AND (step < 0 OR (step = 1 AND name IN ('footer', 'h2')))) AS stop FROM d GROUP BY page_id),
    g AS (SELECT page_id, coalesce(string_agg(p, '' ORDER BY i), '') AS region FROM d JOIN e USING (page_id) WHERE i < coalesce(stop, i + 1) GROUP BY page_id)
    SELECT page_id, CASE WHEN pos > 0 THEN array_to_string(list_transform(regexp_extract_all(coalesce(region, ''), '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda b: {_PLAIN("b")}), chr(10))
      ELSE 'Examples section not found' END AS examples FROM r LEFT JOIN g USING (page_id)""",
)
def _(spark, d):
    pages = table(spark, d, "pages").withColumn("html", F.replace("html", F.lit("</p>"), F.lit(_INNER)))
    return corpus.doc_examples(pages, heading="ion ", block_tag="p", stop_tags=("footer", "h2"), nested=True).drop("method_name")


# ---- annotations ----

_DESCRIBED = "SELECT n_name AS \"column\", 'lies in region ' || CAST(n_regionkey AS VARCHAR) || ', \"code\" ' || CAST(n_nationkey AS VARCHAR) AS description FROM nation"


def _annotations(spark, d):
    words = F.concat(F.lit("lies in region "), F.col("n_regionkey").cast("string"), F.lit(', "code" '), F.col("n_nationkey").cast("string"))
    return table(spark, d, "nation").select(F.col("n_name").alias("column"), words.alias("description"))


@query("annotations_round_trip", _DESCRIBED)
def _(spark, d):
    path = _checkpointed(spark, "annotations")
    profile.annotation_json(_annotations(spark, d)).write.text(path)
    return tables.load_annotations(spark, path)


@query(
    "annotation_json",
    rf"""SELECT '{{' || string_agg('"' || "column" || '":"' || replace(description, '"', '\"') || '"', ',' ORDER BY "column") || '}}' AS annotation_text
    FROM ({_DESCRIBED})""",
)
def _(spark, d):
    return profile.annotation_json(_annotations(spark, d))


_RATED = "SELECT r_name AS c, count(*) AS n, count(*) FILTER (n_nationkey % 2 = 0) AS ok FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name"


@query(
    "report_lines",
    f"""SELECT c || ': ' || n || ' questions' AS value FROM ({_RATED}) UNION ALL SELECT c || ': ' || ok || ' of them ran' FROM ({_RATED})
    UNION ALL SELECT c || ': share that ran ' || CAST(ok / n AS VARCHAR) FROM ({_RATED}) UNION ALL SELECT '----------'""",
)
def _(spark, d):
    path = _checkpointed(spark, "report")
    runs = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    runs = runs.withColumn("successful_code_execution", F.col("n_nationkey") % 2 == 0)
    names = [r["r_name"] for r in table(spark, d, "region").select("r_name").collect()]  # a handful of cohorts
    write_report(evaluate.executable_rate(runs, "r_name", names), path)
    return spark.read.text(path)
