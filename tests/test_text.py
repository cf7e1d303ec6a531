"""Cleaning rules on single cases, and against Python's own functions on random text."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetwise.functions import text

CODE = [
    # separator tokens instead of a fence
    ("<|im_sep|>python\nx = 1\n<|im_sep|>", "hosted", "x = 1"),
    # two fences are joined
    ("a\n```python\nser.q()\n```\nb\n```python\nser.q(.25)\n```", "hosted", "ser.q()\nser.q(.25)"),
    # no fence: the whole answer is code, unless the model is local
    ("x = 1\ny = 2", "hosted", "x = 1\ny = 2"),
    ("x = 1\ny = 2", "local", ""),
    # tags
    ("[PYTHON]\nx = 1\n[/PYTHON]", "local", "x = 1"),
    # a plain fence counts for local models only
    ("```\nx = 1\n```", "local", "x = 1"),
    # only the first line's indentation goes
    ("```python\n    x = 1\n    y = 2\n```", "hosted", "x = 1\n    y = 2"),
    # loading the table again
    ("```python\ndf = pd.read_csv('x.csv')\nprint(df)\n```", "hosted", "print(df)"),
    # making a table: df is protected, my_df is not
    ("```python\nmy_df = pd.DataFrame(a)\ndf = pd.DataFrame(b)\n```", "local",
     "my_df = pd.DataFrame(a)\n# The dataframe df has already been defined"),
    ("```python\ndf = pd.DataFrame(b)\n```", "hosted", "df = pd.DataFrame(b)"),
    ("```python\ndata=pd.concat(a)\nprint(data, metadata)\n```", "local", "df=pd.concat(a)\nprint(df, metadata)"),
    # showing
    ("```python\nplt.plot()\nplt.show()\n```", "hosted", "plt.plot()"),
    ("```python\n# no `plt.show()` here\n```", "hosted", "# no `plt.show()` here"),
    # forbidden words, also harmless ones
    ("```python\nos.system('x')\ny = 1\n```", "hosted", "# not allowed os.system('x')\ny = 1"),
    ("```python\nthe input is\nos_system\nsystem\n```", "hosted", "# not allowed the input is\n# not allowed os_system\nsystem"),
    ("```python\n```", "hosted", ""),
]


@pytest.mark.parametrize("response, provider, code", CODE)
def test_extract_code(spark, response, provider, code):
    df = spark.createDataFrame([(response,)], "r string")
    assert df.select(text.extract_code("r", provider)).first()[0] == code


def test_extract_keeps_show_when_asked(spark):
    df = spark.createDataFrame([("```python\nplt.show()\n```",)], "r string")
    assert df.select(text.extract_code("r", show_plot=True)).first()[0] == "plt.show()"


@pytest.mark.parametrize(
    "response, kept",
    [
        ("def solve(df):\n    x = 1\n    return x\nprint(2)\n    return y", "def solve(df):\n    x = 1\n    return x"),
        ("```python\nplt.plot(x)\nplt.show( )\nmore", "```python\nplt.plot(x)\nplt.show( )\n```"),
        ("plt.savefig('a.png')  \n\nmore", "plt.savefig('a.png')  \n"),
        ("return early\nx", "return early\nx"),
        ("a\n\n    return 1\nb", "a\n\n    return 1"),
        ("x = plt.show()", "x = plt.show()"),
    ],
)
def test_cut_after_first_end(spark, response, kept):
    df = spark.createDataFrame([(response,)], "r string")
    assert df.select(text.cut_after_first_end("r")).first()[0] == kept


def test_cut_only_for_completion_models(spark):
    df = spark.createDataFrame([("```python\n    return 1\nx = 2\n```",)], "r string")
    full = df.select(text.extract_code("r", "local", model="gpt")).first()[0]
    cut = df.select(text.extract_code("r", "local", model="CodeLlama-7b-Python-hf")).first()[0]
    assert full == "return 1\nx = 2" and cut == "return 1"


@pytest.mark.parametrize(
    "path, stem",
    [("a/b/table.csv", "table"), ("t.tar.gz", "t.tar"), (".hidden", ".hidden"), ("plain", "plain"), ("a.b/c", "c")],
)
def test_file_stem(spark, path, stem):
    assert spark.range(1).select(text.file_stem(F.lit(path))).first()[0] == stem


def test_plot_path_is_repeatable(spark):
    paths = {spark.range(1).select(text.plot_path(F.lit("x/t.csv"), F.lit(7))).first()[0] for _ in range(2)}
    assert len(paths) == 1 and re.fullmatch(r"plots/t7-\d\.png", paths.pop())


@pytest.mark.parametrize("raw, score", [("1", 1), (" 0\n", 0), ("+1", 1), ("1.5", 0), ("yes", 0), ("", 0), (None, 0)])
def test_parse_score(spark, raw, score):
    assert spark.createDataFrame([(raw,)], "s string").select(text.parse_score("s")).first()[0] == score


def test_traceback_without_own_lines(spark):
    row = spark.range(1).select(text.filter_traceback(F.lit("Traceback\n  File x"), F.lit("KeyError"), F.lit("'a'"))).first()
    assert row[0] == "KeyError: 'a'"


def test_fill_leaves_braces_of_values_alone(spark):
    df = spark.createDataFrame([("{b} \\ $1", None)], "a string, b string")
    assert df.select(text.fill("<{a}|{b}>", {"a": "a", "b": "b"})).first()[0] == "<{b} \\ $1|>"


def test_repair_completion(spark):
    rows = [
        ("```python\nx = 1\n```", "P\nx = 1\n```"),
        ("```python\nimport a\ndef solve(df):", "```python\nimport a\ndef solve(df):"),
        ("```python\n\nimport a", "P\n\nimport a"),
        ("def solve(df): 1", "def solve(df): 1"),
    ]
    df = spark.createDataFrame(rows, "a string, e string")
    assert df.filter(text.repair_completion("a", F.lit("P")) != F.col("e")).collect() == []


letters = st.text(alphabet="ab \n\t'\"\\`\x00\u00a0é\u2028😀{}#", max_size=30)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(letters, min_size=20, max_size=20))
def test_against_python(spark, texts):
    def blocks(s):
        s = s if "```python" in s else "```python\n" + s + "\n```"
        return re.findall(r"```python\s*(.*?)\s*```", s, re.DOTALL)

    def quotes(s):
        return s[1:-1] if s and s[0] == s[-1] and s[0] in "'\"" else s

    texts = texts + ["```python " + t + " ```x```python" + t + "```" for t in texts[:5]]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    out = df.select(
        "s",
        text.strip("s").alias("strip"),
        text.lstrip("s").alias("lstrip"),
        text.escape_repr("s").alias("repr"),
        text.strip_quotes("s").alias("quotes"),
        text.fenced_blocks("s").alias("blocks"),
        text.trim_tail("s").alias("tail"),
        text.indent_block("s").alias("indent"),
    )
    for r in out.collect():
        assert r["strip"] == r["s"].strip()
        assert r["lstrip"] == r["s"].lstrip()
        assert r["repr"] == repr(r["s"])
        assert r["quotes"] == quotes(r["s"])
        assert r["blocks"] == blocks(r["s"])
        assert r["tail"] == r["s"][:-4]
        assert r["indent"] == "    " + r["s"].replace("\n", "\n    ")
