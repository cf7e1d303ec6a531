"""Response cleaning.

The given texts hold no code, so each document is put into a response first.
The responses are built by expressions that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.functions import text
from sheetwise.plans.registry import query, rounded, sql, table

NL = "chr(10)"
TICKS = "'```'"


def cat(*parts: str) -> str:
    return " || ".join(parts)


# a response in one of five shapes
RESPONSE = f"""CASE doc_id % 5
  WHEN 0 THEN {cat("'Sure: '", NL, TICKS, "'python'", NL, "'import sys'", NL, "'df = pd.read_csv(x)'", NL, "text", NL, "'plt.show()'", NL, TICKS, NL, "'Done.'")}
  WHEN 1 THEN {cat("text", NL, "'df=pd.read_csv(name) '", NL, "'y = input()'")}
  WHEN 2 THEN {cat("'[PYTHON]'", NL, "'data=pd.concat(data) '", "text", NL, "'[/PYTHON]'")}
  WHEN 3 THEN {cat(TICKS, "'python'", NL, "'def solve(df):'", NL, "'    return df'", NL, TICKS, NL, "'and '", NL, TICKS, "'python '", "text", NL, "'    my_df = pd.DataFrame(a)'", NL, "' df = pd.DataFrame(b)'", NL, TICKS)}
  ELSE {cat(TICKS, NL, "'os.system(a)'", NL, "text", NL, "'`plt.show()`'", NL, TICKS)} END"""


def responses(spark, d):
    return table(spark, d, "documents").select("doc_id", sql(RESPONSE).alias("response"))


R = f"(SELECT doc_id, {RESPONSE} AS response FROM documents)"


@query("norm_sep", "SELECT doc_id, replace(replace(text, ' the ', '<|im_sep|>'), '<|im_sep|>', '```') AS code FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    marked = F.replace(F.col("text"), F.lit(" the "), F.lit("<|im_sep|>"))
    return docs.select("doc_id", text.normalise_separator(marked).alias("code"))


_ENDED = f"""CASE doc_id % 4
  WHEN 0 THEN {cat("'def solve(df):'", NL, "text", NL, "'    return df.head(3)'", NL, "'print(1)'", NL, "text")}
  WHEN 1 THEN {cat(TICKS, "'python'", NL, "text", NL, "'  plt.show( )'", NL, "'print(2)'", NL, TICKS)}
  WHEN 2 THEN {cat("text", NL, "'return early'", NL, "'plt.savefig(name)'", NL, "'x'")}
  ELSE text END"""

_CUT = r"regexp_extract(chr(10) || r, '^((?s:.*?)\n(?:\s{4,}return\s+[^\n]*|\s*(?:plt\.show\(\s*\)|plt\.savefig\(\s*[^\n]+\s*\))))(?:\n|$)', 1)"


@query(
    "cut_end",
    f"""SELECT doc_id, CASE WHEN m = '' THEN r WHEN contains(m, {TICKS}) THEN m || {NL} || {TICKS} ELSE m END AS code
    FROM (SELECT doc_id, r, substr({_CUT}, 2) AS m FROM (SELECT doc_id, {_ENDED} AS r FROM documents))""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", sql(_ENDED).alias("r"))
    return docs.select("doc_id", text.cut_after_first_end("r").alias("code"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(8203 - 8)"


def _blocks_sql(local: bool) -> str:
    if local:
        source, pattern = "response", r"(?s)```(?:python\s*)?(.*?)\s*```"
    else:
        source = f"CASE WHEN contains(response, '```python') THEN response ELSE '```python' || {NL} || response || {NL} || {TICKS} END"
        pattern = r"(?s)```python\s*(.*?)\s*```"
    return rf"""(SELECT doc_id, CASE WHEN len(regexp_extract_all(s, '{pattern}', 1)) > 0
      THEN regexp_extract_all(s, '{pattern}', 1)
      ELSE regexp_extract_all(s, '(?s)\[PYTHON\](.*?)\[/PYTHON\]', 1) END AS blocks
      FROM (SELECT doc_id, {source} AS s FROM {R}))"""


def _shown(blocks):
    return F.array_join(blocks, "\n----\n")


for _name, _local in (("fenced_blocks", False), ("fenced_blocks_local", True)):

    def _fenced(spark, d, local=_local):
        found = responses(spark, d).select("doc_id", text.fenced_blocks("response", not local).alias("blocks"))
        return found.select("doc_id", F.size("blocks").alias("n"), _shown(F.col("blocks")).alias("blocks"))

    query(
        _name,
        f"""SELECT doc_id, CAST(len(blocks) AS INTEGER) AS n,
        array_to_string(blocks, {NL} || '----' || {NL}) AS blocks FROM {_blocks_sql(_local)}""",
    )(_fenced)


_INDENTED = f"{cat("'    '", f"replace(text, {NL}, {NL} || '      ')", NL, "'   '", NL, "'     end'")}"


@query(
    "dedent",
    rf"""WITH l AS (SELECT doc_id, string_split({_INDENTED}, {NL}) AS lines FROM documents),
    m AS (SELECT doc_id, lines, list_min(list_transform(list_filter(lines, lambda x: regexp_matches(x, '\S')),
          lambda x: length(regexp_extract(x, '^(\s*)', 1)))) AS depth FROM l)
    SELECT doc_id, array_to_string(list_transform(lines, lambda x: substr(x, coalesce(depth, 0) + 1)), {NL}) AS code FROM m""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", sql(_INDENTED).alias("block"))
    return docs.select("doc_id", text.dedent("block").alias("code"))


@query(
    "strip_reload",
    rf"SELECT doc_id, regexp_replace(response, 'df\s*=\s*pd\.read_csv\([^\n]*?\)', '', 'g') AS code FROM {R}",
)
def _(spark, d):
    return responses(spark, d).select("doc_id", text.strip_table_reload("response").alias("code"))


_PROTECT = r"""regexp_replace(CASE WHEN contains({0}, 'data=pd.') THEN regexp_replace({0}, '\bdata\b', 'df', 'g') ELSE {0} END,
  '(^|[^a-zA-Z0-9_-])df\s*=\s*pd\.DataFrame\([^\n]*?\)', '\1# The dataframe df has already been defined', 'g')"""


@query("protect_df", f"SELECT doc_id, {_PROTECT.format('response')} AS code FROM {R}")
def _(spark, d):
    return responses(spark, d).select("doc_id", text.protect_table_name("response").alias("code"))


_DROP_SHOW = r"CASE WHEN regexp_matches({0}, '(^|[^`])plt\.show\(\)([^`]|$)') THEN replace({0}, 'plt.show()', '') ELSE {0} END"


@query("drop_show", f"SELECT doc_id, {_DROP_SHOW.format('response')} AS code FROM {R}")
def _(spark, d):
    return responses(spark, d).select("doc_id", text.drop_interactive_show("response").alias("code"))


_FORBID = rf"""array_to_string(list_transform(string_split({{0}}, {NL}), lambda x:
  CASE WHEN regexp_matches(x, '\b({"|".join(text.FORBIDDEN)})\b') THEN '# not allowed ' || x ELSE x END), {NL})"""


@query("comment_forbidden", f"SELECT doc_id, {_FORBID.format('response')} AS code FROM {R}")
def _(spark, d):
    return responses(spark, d).select("doc_id", text.comment_forbidden("response").alias("code"))


def _extract_sql(local: bool) -> str:
    joined = f"ltrim(array_to_string(list_transform(blocks, lambda b: trim(b, w)), {NL}), w)"
    step = rf"regexp_replace({joined}, 'df\s*=\s*pd\.read_csv\([^\n]*?\)', '', 'g')"
    out = f"SELECT doc_id, w, {step} AS a FROM (SELECT *, {_SPACE} AS w FROM {_blocks_sql(local)})"
    if local:
        out = f"SELECT doc_id, w, {_PROTECT.format('a')} AS a FROM ({out})"
    out = f"SELECT doc_id, w, {_DROP_SHOW.format('a')} AS a FROM ({out})"
    return f"SELECT doc_id, trim({_FORBID.format('a')}, w) AS code FROM ({out})"


@query("extract_code", _extract_sql(False))
def _(spark, d):
    return responses(spark, d).select("doc_id", text.extract_code("response").alias("code"))


@query("extract_code_local", _extract_sql(True))
def _(spark, d):
    return responses(spark, d).select("doc_id", text.extract_code("response", provider="local").alias("code"))


_SCRIPT = f"""CASE WHEN doc_id % 3 = 0 THEN {cat("'import pandas as pd'", NL, "'import matplotlib.pyplot as plt'", NL, "text")} ELSE text END"""
_IMPORTS = cat("'import pandas as pd'", NL, "'import matplotlib.pyplot as plt'", NL, "'import numpy as np'", NL, NL)
_CALL = cat("'result = solve(df)'", NL, "'print(result)'")


@query(
    "wrap_code",
    f"""SELECT doc_id, wrapped, replace(wrapped, {_CALL}, '') AS unwrapped FROM
    (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN s ELSE {_IMPORTS} || s END || {cat(NL, NL, _CALL)} AS wrapped
     FROM (SELECT doc_id, {_SCRIPT} AS s FROM documents))""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", sql(_SCRIPT).alias("s"))
    wrapped = docs.select("doc_id", text.wrap_code("s", "coder_only_functions").alias("wrapped"))
    return wrapped.withColumn("unwrapped", text.remove_result_call("wrapped"))


_TRACE = cat("'Traceback:'", NL, "'  File \"agent.py\", line 124'", NL, "'  File \"<string>\", line 3, in <module>'", NL, "text", NL, "'  File \"<string>\", line 9, in solve'")


@query(
    "filter_traceback",
    f"""SELECT doc_id, array_to_string(list_append(list_filter(string_split({_TRACE}, {NL}), lambda x: contains(x, '<string>')),
    'KeyError: ' || source), {NL}) AS error FROM documents""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", sql(_TRACE).alias("trace"))
    return docs.select("doc_id", text.filter_traceback("trace", F.lit("KeyError"), "source").alias("error"))


@query(
    "number_errors",
    f"""SELECT doc_id, array_to_string(list_transform(string_split(text, {NL}), lambda x, i: CAST(i - 1 AS VARCHAR) || '. "' || x || '"'), {NL}) AS errors
    FROM documents""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.number_errors(F.split("text", "\n")).alias("errors"))


_ECHO = cat("'[INST] question'", NL, "text", "'[/INST] answer @@ Response '", NL, "text", "' @@ Response again'")


@query(
    "strip_inst",
    rf"""SELECT doc_id, regexp_replace(r, '(?s)\[INST\].*?\[/INST\]', '', 'g') AS no_instruction,
    trim(string_split(r, '@@ Response')[2], {_SPACE}) AS response FROM (SELECT doc_id, {_ECHO} AS r FROM documents)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", sql(_ECHO).alias("r"))
    return docs.select(
        "doc_id", text.strip_instruction("r").alias("no_instruction"), text.after_response_mark("r").alias("response")
    )


@query(
    "assemble_infill",
    """SELECT doc_id, 'def solve(df): ' || lang || text || ' return ' || source AS code FROM documents""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    prompt = F.concat(F.lit("def solve(df): "), "lang", F.lit("<FILL_ME> return "), "source")
    decoded = F.concat(F.lit("def solve(df): "), "lang", F.lit(" return "), "source", "text")
    return docs.select("doc_id", text.assemble_infill(prompt, decoded).alias("code"))


_REPAIR = f"""CASE doc_id % 4 WHEN 0 THEN {cat(TICKS, "'python'", NL, "text")} WHEN 1 THEN {cat(TICKS, "'python'", NL, "'import x'", NL, "text")}
  WHEN 2 THEN {cat(TICKS, "'python'", NL, "'def solve(df):'", NL, "text")} ELSE text END"""


@query(
    "repair_completion",
    rf"""SELECT doc_id, CASE WHEN contains(b, 'def solve') THEN b ELSE 'PROMPT ' || lang || b END AS code FROM
    (SELECT doc_id, lang, CASE WHEN regexp_matches(r, '^\n?```python\s') AND NOT regexp_matches(r, '^\n?```python\s(import|def\s+solve)')
     THEN replace(r, '```python', '') ELSE r END AS b FROM (SELECT doc_id, lang, {_REPAIR} AS r FROM documents))""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", sql(_REPAIR).alias("r"))
    return docs.select("doc_id", text.repair_completion("r", F.concat(F.lit("PROMPT "), "lang")).alias("code"))


_BODY = f"""CASE WHEN doc_id % 3 = 0 THEN text ELSE {cat("'import x'", NL, "'  def solve(df): # go'", NL, "text", NL, "'def solve(df):'", NL, "'  print(solve(df)) '", NL, "'tail'")} END"""


@query(
    "body_after_solve",
    rf"""WITH l AS (SELECT doc_id, string_split({_BODY}, {NL}) AS lines FROM documents),
    p AS (SELECT doc_id, lines, coalesce(list_position(list_transform(lines, lambda x: starts_with(ltrim(x), 'def solve(df):')), true), 0) AS pos FROM l)
    SELECT doc_id, {cat(TICKS, "'python'", NL, "'def solve(df):'", NL)} || array_to_string(
      list_filter(lines[pos + 1:], lambda x: NOT contains(x, 'print(solve(df))')), {NL}) || {NL} || {TICKS} AS code FROM p""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", sql(_BODY).alias("s"))
    return docs.select("doc_id", text.body_after_solve("s").alias("code"))


_QUOTED = """CASE doc_id % 4 WHEN 0 THEN '"' || text || '"' WHEN 1 THEN chr(39) || text || chr(39) WHEN 2 THEN '"' || text || chr(39)
  ELSE chr(92) || 'n' || text END"""


@query(
    "strip_quotes",
    f"""SELECT doc_id, CASE WHEN left(q, 1) = right(q, 1) AND left(q, 1) IN (chr(39), '"') THEN substr(q, 2, length(q) - 2) ELSE q END AS inner_text,
    CASE WHEN starts_with(q, chr(92) || 'n') THEN substr(q, 3) ELSE q END AS no_newline
    FROM (SELECT doc_id, {_QUOTED} AS q FROM documents)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", sql(_QUOTED).alias("q"))
    return docs.select(
        "doc_id", text.strip_quotes("q").alias("inner_text"), text.strip_leading_newline("q").alias("no_newline")
    )


_ESC = """replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't'), {0}, {1})"""


@query(
    "escape_repr",
    f"""SELECT doc_id, CASE WHEN contains(text, chr(39)) AND NOT contains(text, '"') THEN '"' || {_ESC.format("''", "''")} || '"'
    ELSE chr(39) || {_ESC.format("chr(39)", "chr(92) || chr(39)")} || chr(39) END AS written FROM documents""",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.escape_repr("text").alias("written"))


@query(
    "method_name",
    "SELECT page_id, replace(url, '#', '') AS no_mark, string_split(url, '#')[1] AS before_mark FROM pages",
)
def _(spark, d):
    pages = table(spark, d, "pages")
    return pages.select(
        "page_id",
        text.clean_method_name("url").alias("no_mark"),
        text.clean_method_name("url", cut=True).alias("before_mark"),
    )


_FILE = "source || '/' || lang || '.part' || CAST(doc_id % 3 AS VARCHAR) || '.csv'"
_STEM = "lang || '.part' || CAST(doc_id % 3 AS VARCHAR)"


@query(
    "plot_path",
    f"""SELECT doc_id, s AS stem, 'plots/' || s || doc_id || '-' ||
    CAST(CAST('0x' || substr(md5(s || doc_id), 1, 8) AS BIGINT) % 10 AS VARCHAR) || '.png' AS path
    FROM (SELECT doc_id, {_STEM} AS s FROM documents)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", sql("source || '/' || lang || '.part' || CAST(doc_id % 3 AS STRING) || '.csv'").alias("file")
    )
    return docs.select("doc_id", text.file_stem("file").alias("stem"), text.plot_path("file", "doc_id").alias("path"))


_SCORE = "CASE doc_id % 4 WHEN 0 THEN ' 1 ' WHEN 1 THEN '1.5' WHEN 2 THEN source ELSE '-7' END"


@query("parse_score", "SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 3 THEN -7 ELSE 0 END AS INTEGER) AS score FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", sql(_SCORE).alias("s"))
    return docs.select("doc_id", text.parse_score("s").alias("score"))


@query(
    "year_month",
    """SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS year_month, CAST(o_orderdate AS DATE) + 30 AS due,
    round(o_totalprice / 7, 2) AS weekly FROM orders""",
)
def _(spark, d):
    return rounded(
        table(spark, d, "orders").select(
            "o_orderkey",
            text.year_month("o_orderdate").alias("year_month"),
            F.date_add(F.col("o_orderdate").cast("date"), 30).alias("due"),
            (F.col("o_totalprice") / 7).alias("weekly"),
        ),
        2,
        "weekly",
    )


@query(
    "indent_block",
    f"SELECT doc_id, '    ' || replace(text, {NL}, {NL} || '    ') AS a, replace(text, {NL}, {NL} || '    ') AS b FROM documents",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.indent_block("text").alias("a"), text.indent_block("text", False).alias("b"))


@query(
    "trim_tail",
    f"SELECT doc_id, substr(text, 1, length(text) - 4) AS input, text || {NL} || {TICKS} AS output FROM documents",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.trim_tail("text").alias("input"), text.close_fence("text").alias("output"))
