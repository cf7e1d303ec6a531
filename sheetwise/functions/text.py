r"""Cleaning of model responses, prompts and snippets, as column expressions.

Nothing here needs a Python worker. Patterns are Java regular expressions;
``(?U)`` gives ``\s``, ``\w`` and ``\b`` their Unicode meaning and ``(?d)``
makes the line feed the only line end, so that a response is cut exactly where
Python's ``re`` would cut it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: texts and word lists the cleaning rules are defined by ----

FENCE = "```"
PYTHON_FENCE = "```python"
SEPARATOR = "<|im_sep|>"
FILL_MARK = "<FILL_ME>"
RESPONSE_MARK = "@@ Response"
TABLE_DEFINED = "# The dataframe df has already been defined"
NOT_ALLOWED = "# not allowed "
IMPORT_LINES = ("import pandas as pd", "import matplotlib.pyplot as plt", "import numpy as np")
REQUIRED_IMPORTS = ("import pandas as pd", "import matplotlib.pyplot as plt")
RESULT_CALL = "result = solve(df)\nprint(result)"
SOLVE_HEADER = "def solve(df):"
SOLVE_CALL = "print(solve(df))"
NO_NAME = "Method name not found"
NO_EXAMPLES = "Examples section not found"

#: names that may not occur in a line of code; a dot stands for any character
FORBIDDEN = (
    "subprocess", "sys", "eval", "exec", "socket", "urllib", "shutil", "pickle", "ctypes", "multiprocessing",
    "tempfile", "glob", "pty", "commands", "cgi", "cgitb", "xml.etree.ElementTree", "builtins", "os.system",
    "os.popen", "sys.modules", "__import__", "getattr", "setattr", "pickle.loads", "execfile", "compile", "input",
    "ast.literal_eval",
)

#: characters that count as white space at the ends of a text
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ---- end of fixed values ----


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(c: Column | str, fn: Callable[[Column], Column]) -> Column:
    """Apply ``fn``, which uses its input several times, computing the input once.

    A plain column (given by name) needs no care. An expression is bound to a
    lambda variable, so that a chain of such functions does not evaluate its
    first steps again and again.
    """
    if isinstance(c, str):
        return fn(F.col(c))
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def _ascii(c: Column) -> Column:
    """Whether a text is plain ASCII, for which the cheaper ASCII classes do."""
    return F.octet_length(c) == F.length(c)


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def strip(c: Column | str) -> Column:
    """Remove white space, line ends included, from both ends."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(_col(c), F.lit(WHITE_SPACE))


def normalise_separator(c: Column | str) -> Column:
    """Chat separators become code fences."""
    return _swap(_col(c), SEPARATOR, FENCE)


_END = r"(?:^\s{4,}return\s+.*$|^\s*(?:plt\.show\(\s*\)|plt\.savefig\(\s*.+\s*\))\s*$)"


def cut_after_first_end(c: Column | str) -> Column:
    """Keep the text up to the first line that returns, shows or saves.

    The return line must be indented. If the kept part holds a fence, it is
    closed again.
    """

    def cut(c: Column) -> Column:
        kept = F.regexp_extract(c, rf"(?Umd)\A([\s\S]*?{_END})", 1)
        return _once(
            kept,
            lambda k: F.when(k == "", c).when(k.contains(FENCE), F.concat(k, F.lit("\n" + FENCE))).otherwise(k),
        )

    # a plain search first: most texts are spared the pattern
    return _once(c, lambda x: F.when(any_of(x, ("return", "plt.show(", "plt.savefig(")), cut(x)).otherwise(x))


def fenced_blocks(c: Column | str, lang_required: bool = True) -> Column:
    """All fenced code blocks as an array.

    With ``lang_required`` only python fences count, and a text without any
    is taken to be code as a whole. Otherwise any fence counts. If nothing is
    found, ``[PYTHON]`` tags are tried.
    """

    def wrapped(c: Column) -> Column:
        whole = F.concat(F.lit(PYTHON_FENCE + "\n"), c, F.lit("\n" + FENCE))
        return F.when(c.contains(PYTHON_FENCE), c).otherwise(whole)

    # the text between two fences is taken whole and trimmed after: the engine
    # then looks for the closing fence alone, not for white space before it
    def body(block: Column) -> Column:
        bare = F.when(block.startswith("python"), lstrip(F.substr(block, F.lit(7)))).otherwise(block)
        return F.rtrim(bare, F.lit(WHITE_SPACE))

    def found(c: Column) -> Column:
        if lang_required:
            blocks = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)```python(.*?)```"), 1), strip)
        else:
            blocks = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)```(.*?)```"), 1), body)
        tagged = F.regexp_extract_all(c, F.lit(r"(?s)\[PYTHON\](.*?)\[/PYTHON\]"), 1)
        return _once(blocks, lambda x: F.when(F.size(x) > 0, x).otherwise(tagged))

    return _once(_once(c, wrapped) if lang_required else c, found)


def dedent(block: Column | str) -> Column:
    """Remove the white space that all non-empty lines of a block start with."""

    def cut(lines: Column) -> Column:
        # blank lines have no depth, and array_min passes over missing values
        depths = F.transform(lines, lambda x: F.when(lstrip(x) != "", F.length(x) - F.length(lstrip(x))))
        return _once(
            F.coalesce(F.array_min(depths), F.lit(0)),
            lambda depth: F.array_join(F.transform(lines, lambda x: F.substr(x, depth + 1)), "\n"),
        )

    return _once(F.split(_col(block), "\n"), cut)


def join_blocks(blocks: Column) -> Column:
    """Trim every block and put them below one another.

    A trimmed block starts at column zero, so there is no common indentation
    left that ``dedent`` could remove.
    """
    return lstrip(F.array_join(F.transform(blocks, strip), "\n"))


def strip_table_reload(c: Column | str) -> Column:
    """Delete a call that reads the table from a file again."""

    def drop(c: Column) -> Column:
        return F.when(c.contains("pd.read_csv("), F.regexp_replace(c, r"(?Ud)df\s*=\s*pd\.read_csv\((.*?)\)", "")).otherwise(c)

    return _once(c, drop)


def protect_table_name(c: Column | str) -> Column:
    """Keep code from making its own table: ``data`` is renamed, a new ``df`` is commented out."""
    renamed = _once(c, lambda x: F.when(x.contains("data=pd."), F.regexp_replace(x, r"(?U)\bdata\b", "df")).otherwise(x))
    pattern = r"(?Ud)(?<![a-zA-Z0-9_-])df\s*=\s*pd\.DataFrame\((.*?)\)"
    return _once(
        renamed, lambda x: F.when(x.contains("pd.DataFrame("), F.regexp_replace(x, pattern, TABLE_DEFINED)).otherwise(x)
    )


def drop_interactive_show(c: Column | str) -> Column:
    """Remove every ``plt.show()`` if one of them stands outside backticks."""

    def drop(c: Column) -> Column:
        bare = c.contains("plt.show()") & c.rlike(r"(?<!`)plt\.show\(\)(?!`)")
        return F.when(bare, _swap(c, "plt.show()", "")).otherwise(c)

    return _once(c, drop)


def _one_of(words: Sequence[str]) -> str:
    """A pattern for any of the words; words with the same first letter share a branch."""
    firsts = sorted({w[0] for w in words})
    return "|".join(f"{a}(?:{'|'.join(w[1:] for w in words if w[0] == a)})" for a in firsts)


def comment_forbidden(c: Column | str) -> Column:
    """Comment out each line that holds a forbidden name as a whole word.

    Texts without such a name, usually nearly all, are searched once and left.
    """
    word = rf"(?U)\b(?:{_one_of(FORBIDDEN)})\b"

    def mark(line: Column) -> Column:
        return F.when(line.rlike(word), F.concat(F.lit(NOT_ALLOWED), line)).otherwise(line)

    def marked(c: Column) -> Column:
        lines = F.array_join(F.transform(F.split(c, "\n"), mark), "\n")
        return F.when(c.rlike(word), lines).otherwise(c)

    return _once(c, marked)


def extract_code(
    c: Column | str, provider: str = "hosted", show_plot: bool = False, model: str = "", strategy: str = ""
) -> Column:
    """The whole cleaning chain from a raw response to code.

    ``provider="local"`` accepts any fence and protects the table name. Text
    is cut after its first end only for plain completion models.
    """
    c = normalise_separator(c)
    if "Python-hf" in model or ("Magicoder" in model and strategy == "coder_only_completion_functions"):
        c = cut_after_first_end(c)
    local = provider == "local"
    c = strip_table_reload(join_blocks(fenced_blocks(c, lang_required=not local)))
    if local:
        c = protect_table_name(c)
    if not show_plot:
        c = drop_interactive_show(c)
    return strip(comment_forbidden(c))


def prepend_imports(c: Column | str) -> Column:
    """Add the import block unless the required imports are all there."""

    def add(c: Column) -> Column:
        ready = F.lit(True)
        for line in REQUIRED_IMPORTS:
            ready = ready & c.contains(line)
        return F.when(ready, c).otherwise(F.concat(F.lit("\n".join(IMPORT_LINES) + "\n\n"), c))

    return _once(c, add)


def append_result_call(c: Column | str) -> Column:
    return F.concat(_col(c), F.lit("\n\n" + RESULT_CALL))


def remove_result_call(c: Column | str) -> Column:
    return _swap(_col(c), RESULT_CALL, "")


def wrap_code(c: Column | str, strategy: str) -> Column:
    """Imports first and, for function strategies, the call that prints the result."""
    wrapped = prepend_imports(c)
    return append_result_call(wrapped) if strategy.endswith("functions") else wrapped


def filter_traceback(trace: Column | str, kind: Column | str, message: Column | str) -> Column:
    """Lines of a traceback that come from the generated code, then the error itself."""
    lines = F.filter(F.split(_col(trace), "\n"), lambda x: x.contains("<string>"))
    error = F.concat(_col(kind), F.lit(": "), _col(message))
    return F.array_join(F.concat(lines, F.array(error)), "\n")


def number_errors(errors: Column | str) -> Column:
    """An array of messages as numbered, quoted lines."""
    quoted = F.transform(_col(errors), lambda x, i: F.concat(i.cast("string"), F.lit('. "'), x, F.lit('"')))
    return F.array_join(quoted, "\n")


def strip_instruction(c: Column | str) -> Column:
    """Drop the instruction block of an answer that repeats its prompt."""
    return F.regexp_replace(_col(c), r"(?s)\[INST\].*?\[/INST\]", "")


def after_response_mark(c: Column | str) -> Column:
    """The text behind the first response mark, trimmed; NULL without one."""
    return strip(F.get(F.split(_col(c), RESPONSE_MARK), F.lit(1)))


def assemble_infill(prompt: Column | str, decoded: Column | str) -> Column:
    """Put the generated middle between the two halves of an infilling prompt.

    ``decoded`` starts with both halves; what follows is the middle.
    """
    halves = F.split(_col(prompt), FILL_MARK)
    before, after = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    middle = F.substr(_col(decoded), F.length(before) + F.length(after) + 1)
    return F.concat(before, middle, after)


def repair_completion(answer: Column | str, initial_prompt: Column | str) -> Column:
    """Make a repaired completion whole.

    Fences are dropped when the answer opens one but goes on with neither an
    import nor the function; without the function the prompt goes in front.
    """
    answer = _col(answer)
    stray = r"(?U)\A\n?```python\s+(?!import|def\s+solve)"
    bare = F.when(answer.rlike(stray), _swap(answer, PYTHON_FENCE, "")).otherwise(answer)
    return F.when(bare.contains("def solve"), bare).otherwise(F.concat(_col(initial_prompt), bare))


def body_after_solve(c: Column | str) -> Column:
    """The body of ``solve`` as a fenced completion, without lines that call it."""
    lines = F.split(_col(c), "\n")
    is_header = F.transform(lines, lambda x: F.startswith(strip(x), F.lit(SOLVE_HEADER)))
    at = F.array_position(is_header, F.lit(True)).cast("int")
    body = F.filter(F.slice(lines, at + 1, F.size(lines)), lambda x: ~x.contains(SOLVE_CALL))
    return F.concat(F.lit(f"{PYTHON_FENCE}\n{SOLVE_HEADER}\n"), F.array_join(body, "\n"), F.lit("\n" + FENCE))


_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def escape_repr(c: Column | str) -> Column:
    """The text as a quoted literal with escapes, the way Python's ``repr`` writes it."""
    c = _col(c)
    double = c.contains("'") & ~c.contains('"')
    body = _swap(c, "\\", "\\\\")
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = _swap(body, raw, escaped)
    body = F.when(double, body).otherwise(_swap(body, "'", "\\'"))

    def shown(x: Column) -> Column:
        code = F.ascii(x)
        digits = F.lower(F.hex(code))
        written = (
            F.when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
            .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
        )
        return F.when(x.rlike(_UNPRINTABLE), written).otherwise(x)

    odd = body.rlike("[^ -~]") & body.rlike(_UNPRINTABLE)
    body = F.when(odd, F.array_join(F.transform(F.split(body, ""), shown), "")).otherwise(body)
    quote = F.when(double, F.lit('"')).otherwise(F.lit("'"))
    return F.concat(quote, body, quote)


def strip_quotes(c: Column | str) -> Column:
    """Remove one pair of equal quotes around the text."""
    c = _col(c)
    first, last = F.left(c, F.lit(1)), F.right(c, F.lit(1))
    quoted = (first == last) & first.isin("'", '"')
    return F.when(quoted, F.substr(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))).otherwise(c)


def strip_leading_newline(c: Column | str) -> Column:
    """Remove an escaped line feed (backslash, n) at the start."""
    c = _col(c)
    return F.when(c.startswith("\\n"), F.substr(c, F.lit(3))).otherwise(c)


def clean_method_name(c: Column | str, cut: bool = False) -> Column:
    """Remove ``#`` signs, or with ``cut`` everything from the first one on."""
    c = _col(c)
    return F.substring_index(c, "#", 1) if cut else _swap(c, "#", "")


def file_stem(path: Column | str) -> Column:
    """File name without folder and last extension."""
    base = F.regexp_extract(_col(path), r"([^/]*)$", 1)
    return F.regexp_replace(base, r"^(\.*[^.].*)\.[^.]*$", "$1")


def plot_path(table: Column | str, index: Column | str, folder: str = "plots/") -> Column:
    """Plot file of a question; the digit is derived from the row, so runs repeat it."""
    index = _col(index).cast("string")
    name = F.concat(file_stem(table), index)
    digit = F.pmod(F.conv(F.substr(F.md5(name), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(10))
    return F.concat(F.lit(folder), name, F.lit("-"), digit.cast("string"), F.lit(".png"))


def parse_score(c: Column | str) -> Column:
    """A judged score as an integer, 0 when the text is not one."""
    text = strip(c)
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.coalesce(number, F.lit(0))


def year_month(c: Column | str) -> Column:
    """Year and month as the number yyyymm."""
    return F.date_format(_col(c), "yyyyMM").cast("int")


def indent_block(c: Column | str, first: bool = True) -> Column:
    """Indent every line by four spaces; ``first=False`` leaves the first line."""
    tab = "    "
    moved = _swap(_col(c), "\n", "\n" + tab)
    return F.concat(F.lit(tab), moved) if first else moved


def trim_tail(c: Column | str, n: int = 4) -> Column:
    """The text without its last ``n`` characters."""
    c = _col(c)
    return F.substr(c, F.lit(1), F.greatest(F.length(c) - n, F.lit(0)))


def close_fence(c: Column | str) -> Column:
    return F.concat(_col(c), F.lit("\n" + FENCE))


def token_count(c: Column | str) -> Column:
    """Estimated tokens: runs of word characters and single other marks."""
    c = _col(c)
    plain, wide = F.lit(r"\w+|[^\w\s]"), F.lit(r"(?U)\w+|[^\w\s]")
    return F.when(_ascii(c), F.regexp_count(c, plain)).otherwise(F.regexp_count(c, wide))


def strip_tags(html: Column | str) -> Column:
    """Plain text of an HTML fragment: tags removed, common entities decoded."""
    text = F.regexp_replace(_col(html), r"<[^>]*>", "")
    return decode_entities(text)


def decode_entities(c: Column | str) -> Column:
    """Decode the entities of markup characters; ``&amp;`` last."""
    c = _col(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = _swap(c, entity, char)
    return c


def fill(template: str, values: dict[str, Column | str]) -> Column:
    """Fill ``{name}`` places of a template with columns, in one pass.

    The template is cut at its places, so braces inside the values are plain
    text and are never filled again.
    """
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        else:
            parts.append(F.coalesce(_col(values[piece]).cast("string"), F.lit("")))
    return F.concat(*parts)


def any_of(c: Column, words: Sequence[str]) -> Column:
    """Whether the text contains one of the words."""
    found = F.lit(False)
    for word in words:
        found = found | c.contains(word)
    return found
