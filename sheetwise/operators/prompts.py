"""Prompts for a whole table of questions at once.

A prompt is a template filled with columns, so building a billion prompts is a
projection after the join of each question with its table's profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import text
from sheetwise.operators.joins import attach_table
from sheetwise.sources.tables import write_jsonl

STRATEGIES = (
    "simple",
    "functions",
    "coder_only_simple",
    "coder_only_functions",
    "coder_only_infilling_functions",
    "coder_only_completion_functions",
)
MODES = ("general", "plot_show", "plot_save")

_TABLE = "{head}\n{columns}\n{annotation}\n"

_PLAN_GOAL = {
    "general": "Do not plan any drawing. The last step prints the result.",
    "plot_show": "The last step shows the plot on the screen.",
    "plot_save": "The last step saves the plot to '{plot}'; nothing is shown on the screen.",
}

_CODE_GOAL = {
    "general": "Print the final result.",
    "plot_show": "End with plt.show().",
    "plot_save": "Save the plot with plt.savefig('{plot}') and do not show it.",
}

_FUNCTION_GOAL = {
    "general": "The function returns the result.",
    "plot_show": "The function ends with plt.show().",
    "plot_save": "The function saves the plot with plt.savefig('{plot}') and shows nothing.",
}

_DOC_END = {"general": "return result", "plot_show": "plt.show()", "plot_save": "plt.savefig('{plot}')"}


def plan_template(strategy: str, mode: str) -> str:
    """Template of a planning prompt; only strategies with a plan have one."""
    _known(strategy, mode)
    if strategy.startswith("coder_only"):
        raise ValueError(f"strategy {strategy!r} goes straight to code and has no planning prompt")
    lines = [
        "A user asks about a table: '{question}'",
        "The table is a pandas DataFrame called `df`, already loaded.",
        _TABLE,
        "List at most six short steps, in plain English, that lead to the answer.",
        "Name the columns each step needs. Write no code.",
        _PLAN_GOAL[mode],
    ]
    if strategy == "functions":
        lines.append("State which value, and of which type, the function made from these steps returns.")
    return "\n".join(lines) + "\n"


def code_template(strategy: str, mode: str) -> str:
    """Template of a prompt that asks for code."""
    _known(strategy, mode)
    if strategy.endswith(("infilling_functions", "completion_functions")):
        return _docstring_template(mode, infill="infilling" in strategy)
    function = strategy.endswith("functions")
    lines = ["A user asks about a table: '{question}'", "The table is a pandas DataFrame called `df`, already loaded."]
    lines.append(_TABLE)
    if not strategy.startswith("coder_only"):
        lines += ["Work through these steps one after the other:", "{plan}", ""]
    lines.append("pandas is imported as pd, numpy as np and matplotlib.pyplot as plt.")
    if function:
        lines += ["Define `def solve(df):` and do not call it.", _FUNCTION_GOAL[mode]]
    else:
        lines += ["Write only Python code.", _CODE_GOAL[mode]]
    lines.append("Put the code between ```python and ```.")
    return "\n".join(lines) + "\n"


def _docstring_template(mode: str, infill: bool) -> str:
    """Code that stops inside ``solve``; the table is described in its docstring."""
    head = "\n".join([text.PYTHON_FENCE, *text.IMPORT_LINES, "", "", "def solve(df: pd.DataFrame):"])
    doc = '\n    """ Answers the question: \'{question}\'.\n\n{head}\n{columns}\n    {annotation}\n\n    ' + _FUNCTION_GOAL[mode] + '\n    """\n    '
    if infill:
        return head + doc + text.FILL_MARK + "\n    " + _DOC_END[mode] + "\n" + text.FENCE + "\n"
    return head + doc


_DEBUG = {
    "basic": (
        "This Python code was written to answer '{question}' and fails.\n"
        "The DataFrame `df` is already loaded.\n" + _TABLE + "```python\n{code}\n```\n"
        'It stops with: "{error}"\n'
        "Return the whole corrected code between ```python and ```.\n"
    ),
    "completion": (
        "# An earlier attempt at '{question}' stopped with \"{error}\":\n"
        "```python\n{code}\n```\n# Written anew, so that it runs to its end:\n{initial_prompt}\n"
    ),
}


def _known(strategy: str, mode: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")


def _values(queries: DataFrame, strategy: str) -> dict[str, Column]:
    def optional(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in queries.columns else F.lit("")

    head, columns, note = optional("head_text"), optional("column_text"), optional("annotation_text")
    if strategy.endswith(("infilling_functions", "completion_functions")):
        # the profile stands inside a docstring
        head, columns, note = text.indent_block(head), text.indent_block(columns), text.indent_block(note, first=False)
    return {
        "question": F.col("user_query"),
        "head": head,
        "columns": columns,
        "annotation": note,
        "plan": optional("plan"),
        "plot": optional("plot_filename"),
        "code": optional("code"),
        "error": optional("code_errors"),
        "initial_prompt": optional("coder_prompt"),
    }


def row_error(queries: DataFrame, strategy: str, mode: str) -> Column:
    """Why a row cannot be rendered, or NULL."""
    error = F.lit(None).cast("string")
    if strategy.startswith("coder_only") and "plan" in queries.columns:
        has_plan = F.coalesce(F.col("plan"), F.lit("")) != ""
        error = F.when(has_plan, F.lit("this strategy takes no plan")).otherwise(error)
    if mode in ("plot_save", "auto_save"):
        path = F.coalesce(F.col("plot_filename"), F.lit("")) if "plot_filename" in queries.columns else F.lit("")
        needs = path == ""
        if mode == "auto_save":
            needs = needs & (F.col("tagged_query_type") == "plot")
        error = F.when(needs, F.lit("a plot that is saved needs a path")).otherwise(error)
    return error


def render_prompts(
    queries: DataFrame,
    profiles: DataFrame | None,
    strategy: str,
    mode: str = "auto",
    planning: bool = False,
    show_plot: bool = False,
) -> DataFrame:
    """Add ``prompt`` and ``error`` to every question.

    ``profiles`` holds one row per ``table_name`` with any of ``head_text``,
    ``column_text`` and ``annotation_text``. With ``mode="auto"`` the tag of
    each question picks its template, and ``show_plot`` whether plots are
    shown or saved. A row that breaks a rule gets an error and no prompt.
    """
    make = plan_template if planning else code_template
    rows = queries if profiles is None else attach_table(queries, profiles)
    values = _values(rows, strategy)
    if mode == "auto":
        plot_mode = "plot_show" if show_plot else "plot_save"
        prompt = F.when(
            F.col("tagged_query_type") == "plot", text.fill(make(strategy, plot_mode), values)
        ).otherwise(text.fill(make(strategy, "general"), values))
        error = row_error(rows, strategy, "auto_show" if show_plot else "auto_save")
    else:
        prompt = text.fill(make(strategy, mode), values)
        error = row_error(rows, strategy, mode)
    rows = rows.withColumn("error", error)
    return rows.withColumn("prompt", F.when(F.col("error").isNull(), prompt))


def render_debug_prompts(details: DataFrame, strategy: str = "basic", profiles: DataFrame | None = None) -> DataFrame:
    """Repair prompts for the rows that hold an error (``code_errors``)."""
    if strategy not in _DEBUG:
        raise ValueError(f"unknown debug strategy {strategy!r}; known: {', '.join(_DEBUG)}")
    failed = details.filter(F.coalesce(F.col("code_errors"), F.lit("")) != "")
    rows = failed if profiles is None else attach_table(failed, profiles)
    return rows.withColumn("debug_prompt", text.fill(_DEBUG[strategy], _values(rows, strategy)))


def collect_inputs(
    queries: DataFrame, profiles: DataFrame | None, strategy: str, path: str | None = None, **kwargs
) -> DataFrame:
    """Stop after prompt building: ``(input, output)`` pairs from questions with known code.

    The prompt's last four characters are cut, so that it ends where the
    known code goes on; the code closes its fence.
    """
    rendered = render_prompts(queries, profiles, strategy, **kwargs).filter(F.col("error").isNull())
    pairs = rendered.select(
        "query_id", text.trim_tail("prompt").alias("input"), text.close_fence("code").alias("output")
    )
    if path is not None:
        write_jsonl(pairs.select("input", "output"), path)
    return pairs


END = "</s>"


def format_training(df: DataFrame, style: str, source: str = "input", target: str = "output") -> DataFrame:
    """Training text of input/output pairs.

    ``completion`` joins both, ``instruct`` wraps the input in instruction
    tags, ``marker`` puts a code marker between them, ``raw`` is the output
    alone.
    """
    a, b, end = F.col(source), F.col(target), F.lit(END)
    styles = {
        "completion": lambda: F.concat(a, b, end),
        "instruct": lambda: F.concat(F.lit("<s>[INST] "), a, F.lit(" [/INST]\n"), b, end),
        "marker": lambda: F.concat(a, F.lit("# Code:\n    "), b, end),
        "raw": lambda: b,
    }
    if style not in styles:
        raise ValueError(f"unknown style {style!r}; known: {', '.join(styles)}")
    return df.withColumn("training_text", styles[style]())


# fixed values: the prompt formats the model families were trained with
_INSTRUCT = "<s>[INST] {prompt} [/INST]"
_BEGIN = "<s>{prompt}"
_MAGICODER = (
    "You are an exceptionally intelligent coding assistant that consistently delivers accurate and reliable "
    "responses to user instructions.\n\n@@ Instruction\n{prompt}\n\n@@ Response\n"
)
_WIZARD = (
    "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{prompt}\n\n### Response:"
)


def model_wrap(prompt: Column | str, model: Column | str) -> Column:
    """The prompt in the format of its model family; hosted models take it as it is."""
    values = {"prompt": prompt}
    model = F.col(model) if isinstance(model, str) else model
    plain = F.col(prompt) if isinstance(prompt, str) else prompt
    return (
        F.when(model.rlike(r"CodeLlama-\d+b-Instruct-hf"), text.fill(_INSTRUCT, values))
        .when(model.rlike(r"CodeLlama-\d+b-Python-hf"), text.fill(_BEGIN, values))
        .when(model.contains("Magicoder-S-CL-"), text.fill(_MAGICODER, values))
        .when(model.contains("WizardCoder-"), text.fill(_WIZARD, values))
        .otherwise(plain)
    )
