"""Answering questions: try candidates in order, record what happened.

A candidate is the work that answers the question: a Spark SQL text over the
registered tables, or a function from DataFrame to DataFrame. It runs as Spark
jobs; text is never executed as Python.
"""

from __future__ import annotations

import itertools
import threading
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sheetwise.functions import text
from sheetwise.operators import joins
from sheetwise.operators.cleaning import non_blank_queries
from sheetwise.operators.evaluate import tag_question
from sheetwise.session import checkpoint_folder, settle
from sheetwise.sources.registry import TableRegistry
from sheetwise.sources.results import DETAIL, write_results

Candidate = str | Callable[[DataFrame], DataFrame]

EMPTY_ANSWER = "The question asks for a text answer, but the result is empty."


def _plan_of(registry: TableRegistry, table: str, candidate: Candidate) -> DataFrame:
    df = registry.get(table)
    return registry.spark.sql(candidate) if isinstance(candidate, str) else candidate(df)


def _message(e: Exception) -> str:
    """Kind and whole text of an error, which a repair needs."""
    words = e.getMessage() if isinstance(e, PySparkException) else str(e)
    return f"{type(e).__name__}: {(words or '').strip()}"


ANSWER_ROWS = "run_id string, query_id long, row long, line string"

#: bytes of an answer that are handed to the driver; the answer table has all of it
DETAIL_BYTES = 1 << 20

#: appends to one table at a time: the commit of one job removes what others have not committed
_APPENDING = threading.Lock()


def answer_lines(result: DataFrame, run_id: str, query_id: int | None) -> DataFrame:
    """A result as rows ``(run_id, query_id, row, line)``: every row as a JSON line, numbered in the result's order."""
    placed = result.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).withColumns(
        {"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}
    )
    sizes = [tuple(r) for r in placed.groupBy("part").count().orderBy("part").collect()]  # one row per partition
    starts = itertools.accumulate((n for _, n in sizes), initial=0)
    offsets = result.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part int, start long")
    row = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(offsets), "part")
    return numbered.select(F.lit(run_id).alias("run_id"), F.lit(query_id).cast("long").alias("query_id"), row.alias("row"), "line")


def answer_text(lines: DataFrame, answers: str) -> tuple[str, bool]:
    """The lines as one text, and whether that is all; beyond ``DETAIL_BYTES`` it says how many more rows ``answers`` has."""
    out, held, n = [], 0, 0
    size = lines.agg(F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes")).first()
    whole = (size["bytes"] or 0) <= DETAIL_BYTES
    for r in (lines if whole else lines.filter(F.col("row") < 1000)).orderBy("row").toLocalIterator():
        if held + len(r["line"]) > DETAIL_BYTES:
            break
        out.append(r["line"])
        held, n = held + len(r["line"]) + 1, n + 1
    return "\n".join(out) + ("" if n == size["n"] else f"\n... {size['n'] - n} more rows in the answer table {answers}"), n == size["n"]


def shown(candidate: Candidate) -> str:
    return candidate if isinstance(candidate, str) else getattr(candidate, "__name__", "function")


def repair_prompt(question: str, candidate: Candidate, error: str) -> str:
    """What a model would be asked after a failed candidate."""
    return f"To answer '{question}' this was run:\n{shown(candidate)}\nIt failed:\n{error}\nReturn the whole corrected work.\n"


def detail_record(
    query_id: int | None,
    tag: str,
    tried: Sequence[Candidate],
    errors: Sequence[str],
    ok: bool,
    result: str,
    plan: str | None = None,
    coder_prompt: str | None = None,
    planner_prompt: str | None = None,
    debug_prompt: str | None = None,
    plot: str | None = None,
) -> dict:
    """The detail row of one question.

    Errors are listed only if the last attempt failed as well; the plot path
    is kept for plots only.
    """
    left = [] if ok else list(errors)
    return {
        "query_id": query_id,
        "plan": plan,
        "coder_prompt": coder_prompt,
        "prompt_user_for_planner": planner_prompt,
        "tagged_query_type": tag,
        "first_generated_code": shown(tried[0]) if tried else "",
        "final_generated_code": shown(tried[-1]) if tried else "",
        "last_debug_prompt": debug_prompt or "",
        "count_of_fixing_errors": max(len(tried) - 1, 0),
        "successful_code_execution": ok,
        "result_repl_stdout": result,
        "plot_filename": (plot or "") if tag == "plot" else "",
        "code_errors": "\n".join(f'{i}. "{e}"' for i, e in enumerate(left)),
    }


def _answer(
    registry: TableRegistry,
    table: str,
    query: str,
    candidates: Iterable[Candidate],
    max_retry: int = 2,
    query_id: int | None = None,
    fixed_type: str | None = None,
    plan: str | None = None,
    plot_path: str | None = None,
    collect_only: bool = False,
    coder_prompt: str | None = None,
    planner_prompt: str | None = None,
    answers: str | None = None,
    run_id: str = "run",
) -> tuple[DataFrame | str | None, dict | None, DataFrame | None]:
    """As ``answer``, and the lines of an answer whose detail has only the first of them."""
    if collect_only:
        return coder_prompt, None, None
    try:
        spark = registry.spark
        tag = fixed_type
        if tag is None or plot_path is None:
            rule, path = tag_question(F.lit(query)), text.plot_path(F.lit(table), F.lit(query_id or 0))
            found = spark.range(1).select(rule, path).first()
            tag, plot_path = tag or found[0], plot_path or found[1]
        registry.get(table)
        tried: list[Candidate] = []
        errors: list[str] = []
        result, last_prompt = None, None
        for candidate in itertools.islice(candidates, max_retry + 1):
            tried.append(candidate)
            try:
                result = settle(_plan_of(registry, table, candidate))
                if tag == "plot" or not result.isEmpty():
                    break
                errors.append(EMPTY_ANSWER)
            except Exception as e:  # any failure of a candidate is its error
                result = None
                errors.append(_message(e))
            last_prompt = repair_prompt(query, candidate, errors[-1])
        empty = result is not None and tag == "general" and result.isEmpty()
        shown, rest = "ERROR", None
        if result is not None:
            answers = answers or f"{checkpoint_folder(spark)}/answers-{uuid.uuid4()}"
            lines = answer_lines(result, run_id, query_id)
            with _APPENDING:
                lines.write.mode("append").partitionBy("run_id").parquet(answers)
            shown, whole = answer_text(lines, answers)
            rest = None if whole else lines
        detail = detail_record(
            query_id, tag, tried, errors, result is not None, shown, plan, coder_prompt, planner_prompt, last_prompt, plot_path
        )
        if result is None:
            return "ERROR", detail, None
        return (EMPTY_ANSWER if empty else result), detail, rest
    except Exception as e:
        print(f"the question could not be answered: {_message(e)}")
        return None, None, None


def answer(*args, **options) -> tuple[DataFrame | str | None, dict | None]:
    """Answer one question: ``(result, detail)``; the parameters are those of ``_answer``.

    Candidates are tried in order, at most ``max_retry`` after the first. An
    error, and an empty result of a question that asks for text, go to the next
    one; the detail has the prompt that would ask for this repair. The
    result of the first that runs is settled, so it is computed once, and all its
    rows are added as ``ANSWER_ROWS`` to the table ``answers`` (a new one in the
    checkpoint folder unless given). The detail has the whole answer up to
    ``DETAIL_BYTES``; beyond, it names that table, from which ``pair_answers`` scores. Without
    a result the answer is ``"ERROR"``; if the call itself fails, for instance
    because the table cannot be read, it is ``(None, None)``. With
    ``collect_only`` nothing runs and the prompt is handed back.
    """
    return _answer(*args, **options)[:2]


def answer_batch(
    queries: DataFrame,
    registry: TableRegistry,
    candidates_for: Callable[[Row], Iterable[Candidate]],
    path: str | None = None,
    run_id: str = "run",
    max_retry: int = 2,
    save_every: int = 100,
    answers: str | None = None,
    workers: int = 4,
) -> DataFrame:
    """Answer a sheet of questions; one bad row does not stop the run.

    Each question is a Spark job of its own over a whole table; ``workers`` of
    them run at a time, so that small jobs fill the cluster. Tags and plot
    paths are found for the whole sheet in one plan; only the question rows pass the driver,
    ``save_every`` at a time, and so many details are appended to ``path``, the rows of the
    results to ``answers`` (new tables in the checkpoint folder unless given). A detail row has
    the whole answer; one above ``DETAIL_BYTES`` is put together by an executor. A question whose
    call failed has no detail row.
    """
    spark = queries.sparkSession
    path = path or f"{checkpoint_folder(spark)}/details-{uuid.uuid4()}"
    answers = answers or f"{checkpoint_folder(spark)}/answers-{uuid.uuid4()}"
    tag, plot = (F.col(c) if c in queries.columns else F.lit(None).cast("string") for c in ("tagged_query_type", "plot_filename"))
    sheet = non_blank_queries(queries).withColumns(
        {
            "tagged_query_type": F.coalesce(tag, tag_question("user_query")),
            "plot_filename": F.coalesce(plot, text.plot_path("table_name", "query_id")),
        }
    )

    def one(row: Row) -> tuple[dict | None, DataFrame | None]:
        asked = row.asDict()
        try:
            return _answer(
                registry,
                asked["table_name"],
                asked["user_query"],
                candidates_for(row),
                max_retry=max_retry,
                query_id=asked["query_id"],
                fixed_type=asked["tagged_query_type"],
                plan=asked.get("plan"),
                plot_path=asked["plot_filename"],
                planner_prompt=asked.get("prompt_user_for_planner"),
                answers=answers,
                run_id=run_id,
            )[1:]
        except Exception as e:
            print(f"question {asked.get('query_id')} is skipped: {_message(e)}")
            return None, None

    rows = sheet.toLocalIterator()
    with ThreadPoolExecutor(workers) as pool:
        while some := list(itertools.islice(rows, save_every)):
            details = [(d, lines) for d, lines in pool.map(one, some) if d is not None]
            if details:
                rows_of = lambda ds: spark.createDataFrame([tuple(d.values()) for d in ds], DETAIL)
                found = rows_of([d for d, lines in details if lines is None])
                for d, lines in details:
                    if lines is not None:
                        text_of = joins.answers_as_text(lines.withColumn("query_id", F.lit(0))).select(F.col("answer").alias("result_repl_stdout"))
                        found = found.unionByName(rows_of([d]).drop("result_repl_stdout").crossJoin(text_of))
                write_results(found, path, run_id)
    try:
        return spark.read.parquet(path).filter(F.col("run_id") == run_id).drop("run_id")
    except PySparkException:
        return spark.createDataFrame([], DETAIL)
