"""Places where the caller's own Python runs: completions and per-table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.scale import with_keys

Complete = Callable[[list[str]], list[str]]


def completion_for(model: str, known: Mapping[str, Callable[[], Complete]]) -> Callable[[], Complete]:
    """The completion factory whose name is the longest prefix of ``model``."""
    fits = [prefix for prefix in known if model.startswith(prefix)]
    if not fits:
        raise ValueError(f"model {model!r} is not recognised; known: {', '.join(known)}")
    return known[max(fits, key=len)]


def map_completions(
    df: DataFrame, col: str, make: Callable[[], Complete], name: str = "response", error: str = "error"
) -> DataFrame:
    """Run a completion function over a column of prompts, in Arrow batches.

    ``make`` is called once per task and sets the function up; the function
    maps a list of prompts to as many answers. A prompt that fails gets an
    error text and does not stop the others.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        complete = make()

        def one(prompt):
            try:
                return complete([prompt])[0], None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        for prompts in batches:
            asked = prompts.tolist()
            try:
                done = [(a, None) for a in complete(asked)]
                if len(done) != len(asked):
                    raise ValueError("one answer per prompt is needed")
            except Exception:
                done = [one(p) for p in asked]
            yield pd.DataFrame({"answer": [d[0] for d in done], "error": [d[1] for d in done]})

    hook = F.pandas_udf(run, "answer string, error string")
    answered = df.withColumn("__done", hook(F.col(col)))
    return answered.withColumn(name, F.col("__done.answer")).withColumn(error, F.col("__done.error")).drop("__done")


def solve_groups(
    df: DataFrame,
    key: str,
    solve: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None,
    schema: str,
    spark_solve: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run ``solve`` on each of many tables kept in one DataFrame.

    ``solve`` gets a table as an iterator of pandas batches and yields result
    batches, so a table may be of any size as long as the function keeps
    little of it. A function that works on DataFrames holding several tables
    is given as ``spark_solve`` instead and is then the only route.
    """
    keyed = with_keys(df, [key])
    if spark_solve is not None:
        return spark_solve(keyed)
    # Python time does not follow the bytes, so the partitions must not be merged by size
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from solve(batches)

    return keyed.repartition(parts, key).groupBy(key).applyInPandas(run, schema)
