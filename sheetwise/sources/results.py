"""Run results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_SHEET = (
    "query_id long, table_name string, user_query string, has_plot_answer boolean, "
    "text2analysis boolean, plan string, tagged_query_type string, "
    "prompt_user_for_planner string, plot_filename string, code string"
)

DETAIL = (
    "query_id long, plan string, coder_prompt string, prompt_user_for_planner string, "
    "tagged_query_type string, first_generated_code string, final_generated_code string, "
    "last_debug_prompt string, count_of_fixing_errors int, successful_code_execution boolean, "
    "result_repl_stdout string, plot_filename string, code_errors string"
)


def write_results(details: DataFrame, path: str, run_id: str, mode: str = "append") -> None:
    """Add a run's detail rows to a results table, partitioned by run."""
    if details.filter(F.col("query_id").isNull()).limit(1).count():
        raise ValueError("every detail row needs a query_id")
    details.withColumn("run_id", F.lit(run_id)).write.mode(mode).partitionBy("run_id").parquet(path)


def report_lines(metrics: DataFrame) -> DataFrame:
    """Cohort metrics ``(cohort, n_queries, n_executable, rate)`` as text lines."""
    name, n, ok, rate = (F.col(c) for c in ("cohort", "n_queries", "n_executable", "rate"))
    lines = F.when(n == 0, F.array(F.format_string("%s: no questions", name))).otherwise(
        F.array(
            F.format_string("%s: %d questions", name, n),
            F.format_string("%s: %d of them ran", name, ok),
        )
    )
    share = F.concat(name, F.lit(": share that ran "), rate.cast("string"))
    return metrics.select("cohort", F.concat(lines, F.array(share)).alias("lines"))


def write_report(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the report as one text file; the metrics are one row per cohort."""
    numbered = report_lines(metrics).select("cohort", F.posexplode("lines").alias("part", "value"))
    is_rate = F.col("value").contains(": share that ran ")
    rule = numbered.sparkSession.createDataFrame([("----------",)], "value string")
    ordered = (
        numbered.select(is_rate.cast("int").alias("section"), "cohort", "part", "value")
        .unionByName(rule.select(F.lit(1).alias("section"), F.lit("").alias("cohort"), F.lit(-1).alias("part"), "value"))
        .orderBy("section", "cohort", "part")
        .select("value")
    )
    ordered.coalesce(1).write.mode(mode).text(path)
