"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs to its last row (``noop`` sink). The best of two runs counts,
after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sheetwise.plans.catalog import QUERIES  # noqa: E402
from sheetwise.session import local_session  # noqa: E402

HEADLINE = [
    "flagship", "filter_rows", "row_index", "merge_inner", "concat_cols", "agg_median", "group_median", "corr_matrix",
    "multi_agg", "group_members", "mean_and_members", "token_budget", "rolling_mean", "rolling_mean_all", "shift",
    "pct_change", "resample_day", "resample_quantile", "seasonal_decompose", "autocorrelation", "sort_by", "top_k",
    "seeded_shuffle", "split_rows", "length_buckets", "concat_splits", "frame_diff", "pivot_mean", "melt", "crosstab",
    "cut_end", "fenced_blocks", "dedent", "comment_forbidden", "extract_code", "extract_code_local", "escape_repr",
    "body_after_solve", "profile_table", "render_prompts", "format_training", "tag_queries", "score_exact",
    "score_tolerant", "executable_rate", "tagging_accuracy", "answer_sql", "page_links", "doc_examples",
    "parse_chart_table", "chart_hist", "chart_box", "chart_pie", "chart_scatter_matrix", "bootstrap_stats",
    "map_completions", "solve_groups",
]


def run(spark, name: str, folder: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    run(spark, "src_sql", folder)
    times = {}
    for name in names:
        times[name] = round(min(run(spark, name, folder) for _ in range(2)), 3)
        print(name, times[name], file=sys.stderr)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
