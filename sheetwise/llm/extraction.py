"""Text of HTML pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.registry import query, table
from sheetwise.llm.render import render
from sheetwise.llm.text import without


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The pages with ``text``, their visible text (see ``render``); rows stay where they are, nothing is shuffled.

    A null or empty page gives an empty text, repeated rows stay repeated, an input column ``text`` is replaced.
    """

    @F.arrow_udf("string")
    def rendered(pages: pa.Array) -> pa.Array:
        return pa.array((render(p.as_py()) for p in pages), pa.string())

    return pages.select(*without(pages, "text"), rendered(F.col(f"`{html_col}`")).alias("text"))


@query("op6_layout_text")
def layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract_text(table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", F.char_length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), "text")
