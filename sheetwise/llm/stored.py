"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from sheetwise.session import checkpoint_folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the session's checkpoint folder and read from there; compressed, unlike a checkpoint."""
    folder = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
