"""Where queries register themselves, and how they read the given tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.session import settle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if there is one, the SQL that must give the same rows."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round the named columns, so that two engines' last bits do not matter."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


# The given tables hold no missing cells; these columns derive some from the
# number inside an event's properties.
SPARSE_EVENTS = """(
  SELECT event_id, ts, user_id, k,
         CASE WHEN k % 7 = 0 THEN 'NaN' ELSE event_type END AS event_type,
         CASE WHEN k % 5 <> 0 THEN value END AS value
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
)"""


def sparse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        k.alias("k"),
        F.when(k % 7 == 0, F.lit("NaN")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(k % 5 != 0, F.col("value")).alias("value"),
    )


def hash_sql(seed: int | str, *keys: str) -> str:
    """The number of ``scale.hash_order`` in DuckDB."""
    text = " || '|' || ".join([f"'{seed}'", *[f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys]])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def nan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sparse_events`` with NaN where it has NULL: what a table holds whose missing numbers are NaN."""
    return sparse_events(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def sql(text: str) -> Column:
    """An expression that is written the same way in both engines."""
    return F.expr(text)


def in_place(df: DataFrame) -> DataFrame:
    """Rows with their position in the result's own order, so that the order can be compared."""
    placed = df.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    placed = settle(placed)
    sizes = sorted(tuple(r) for r in placed.groupBy("part").count().collect())
    starts = itertools.accumulate((n for _, n in sizes), initial=0)
    offsets = F.broadcast(df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part int, start long"))
    at = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "part").withColumn("row_index", at).drop("part", "place", "start")
