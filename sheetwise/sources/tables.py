"""Tables, annotations and JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

from sheetwise.sources.workbooks import read_workbook


def missing_to_null(df: DataFrame, texts: bool = True) -> DataFrame:
    """Turn NaN numbers and, with ``texts``, the texts '' and 'nan' into NULL."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (DoubleType, FloatType)):
            c = F.when(~F.isnan(c), c)
        elif texts and isinstance(field.dataType, StringType):
            c = F.when(~F.lower(F.trim(c)).isin("", "nan"), c)
        out.append(c.alias(field.name))
    return df.select(*out)


def load_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, nan_is_missing: bool = True
) -> DataFrame:
    """Read a table, choosing the reader by the file extension.

    CSV and XLSX types are inferred unless a schema is given; give one for
    large CSV tables, since inference reads the file an extra time.

    NaN numbers of a Parquet table become NULL, too. A comparison on such a
    column is then not pushed into the scan; ``nan_is_missing=False`` keeps it
    there for tables that are known to hold no NaN.
    """
    if path.endswith(".csv"):
        return read_csv(spark, path, schema)
    if path.endswith(".parquet"):
        read = spark.read.parquet(path)
        return missing_to_null(read, texts=False) if nan_is_missing else read
    if path.endswith(".xlsx"):
        return read_workbook(spark, path, schema)
    raise ValueError(f"cannot load {path!r}: the file must be .csv, .xlsx or .parquet")


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header line.

    ``multi_line`` allows line breaks inside quoted cells, but makes Spark read
    each file in a single task, so it is off unless asked for.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        return missing_to_null(reader.schema(schema).csv(path))
    return missing_to_null(reader.option("inferSchema", True).csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header line and without a row index."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line, read with a known schema."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per row; missing fields are written as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def load_annotations(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Column descriptions as rows ``(column, description)``.

    No path, or a file that cannot be read, gives None. Descriptions that are
    not plain text are kept as JSON text.
    """
    if path is None:
        return None
    try:
        raw = spark.read.option("multiLine", True).json(path)
        if "_corrupt_record" in raw.columns or not raw.columns:
            return None
    except PySparkException:
        return None
    parts = []
    for field in raw.schema.fields:
        c = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, StringType):
            c = F.to_json(c) if field.dataType.typeName() in ("struct", "array", "map") else c.cast("string")
        parts.append(F.struct(F.lit(field.name).alias("column"), c.alias("description")))
    return raw.select(F.inline(F.array(*parts)))


def from_sql(spark: SparkSession, text: str) -> DataFrame:
    """Read the result of a SQL query over registered tables."""
    return spark.sql(text)


def cast_all_string(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every cell as text, the way a question sheet is read."""
    chosen = set(columns or df.columns)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])
