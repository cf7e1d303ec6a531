"""Sorting, top-k, repeatable shuffles and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.scale import first_rows, hash_order, present


def _missing_last(df: DataFrame, col: str, ascending: bool) -> Column:
    value = present(df, col)
    return value.asc_nulls_last() if ascending else value.desc_nulls_last()


def sort_by(
    df: DataFrame, cols: Sequence[str], ascending: bool | Sequence[bool] = True, key: Sequence[str] = ()
) -> DataFrame:
    """Sort with missing values last in both directions.

    ``key`` makes the order unique and lets the range partitioning split a
    value that very many rows share.
    """
    up = [ascending] * len(cols) if isinstance(ascending, bool) else list(ascending)
    return df.orderBy(*[_missing_last(df, c, a) for c, a in zip(cols, up)], *key)


def top_k(df: DataFrame, col: str, k: int, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The ``k`` largest values; ``key`` breaks ties."""
    found = df.filter(present(df, col).isNotNull()).orderBy(F.col(col).desc(), *key).limit(k)
    return found.select(*columns) if columns else found


def bottom_k(df: DataFrame, col: str, k: int, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The ``k`` smallest values; ``key`` breaks ties."""
    found = df.filter(present(df, col).isNotNull()).orderBy(F.col(col).asc(), *key).limit(k)
    return found.select(*columns) if columns else found


def top_k_ratio(
    df: DataFrame, top: str, bottom: str, k: int, key: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """The ``k`` rows with the largest ``top / bottom``."""
    kept = [*columns, "ratio"] if columns else None
    return top_k(df.withColumn("ratio", F.try_divide(top, bottom)), "ratio", k, key, kept)


def first_samples(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """First ``n`` values of each column as ``(column_name, position, sample_values)``.

    ``n`` is a handful: the rows are cut to ``n`` before anything is gathered.
    """
    few = first_rows(df, n, order).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    gathered = few.agg(*[F.collect_list(F.coalesce(F.col(f"`{c}`"), F.lit("null"))).alias(c) for c in df.columns])
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col(f"`{c}`").alias("sample_values")
        )
        for i, c in enumerate(df.columns)
    ]
    return gathered.select(F.inline(F.array(*cells)))


def seeded_shuffle(df: DataFrame, seed: int, key: Sequence[str]) -> DataFrame:
    """A repeatable shuffle that does not depend on partitioning."""
    return df.orderBy(hash_order(seed, key), *key)


#: a hash has 60 bits; rows are first counted by the upper ones
_COARSE = 44


def first_by_hash(df: DataFrame, n: int, seed: int, key: Sequence[str], total: int | None = None) -> Column | None:
    """A predicate that picks exactly ``n`` rows by the hash of their key; None picks all.

    Hashes are spread evenly. One pass counts the rows by the upper bits of
    their hash, a second one looks only at the rows that share the bits where
    the picked part ends. What follows from the counts are two numbers; the
    driver sees 65,536 counts and the edge. Keys that share the last hash are
    told apart by their own order, inside Spark.
    """
    if n <= 0:
        return F.lit(False)
    h = hash_order(seed, key)
    coarse = F.shiftright(h, _COARSE)
    counts = sorted((r[0], r[1]) for r in df.groupBy(coarse.alias("c")).count().collect())
    below = 0
    for part, size in counts:
        if below + size >= n:
            break
        below += size
    else:
        return None
    if below + size == n:
        return coarse <= part
    near = df.filter(coarse == part).select(h.alias("h"), F.struct(*key).alias("k"))
    edge = near.orderBy("h", "k").limit(n - below).agg(F.max(F.struct("h", "k"))).scalar()
    return (coarse < part) | ((coarse == part) & (F.struct(h.alias("h"), F.struct(*key).alias("k")) <= edge))


def split_train_validation(
    df: DataFrame, ratio: float, seed: int, key: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Disjoint (training, validation) parts with exactly ``int(n * ratio)`` validation rows.

    A row's side follows from its key's hash, so both parts are plain filters
    of the table.
    """
    inside = first_by_hash(df, int(df.count() * ratio), seed, key)
    if inside is None:
        return df.limit(0), df
    return df.filter(~inside), df.filter(inside)


def select_first(df: DataFrame, k: int, seed: int, key: Sequence[str]) -> DataFrame:
    """A probe set: the first ``k`` rows in shuffled order."""
    return df.orderBy(hash_order(seed, key), *key).limit(k)


def length_buckets(df: DataFrame, col: str, width: int) -> DataFrame:
    """Sizes of the groups of similarly long texts."""
    length = F.length(col)
    return (
        df.groupBy(F.floor(length / F.lit(width)).alias("bucket"))
        .agg(F.count("*").alias("n_rows"), F.min(length).alias("shortest"), F.max(length).alias("longest"))
    )


def group_by_length(df: DataFrame, col: str, key: Sequence[str]) -> DataFrame:
    """Rows placed so that texts of similar length share a partition.

    The key's hash comes second, so that one very common length is still
    spread over several partitions.
    """
    placed = df.withColumn("__length", F.length(col)).withColumn("__spread", hash_order(0, key))
    return (
        placed.repartitionByRange("__length", "__spread")
        .sortWithinPartitions("__length", "__spread")
        .drop("__length", "__spread")
    )
