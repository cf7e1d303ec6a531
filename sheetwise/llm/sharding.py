"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwise.llm.registry import query, table
from sheetwise.session import checkpoint_folder

#: numpy draws the hypergeometric distribution below this size only
NUMPY_MOST = 10**9


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; by rejection (Stadlober, 1990) beyond numpy's range."""
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    mean = n * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - n) / max(1, total - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    log = lambda k: -sum(math.lgamma(x + 1) for x in (k, good - k, n - k, bad - n + k))
    most = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log(k) - log(most):
            return k


def deal(rng: np.random.Generator, cells: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of ``n`` rows drawn from ``cells`` fall into each.

    Beyond numpy's range the rows are dealt over the two halves of the cells first, then inside each half, so that
    only a few draws are made one by one. Cells without rows left take no draw.
    """
    total = int(cells.sum())
    if total < NUMPY_MOST:
        out, some = np.zeros_like(cells), np.flatnonzero(cells)
        out[some] = rng.multivariate_hypergeometric(cells[some], n, method="marginals") if len(some) else 0
        return out
    if len(cells) == 1:
        return np.array([n], cells.dtype)
    half = len(cells) // 2
    first = int(cells[:half].sum())
    taken = _draw(rng, first, total - first, n)
    return np.concatenate([deal(rng, cells[:half], taken), deal(rng, cells[half:], n - taken)])


def matrix_row(seed: int, blocks: np.ndarray, cells: np.ndarray, block: int) -> np.ndarray:
    """The matrix's row of one block: how many of its rows go to each cell.

    The blocks are halved again and again; at each halving the rows of the left half are dealt over what the
    cells have left, by a generator seeded with the place in the tree. Any task can so draw its own row
    in log(blocks) steps, the same again after a lost executor, and the matrix is never stored.
    """
    low, high, node = 0, len(blocks), 1
    ends = np.concatenate([[0], np.cumsum(blocks)])
    while high - low > 1:
        mid = (low + high) // 2
        left = deal(np.random.default_rng([seed, node]), cells, int(ends[mid] - ends[low]))
        cells, low, high, node = (left, low, mid, 2 * node) if block < mid else (cells - left, mid, high, 2 * node + 1)
    return cells


def cell_sizes(rows: int, shards: int, cells: int) -> np.ndarray:
    """Rows per cell: shards that differ by one row at most, each cut into ``cells`` cells that do too."""
    even = lambda n, k: n // k + (np.arange(k) < n % k)
    return np.concatenate([even(int(n), cells) for n in even(rows, shards)]).astype(np.int64)


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 42, cell_rows: int = 16_384) -> DataFrame:
    """All rows of ``df`` in uniformly random order, with ``shard`` and a gapless ``slot`` from 0 in each.

    Shard sizes differ by one row at most. Each shard is cut into cells of up to ``cell_rows`` rows of exact
    size. A communication matrix of hypergeometric counts says how many rows of each input block go to each
    cell. The rows are permuted inside their block as they are written to the checkpoint folder; a row's cell
    follows from its place; one exchange by cell and a second permutation inside the cell give the slot. No
    key takes part in it, so repeated rows and hot keys do not matter; a task sorts the few cells dealt to it, with spill.

    The driver holds one count per input partition. Cases: shards beyond the number of rows stay empty; an
    empty table gives none; nulls and repeated rows are rows like any other; input columns named ``shard`` or
    ``slot`` are replaced.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    place = F.monotonically_increasing_id()
    tagged = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.spark_partition_id().alias("block"), place.alias("id"))
    local = tagged.sortWithinPartitions(F.xxhash64(F.lit(seed), "id"), "id")
    folder = f"{checkpoint_folder(spark)}/shards-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    # the row's place in its block's permutation
    local.select("row", "block", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    counts = {r[0]: r[1] for r in rows.groupBy("block").count().collect()}
    blocks = np.zeros(max(counts, default=0) + 1, np.int64)
    blocks[list(counts)] = list(counts.values())
    per_shard = max(1, math.ceil(int(blocks.sum()) / shards / cell_rows))
    sizes = cell_sizes(int(blocks.sum()), shards, per_shard)
    sent = spark.sparkContext.broadcast(blocks)

    @F.arrow_udf("int")
    def cell_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[int, np.ndarray] = {}
        for block, place in batches:
            block, place, out = block.to_numpy(), place.to_numpy(), np.zeros(len(block), np.int32)
            for b in np.unique(block).tolist():
                if b not in known:
                    known.clear()  # a file holds one block
                    known[b] = np.cumsum(matrix_row(seed, sent.value, sizes, b))
                mine = block == b
                out[mine] = np.searchsorted(known[b], place[mine], side="right")
            yield pa.array(out)

    again = F.xxhash64(F.lit(seed + 1), "block", "place")
    dealt = rows.withColumn("cell", cell_of("block", "place"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(again, "block", "place")))
    # cells of a shard are equal up to one row, larger ones first
    shard, part = F.floor(F.col("cell") / per_shard).cast("int"), F.col("cell") % per_shard
    of_shard = F.lit(int(blocks.sum()) // shards).cast("long") + F.when(shard < int(blocks.sum()) % shards, 1).otherwise(0)
    before = part * F.floor(of_shard / per_shard) + F.least(part.cast("long"), of_shard % per_shard)
    return ranked.select(*[F.col(f"row.`{c}`").alias(c) for c in names], shard.alias("shard"), (before + F.col("rank") - 1).cast("long").alias("slot"))


@query("op1_hypergeometric_shards")
def hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
