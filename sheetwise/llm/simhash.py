"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.components import components
from sheetwise.llm.registry import query, table
from sheetwise.llm.text import NO_ID, row_id
from sheetwise.session import settle

BITS = 64
#: hashes whose bits are counted at once
CHUNK = 65_536


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of the text's word shingles: a bit is set if over half the shingles' hashes set it."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: lowers A-Z, splits at ASCII white space
    if not parts:
        return 0
    digest = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    runs = zip(*(parts[i:] for i in range(words))) if len(parts) >= words else [parts]
    hashes = np.fromiter(map(digest, map(b" ".join, runs)), np.uint64)
    set_bits = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        some = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def covering_masks(radius: int) -> list[int]:
    """Bit masks of which at least one misses every set of ``radius`` bits.

    Each bit gets one of the non-zero vectors of radius + 1 bits, mask v keeps the bits whose vector has an odd
    product with v. The vectors of ``radius`` bits never span the space, so some v is orthogonal to all
    of them and its mask holds none of these bits (Pagh, 2016).
    """
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def finer(mask: int, radius: int) -> list[int]:
    """The masks that each add one of radius + 1 parts of the bits not yet kept; two values within the radius agree on one."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[g :: radius + 1]) for g in range(radius + 1)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def bucket_links(mask: np.ndarray, value: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is near in each bucket: every value to the smallest of its chain, never all pairs.

    The arrays are sorted by bucket; neighbours at growing distance are compared for all buckets at once.
    """
    new = np.ones(len(fp), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(new)
    end = np.repeat(np.append(starts[1:], len(fp)), np.diff(np.append(starts, len(fp))))
    root, left, step = np.arange(len(fp)), np.arange(len(fp)), 1
    while len(left := left[left + step < end[left]]):
        near = left[np.bitwise_count(fp[left] ^ fp[left + step]) <= radius]
        if len(near):
            a, b = near, near + step
            while True:
                ra, rb = root[a], root[b]
                apart = ra != rb
                if not apart.any():
                    break
                np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
                while (root != root[root]).any():
                    root = root[root]
        step += 1
    child = np.flatnonzero(root != np.arange(len(fp)))
    return fp[child], fp[root[child]]


def near_links(values: DataFrame, radius: int, bucket_rows: int = 2_048) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct ``fp`` whose distance is at most ``radius``, through chains.

    Every value goes to one bucket per covering mask. A bucket of more than ``bucket_rows`` values is
    split by finer masks until none is left, so no task holds more than that of one bucket and
    no pair within the radius is lost.
    """
    spark = values.sparkSession
    masks = covering_masks(radius)
    at = [F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for m in masks]
    level = values.select("fp", F.explode(F.array(*at)).alias("at")).select("fp", "at.*")
    parts = []
    while True:
        big = settle(level.groupBy("mask", "value").count().filter(F.col("count") > bucket_rows).drop("count"))
        if big.isEmpty():
            parts.append(level)
            break
        parts.append(level.join(big, ["mask", "value"], "left_anti").select("fp", "mask", "value"))
        children = [(signed(m), signed(c)) for m in masks for c in finer(m, radius)]
        split = F.broadcast(spark.createDataFrame(children, "mask long, child long"))  # a few masks per level
        level = level.join(big, ["mask", "value"]).join(split, "mask")
        level = settle(level.select("fp", F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("value")))
        masks = sorted({c for m in masks for c in finer(m, radius)})
    rows = functools.reduce(DataFrame.unionByName, parts)
    ordered = rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, b = bucket_links(*rows, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rest = np.concatenate([rest, [batch.column(c).to_numpy() for c in ("mask", "value", "fp")]], axis=1)
            last = (rest[0] != rest[0, -1:]) | (rest[1] != rest[1, -1:]) if rest.size else np.zeros(0, bool)
            whole = int(last.sum())  # the rows of all buckets but the last, which may go on
            yield out(rest[:, :whole])
            rest = rest[:, whole:]
        yield out(rest)

    return ordered.mapInArrow(link, "a long, b long").distinct()


def near_classes(
    docs: DataFrame, words: int = 3, radius: int = 3, bucket_rows: int = 2_048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row ``(id, hash, fingerprint, component)`` per document; ``component`` is the smallest id that links reach.

    Two documents are linked if their fingerprints differ in at most ``radius`` bits. Copies share a
    fingerprint, so links are sought between distinct fingerprints only. Covering masks give every pair
    within the radius a common bucket; buckets return chains, not pairs; components are found by star
    rounds. Texts are read once and never shuffled; the search moves 8-byte values.

    Cases: a null or empty text has fingerprint 0 and is linked like any other; a missing id becomes
    ``NO_ID``, the smallest; rows with the same id and repeated rows each give a row; an empty table
    gives none. ``hash`` is the XXH64 of the text, to find the row again.
    """

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array((signed(fingerprint(t.as_py(), words)) for t in texts), pa.int64())

    text = F.col(f"`{text_col}`")
    keys = settle(docs.select(row_id(id_col).alias("id"), F.xxhash64(text).alias("hash"), fingerprints(text).alias("fp")))
    first = settle(keys.groupBy("fp").agg(F.min("id").alias("first")))
    linked = components(near_links(first.select("fp"), radius, bucket_rows))
    rooted = first.join(linked, first["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = rooted.join(least, "root").select("fp", "component")
    return keys.join(classes, "fp").select("id", "hash", F.col("fp").alias("fingerprint"), "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents with one of each near-duplicate group, the one with the smallest id; columns unchanged.

    Of rows that share this id, the one whose text has the smallest hash stays, and of repeated rows one.
    """
    classes = near_classes(docs, id_col=id_col, text_col=text_col, **kw)
    chosen = classes.groupBy("component").agg(F.min(F.struct("id", "hash")).alias("row")).select("row.*")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, row_id(id_col).alias("id"), F.xxhash64(f"`{text_col}`").alias("hash"))
    return rows.join(chosen, ["id", "hash"]).groupBy("id", "hash").agg(F.first("row").alias("row")).select("row.*")


@query("op7_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"))
    no_id = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return found.select(no_id("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), no_id("component").alias("component_id"))
