"""Clustering of vectors round by round over a VA-file: a byte or less per component says most of the assignments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.registry import query, table
from sheetwise.llm.stored import stored

#: integer components lie within this, so that 64 squared differences fit into 63 bits
LARGEST = 2**27
#: cells of equal width span so many standard deviations on both sides of the mean
SPAN = 3.5
#: vectors a task looks at together
AT_ONCE = 4_096


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers, a column per centroid."""
    cross = vectors @ centroids.T
    return (vectors * vectors).sum(axis=1)[:, None] - 2 * cross + (centroids * centroids).sum(axis=1)


@dataclass(frozen=True)
class Cells:
    """The first and last whole number of each cell, by dimension; the outer cells reach to the extremes."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def spread(cls, least: np.ndarray, most: np.ndarray, mean: np.ndarray, spread: np.ndarray, bits: int) -> Cells:
        """2 ** ``bits`` cells a dimension; any borders give right results, these only fetch few vectors."""
        at = np.linspace(-SPAN, SPAN, 2**bits - 1)
        cuts = np.ceil(mean[:, None] + spread[:, None] * at).astype(np.int64)
        cuts = np.clip(cuts, least[:, None], most[:, None] + 1)
        return cls(np.hstack([least[:, None], cuts]), np.hstack([cuts - 1, most[:, None]]))

    def code(self, vectors: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(low[1:], x, side="right") for low, x in zip(self.low, vectors.T)]
        return np.ascontiguousarray(np.stack(columns, axis=1), np.uint8)

    def table(self, centroids: np.ndarray) -> np.ndarray:
        """By dimension and cell what the component adds to each centroid's distance, at least and at most.

        The vector's own square is left out: it is the same for all centroids.
        """
        ends = [-2 * end[:, :, None] * centroids.T[:, None, :] + (centroids.T**2)[:, None, :] for end in (self.low, self.high)]
        both = np.concatenate([np.minimum(*ends), np.maximum(*ends)], axis=2)
        small = np.abs(both).max(axis=(1, 2)).sum() < 2**31
        return both.astype(np.int32) if small else both


def nearest_by_cells(codes: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid where the intervals decide it, and where they do not.

    Of centroids that may be equally near, the smaller number would win, so only a clear interval decides.
    """
    sums = np.zeros((len(codes), lookup.shape[2]), lookup.dtype)
    for d, rows in enumerate(lookup):
        sums += rows[codes[:, d]]
    k = lookup.shape[2] // 2
    best = sums[:, k:].argmin(axis=1)
    at = np.arange(len(codes))
    limit = sums[at, k + best]
    low = sums[:, :k]
    open_ = (low <= limit[:, None]).sum(axis=1) > 1
    return best, open_


def _numbers(values: pa.Array, dtype: str, dims: int) -> np.ndarray:
    """Binary cells of equal length as the rows of an array."""
    kept = values.cast(pa.binary(np.dtype(dtype).itemsize * dims))
    raw = np.frombuffer(kept.buffers()[1], np.uint8)[kept.offset * kept.type.byte_width :][: len(kept) * kept.type.byte_width]
    return raw.view(dtype).reshape(len(kept), dims)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(start, AT_ONCE)


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``(id, ints)`` of the rows whose vector has ``dims`` finite components: floor(scale * x), kept within ``LARGEST``."""
    vec = F.col(f"`{vec_col}`")
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    least, most = F.lit(float(-LARGEST)), F.lit(float(LARGEST))
    number = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, least), most)).cast("int")
    kept = vectors.filter((F.size(vec) == dims) & F.forall(vec, usable))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(vec, number).alias("ints"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``; fewer if there are not as many.

    Ties (rows with one id) go by the components, rows without an id come last.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(digest.alias("digest"), "ints").orderBy(F.col("digest").asc_nulls_last(), "ints").limit(k)
    rows = sorted(first.collect(), key=lambda r: (r["digest"] is None, r["digest"], r["ints"]))
    return np.array([r["ints"] for r in rows], np.int64)


def _moments(kept: DataFrame, dims: int) -> tuple[np.ndarray, ...]:
    """Least, most, mean and standard deviation by dimension; a row of sums per task reaches the last step."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("ints").flatten().to_numpy().reshape(-1, dims).astype(np.float64)
                n = np.full(dims, float(len(x)))
                rows = np.stack([np.arange(dims, dtype=float), x.min(0), x.max(0), n, x.sum(0), (x * x).sum(0)])
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["d", "least", "most", "n", "s", "q"])

    parts = kept.select("ints").mapInArrow(some, "d double, least double, most double, n double, s double, q double")
    sums = parts.groupBy("d").agg(F.min("least"), F.max("most"), F.sum("n"), F.sum("s"), F.sum("q")).orderBy("d").collect()
    _, least, most, n, s, q = np.array([tuple(r) for r in sums]).T
    return least.astype(np.int64), most.astype(np.int64), s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))


def _encoded(kept: DataFrame, cells: Cells, dims: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = batch.column("ints").flatten().to_numpy().reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _binary(cells.code(x)), _binary(x.astype("<i4"))], names=["id", "cells", "vector"])

    return kept.mapInArrow(encode, "id long, cells binary, vector binary")


def _need(file: DataFrame, dims: int, *lookups: np.ndarray) -> DataFrame:
    """``file`` with ``found``: the cluster that the intervals give under each set of centroids, -1 where they overlap."""

    @F.arrow_udf("array<int>")
    def look(cells: pa.Array) -> pa.Array:
        parts = []
        codes = _numbers(cells, "u1", dims)
        for start in range(0, len(codes), AT_ONCE):
            answers = [nearest_by_cells(codes[start : start + AT_ONCE], lookup) for lookup in lookups]
            parts.append(np.stack([np.where(open_, -1, best) for best, open_ in answers], axis=1))
        rows = np.concatenate(parts) if parts else np.zeros((0, len(lookups)), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(lookups), pa.int32()), pa.array(rows.reshape(-1), pa.int32()))

    return file.withColumn("found", look("cells"))


def _found(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return batch.column("found").flatten().to_numpy().reshape(-1, n)


def _settled(found: np.ndarray, vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The clusters, with full vectors where the intervals overlapped."""
    open_ = found < 0
    out = found.astype(np.int64)
    if open_.any():
        out[open_] = squared(vectors[open_], centroids).argmin(axis=1)
    return out


def _changes(file: DataFrame, dims: int, cells: Cells, old: np.ndarray | None, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By cluster the count and the sum of the vectors that come under ``new``, less those it loses from ``old``.

    Vectors whose intervals give the same cluster under both are never fetched.
    """
    k = len(new)
    steps = [c for c in (old, new) if c is not None]
    looked = _need(file, dims, *[cells.table(c) for c in steps])
    if old is not None:
        looked = looked.filter((F.element_at("found", 1) < 0) | (F.element_at("found", 1) != F.element_at("found", 2)))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in _slices(batches):
            found, x = _found(batch, len(steps)), _numbers(batch.column("vector"), "<i4", dims).astype(np.int64)
            sides = [_settled(found[:, i], x, c) for i, c in enumerate(steps)]
            for sign, side in zip((1,) if old is None else (-1, 1), sides):
                for c in np.unique(side):
                    total[c, 0] += sign * (side == c).sum()
                    total[c, 1:] += sign * x[side == c].sum(axis=0)
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1))], names=["at", "n"])

    parts = looked.select("found", "vector").mapInArrow(moved, "at long, n long")
    sums = parts.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = np.zeros(k * (dims + 1), object)
    for r in sums.collect():  # k times dims + 1 numbers
        out[r["at"]] = int(r["n"])
    out = out.reshape(k, dims + 1)
    return out[:, 0], out[:, 1:]


@dataclass(frozen=True)
class Clustering:
    rows: DataFrame
    centroids: np.ndarray


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    bits: int = 8,
    dims: int = 64,
    scale: int = 1024,
    seed: int = 3,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> Clustering:
    """Lloyd's rounds in whole numbers: ``rows`` has ``(id, cluster, distance, cluster_inertia, inertia)``.

    The vectors are written once with their cells (``bits`` a component). A round reads them in one pass without a
    shuffle: lookup tables give an interval per centroid, and a vector goes on to the step that reads it
    whole only if intervals overlap or its cluster changes, for only these change the sums. The
    cluster under the last centroids follows from the cells again, so no state is kept between rounds and a lost
    executor costs its tasks alone. The driver holds the centroids and their sums.

    Cases: vectors of another length, null vectors and those with a null or non-finite component have no row;
    components beyond ``LARGEST`` after scaling count as ``LARGEST``; with fewer vectors than ``k`` there are as many
    clusters as vectors; repeated rows and ids each count; a missing id starts no cluster unless others run
    out; an empty table gives no rows; sums beyond 63 bits are null.
    """
    kept = whole_vectors(vectors, dims, scale, id_col, vec_col)
    centroids = first_centroids(kept, k, seed)
    k = len(centroids)
    if not k:
        empty = "id long, cluster int, distance long, cluster_inertia long, inertia long"
        return Clustering(vectors.sparkSession.createDataFrame([], empty), centroids.reshape(0, dims))
    cells = Cells.spread(*_moments(kept, dims), bits)
    file = stored(_encoded(kept, cells, dims))
    count, total, last = np.zeros(k, object), np.zeros((k, dims), object), None
    for _ in range(rounds):
        more, sums = _changes(file, dims, cells, last, centroids)
        count, total = count + more, total + sums
        moved = np.array([[x // n for x in row] if n else c for row, n, c in zip(total, count, centroids.tolist())], np.int64)
        if (moved == centroids).all():  # further rounds would change nothing
            break
        last, centroids = centroids, moved
    looked = _need(file, dims, cells.table(centroids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _numbers(batch.column("vector"), "<i4", dims).astype(np.int64)
            side = _settled(_found(batch, 1)[:, 0], x, centroids)
            apart = x - centroids[side]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(side, pa.int32()), pa.array((apart * apart).sum(axis=1))], names=["id", "cluster", "distance"])

    rows = stored(looked.select("id", "found", "vector").mapInArrow(place, "id long, cluster int, distance long"))
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()  # k rows
    by = {r["cluster"]: int(r["n"]) for r in sums}
    fits = lambda n: F.lit(n if n < 2**63 else None).cast("long")
    inertia: Column = F.lit(None).cast("long")
    for c, n in by.items():
        inertia = F.when(F.col("cluster") == c, fits(n)).otherwise(inertia)
    return Clustering(rows.withColumns({"cluster_inertia": inertia, "inertia": fits(sum(by.values()))}), centroids)


CLUSTER_ROUND = """
near{r} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) AS d FROM kept, mid{r}
  ) GROUP BY vec_id, v
)"""
CLUSTER_MOVE = """
mid{n} AS MATERIALIZED (
  SELECT m.c, coalesce(x.w, m.w) AS w FROM mid{r} m LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM (
      SELECT cluster AS c, i, sum(v[i]) AS s, count(*) AS n FROM near{r}, unnest(range(1, 65)) u(i) GROUP BY cluster, i
    ) GROUP BY c
  ) x ON m.c = x.c
)"""
CLUSTER_SQL = (
    """
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), mid0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS c, v AS w FROM kept
  ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) LIMIT 8
),"""
    + ",".join(f"{CLUSTER_ROUND.format(r=r)},{CLUSTER_MOVE.format(r=r, n=r + 1)}" for r in range(10))
    + ","
    + CLUSTER_ROUND.format(r=10)
    + """
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(w, ',')) AS centroid_sha256
FROM near10 JOIN mid10 ON c = cluster
"""
)


@query("op12_va_file_clusters", CLUSTER_SQL)
def va_file_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cluster(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in done.centroids.tolist()]
    digest = F.element_at(F.array(*[F.lit(d) for d in digests] or [F.lit("")]), F.col("cluster") + 1)
    return done.rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
