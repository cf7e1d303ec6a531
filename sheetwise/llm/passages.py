"""Substring deduplication: passages that repeat across documents, by FM-indexes over shards of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.fm_index import FmIndex
from sheetwise.llm.registry import query, table
from sheetwise.llm.stored import stored
from sheetwise.llm.text import row_id, without

#: words of the stretch that decides where a window is sent
ANCHOR = 10
#: words by which the stretch is widened for anchors with too many different surroundings; the last reaches a whole window
WIDER = (0, 10, 20, 10**6)
#: windows in one run at most
RUN = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
RUN_ROW = "id long, hash long, at long, n long, route long, body long"


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []  # bytes: splits at ASCII white space


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


class Stretches:
    """Hashes of any stretch of words, from sums of powers modulo 2**64."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
        self.back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, BACK)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes + BASE) * power[:n], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, size = x, 1
    while size < width:
        step = min(size, width - size)
        out = np.minimum(out[:-step], out[step:])
        size += step
    return out


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest number in each stretch of ``width``; two numbers a place are held."""
    out, at, size = x, np.arange(len(x)), 1
    while size < width:
        step = min(size, width - size)
        right = out[step:] < out[:-step]
        out, at = np.where(right, out[step:], out[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    return at


def runs_of(hashes: np.ndarray, starts: np.ndarray, window: int, wider: int) -> tuple[np.ndarray, ...]:
    """The windows at ``starts`` (ascending), as runs of neighbours that go the same way: at, n, route, body.

    A window's anchor is its stretch of ``ANCHOR`` words with the smallest hash, so equal windows have equal
    anchors. ``wider`` adds that many words of the window: those before the anchor if there are as many,
    otherwise those there are and the rest behind it. ``body`` is a hash of all words of the run.
    """
    stretch, grams = Stretches(hashes), min(ANCHOR, window)
    gram = stretch(np.arange(len(hashes) - grams + 1), np.arange(grams, len(hashes) + 1))
    span = window - grams + 1
    if wider:
        anchor = sliding_argmin(gram, span)[starts]
        wider = min(wider, window - grams)
        first = anchor - np.minimum(anchor - starts, wider)
        first = np.minimum(first, starts + window - grams - wider)
        route = stretch(first, first + grams + wider)
    else:
        route = sliding_min(gram, span)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (route[1:] != route[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(head, np.diff(np.append(head, len(starts))))
    head = np.flatnonzero(place % RUN == 0)  # very long runs are cut
    n = np.diff(np.append(head, len(starts)))
    at = starts[head]
    return at, n, route[head], stretch(at, at + n + window - 1)


def _batch(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    made = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.uint64, copy=False).view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in made], names=names)


def find_runs(docs: DataFrame, window: int, wider: int) -> DataFrame:
    """The runs of all windows of the texts in ``(id, hash, text)``, or of those in ``spans`` where that column is given."""
    spanned = "spans" in docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for row in range(batch.num_rows):
                hashes = hashes_of(words_of(batch.column("text")[row].as_py()))
                count = len(hashes) - window + 1
                if count <= 0:
                    continue
                starts = np.arange(count)
                if spanned:
                    starts = np.unique(np.concatenate([np.arange(s["at"], s["at"] + s["n"]) for s in batch.column("spans")[row].as_py()]))
                found = runs_of(hashes, starts, window, wider)
                for column, value in zip(out, (batch.column("id")[row].as_py(), batch.column("hash")[row].as_py())):
                    column.append(np.full(len(found[0]), value))
                for column, value in zip(out[2:], found):
                    column.append(value)
            yield _batch(out, ["id", "hash", "at", "n", "route", "body"])

    return docs.mapInArrow(cut, RUN_ROW)


def texts_of(docs: DataFrame, spans: DataFrame, few: int = 500_000) -> DataFrame:
    """The documents that have ``spans``, joined to them.

    Up to ``few`` of them (counted) are first sought by a broadcast of their two numbers, so that
    only their texts are shuffled.
    """
    if spans.count() <= few:
        docs = docs.join(F.broadcast(spans.select("id", "hash")), ["id", "hash"], "left_semi")
    return docs.join(spans, ["id", "hash"])


def shared_runs(docs: DataFrame, window: int, route_bodies: int) -> tuple[DataFrame, DataFrame]:
    """The runs whose route leads to more than one document, and their different bodies with ``kinds`` per route.

    A route with more than ``route_bodies`` different bodies is divided by wider anchors; the widest is the
    window itself, of which there is one body.
    """
    todo, runs, bodies = docs, [], []
    for wider in WIDER:
        all_runs = stored(find_runs(todo, window, wider))
        ends = all_runs.groupBy("route").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        # written first: a join of two plain exchanges can be split where one route is hot
        several = stored(ends.filter("low < high").select("route"))
        level = stored(all_runs.join(several, "route", "left_semi"))
        first = F.min(F.struct("id", "hash", "at", "n")).alias("first")
        kinds = stored(level.groupBy("route", "body").agg(first))
        routes = stored(kinds.groupBy("route").agg(F.count("*").alias("kinds")))
        crowded = routes.filter((F.col("kinds") > route_bodies) & F.lit(wider < window)).select("route")
        if crowded.isEmpty():
            runs.append(level)
            bodies.append(kinds.join(routes, "route"))
            break
        runs.append(level.join(crowded, "route", "left_anti"))
        bodies.append(kinds.join(routes.join(crowded, "route", "left_anti"), "route"))
        spans = level.join(crowded, "route", "left_semi").groupBy("id", "hash").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
        todo = texts_of(docs, stored(spans))
    out = runs[0], bodies[0]
    for pair in zip(runs[1:], bodies[1:]):
        out = tuple(a.unionByName(b) for a, b in zip(out, pair))
    return out


def smallest_holders(docs: DataFrame, bodies: DataFrame, window: int, shard_words: int) -> DataFrame:
    """For each body ``(route, body, owners)``: per window the smallest id of a document that holds it.

    ``owners`` is null where a route has one body: then the body's smallest id holds for all its windows.
    """
    wanted = bodies.filter("kinds > 1").select("route", "body", "first.*")
    spans = wanted.groupBy("id", "hash").agg(F.collect_list(F.struct("route", "body", "at", "n")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["route", "body", "owner", "words"]
        for batch in batches:
            rows: list[tuple] = []
            for owner, text, spans in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "spans"))):
                words = words_of(text)
                for s in spans:
                    rows.append((s["route"], s["body"], owner, b" ".join(words[s["at"] : s["at"] + s["n"] + window - 1])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i == 3 else pa.int64()) for i in range(4)], names=names)

    cuts = texts_of(docs, stored(spans)).select("id", "text", "spans").mapInArrow(cut, "route long, body long, owner long, words binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def index(rows: list[tuple]) -> pa.RecordBatch:
            numbers: dict[bytes, int] = {}
            texts = [np.array([numbers.setdefault(w, len(numbers)) for w in r[3]], np.int64) for r in rows]
            fm = FmIndex(texts, np.array([r[2] for r in rows], np.int64), len(numbers), window)
            owners = fm.smallest_owners(texts)
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(owners, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["route", "body", "owners"])

        shard, held, last = [], 0, None
        for batch in batches:
            for route, body, owner, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (route, body) == (last, shard[-1][1] if shard else None):
                    continue  # a repeated row's text
                if held >= shard_words and route != last:
                    yield index(shard)
                    shard, held = [], 0
                shard.append((route, body, owner, words.split(b" ")))
                held, last = held + len(shard[-1][3]), route
        if shard:
            yield index(shard)

    return cuts.repartition("route").sortWithinPartitions("route", "body").mapInArrow(search, "route long, body long, owners array<long>")


def remove_repeats(
    docs: DataFrame, window: int = 50, route_bodies: int = 2_000, shard_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents without words that lie in a window whose words also start in a document with a smaller id.

    A window is ``window`` consecutive words (ASCII white space ends a word) of one document; all are judged on
    the input. ``text`` becomes the kept words joined by one space; ``n_words`` and ``n_removed`` are added
    (input columns of these names are replaced).

    Every window is sent where its anchor, the stretch with the smallest hash, leads; neighbouring windows
    go as one run. Routes that a single document uses are dropped on narrow rows, and equal runs are
    sent once, so a group of copies is one run. The different runs of a route are indexed in shards of about
    ``shard_words`` words: an FM-index in a wavelet matrix gives, by backward search of each run, the smallest
    id for every window. Routes with more than ``route_bodies`` different runs are divided by wider
    anchors first, at last by the window itself. Nothing is dropped by count.

    Cases: a null or empty text has no words and becomes empty; texts of fewer words than a window stay whole;
    rows with the same id do not count against each other; a missing id is the smallest; repeated rows are
    judged alike; an empty table gives none.
    """
    rows = docs.select(row_id(id_col).alias("id"), F.xxhash64(f"`{text_col}`").alias("hash"), F.col(f"`{text_col}`").alias("text"))
    runs, bodies = shared_runs(rows, window, route_bodies)
    holders = smallest_holders(rows, bodies, window, shard_words)
    known = bodies.select("route", "body", F.col("first.id").alias("least")).join(holders, ["route", "body"], "left")
    known = stored(known)
    places = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    hit = F.when(F.col("owners").isNull(), F.when(F.col("least") < F.col("id"), places).otherwise(F.array().cast("array<long>")))
    hit = hit.otherwise(F.filter(places, lambda i: F.get("owners", i.cast("int")) < F.col("id")))
    hits = runs.join(known, ["route", "body"]).select("id", "hash", F.transform(hit, lambda i: F.col("at") + i).alias("hits"))
    hits = hits.filter(F.size("hits") > 0).groupBy("id", "hash").agg(F.flatten(F.collect_list("hits")).alias("hits"))

    @F.arrow_udf("struct<text:string,n_words:bigint,n_removed:bigint>")
    def rebuild(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for text, starts in zip(texts, hits):
            words, starts = words_of(text.as_py()), np.array(starts.as_py() or [], np.int64)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.unique(starts), 1)
            np.add.at(edge, np.unique(starts) + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if len(starts) else words
            out.append({"text": b" ".join(kept).decode("utf-8", "surrogatepass"), "n_words": len(words), "n_removed": len(words) - len(kept)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())]))

    made = ("n_words", "n_removed")
    row = docs.select(F.struct(*without(docs, *made)).alias("row"), row_id(id_col).alias("id"), F.xxhash64(f"`{text_col}`").alias("hash"))
    joined = row.join(hits, ["id", "hash"], "left").withColumn("new", rebuild(F.col(f"row.`{text_col}`"), "hits"))
    same = [F.col("new.text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in made]
    return joined.select(*same, "new.n_words", "new.n_removed")


@query("op4_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
