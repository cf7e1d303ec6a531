"""Packing documents into sequences next to lexically similar ones, found in a sharded BM25 index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.registry import query, table
from sheetwise.llm.stored import stored
from sheetwise.llm.tokens import encoder_of_process

#: characters encoded at once
ENCODE_CHARS = 4_000_000
#: tokens in a batch of pieces that is handed on
OUT_TOKENS = 1_000_000
#: tokens whose distinct ones are counted at once, and postings a term has on average for them to be joined term by term
COUNTED, JOINED = 500_000, 32
#: terms in more than one of so many documents of an index are kept as rows
FREQUENT = 12
#: places of the word vectors by which documents are dealt, most cells, and documents the cells are learnt from (a cell)
PLACES, CELLS, LEARNT = 2_048, 512, 16
CODED = "id long, key long, deal long, size long, cell long, narrow boolean, tokens binary"
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _counted(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct tokens of each document in rising order and their counts, many documents at once; and how many each has."""
    lengths = np.array([len(d) for d in docs], np.int64)
    reached, low = np.cumsum(lengths), 0
    while low < len(docs):
        high = max(low + 1, int(np.searchsorted(reached, (reached[low - 1] if low else 0) + COUNTED, side="right")))
        if high == low + 1:
            found = np.unique(docs[low], return_counts=True)
            yield *found, np.array([len(found[0])])
        else:
            keys = np.repeat(np.arange(high - low, dtype=np.uint64) << np.uint64(32), lengths[low:high])
            keys |= np.concatenate(docs[low:high])
            keys.sort()
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
            counts, keys = np.diff(np.append(first, len(keys))), keys[first]
            terms = keys.astype(np.uint32).astype(np.result_type(*{d.dtype for d in docs[low:high]}))
            yield terms, counts, np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=high - low)
        low = high


class Bm25:
    """An inverted index of documents; terms are token ids, and a document is looked up by all of its own."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        self.n = len(docs)
        found = [(t, c.astype(np.float32), s) for t, c, s in _counted(docs)]
        terms = np.concatenate([t for t, _, _ in found]) if found else np.empty(0, np.uint32)
        counts = np.concatenate([c for _, c, _ in found]) if found else np.empty(0, np.float32)
        sizes = np.concatenate([s for _, _, s in found]) if found else np.empty(0, np.int64)
        del found
        doc = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        length = np.array([len(d) for d in docs], float)
        norm = (k1 * (1 - b + b * length / max(1.0, length.mean() if self.n else 1.0))).astype(np.float32)
        order = np.argsort(terms, kind="stable")
        terms, counts, self.doc = terms[order], counts[order], doc[order]
        first = np.flatnonzero(np.diff(terms.astype(np.int64), prepend=-1))
        held = np.diff(np.append(first, len(terms)))
        idf = np.log1p((self.n - held + 0.5) / (held + 0.5)).astype(np.float32)
        self.weight = counts * np.float32(k1 + 1) / (counts + norm[self.doc]) * np.repeat(idf, held)
        self.start, self.end, self.live = first, first + held, np.arange(self.n)
        # the terms of each document that another one also holds
        rank = np.empty(len(terms), np.int32)
        rank[order] = np.repeat(np.arange(len(first), dtype=np.int32), held)
        shared = held[rank] > 1
        self.terms, ends = rank[shared], np.cumsum(np.bincount(doc[shared], minlength=self.n))
        self.begins = [0, *ends.tolist()]
        # frequent terms also as rows over all documents, which are added faster than postings
        frequent = np.flatnonzero(held * FREQUENT > self.n)
        self.row = np.full(len(first), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), self.n), np.float32)
        for i, (lo, hi) in enumerate(zip(self.start[frequent].tolist(), self.end[frequent].tolist())):
            self.rows[i, self.doc[lo:hi]] = self.weight[lo:hi]
        self.views = list(self.rows)

    def forget(self, used: np.ndarray) -> np.ndarray:
        """Leave out the documents that are used, when they are a quarter of those still held; says which of the rest are used."""
        taken = used[self.live]
        left = len(taken) - np.count_nonzero(taken)
        if left * 4 > len(taken) * 3:
            return taken
        keep = ~taken
        for row in self.rows:  # in place: a copy of all rows would double the index
            row[:left] = row[keep]
        self.rows = self.rows[:, :left]
        self.views = list(self.rows)
        kept = keep[self.doc]
        before = np.concatenate([[0], np.cumsum(kept)])
        self.start, self.end = before[self.start], before[self.end]
        self.doc, self.weight = (np.cumsum(keep, dtype=np.int32) - 1)[self.doc[kept]], self.weight[kept]
        self.live = self.live[keep]
        return np.zeros(left, bool)

    def neighbours(self, seed: int, used: np.ndarray, most: int = 64) -> list[int]:
        """Unused documents by descending score (ties by position); empty if none shares a term."""
        taken = self.forget(used)
        terms = self.terms[self.begins[seed] : self.begins[seed + 1]]
        rows = self.row[terms]
        rare = terms[rows < 0]
        starts, ends = self.start[rare], self.end[rare]
        sizes = ends - starts
        total = int(sizes.sum())
        if total > JOINED * len(rare):
            parts = [slice(lo, hi) for lo, hi in zip(starts.tolist(), ends.tolist())]
            doc, weight = (np.concatenate([held[p] for p in parts]) for held in (self.doc, self.weight))
        else:
            at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
            doc, weight = self.doc[at], self.weight[at]
        score = np.bincount(doc, weight, len(self.live)).astype(np.float32)
        for i in rows[rows >= 0].tolist():
            np.add(score, self.views[i], score)
        np.putmask(score, taken, 0)
        best = np.argpartition(-score, most)[:most] if len(score) > most else np.arange(len(score))
        best = best[score[best] > 0]
        return self.live[best[np.lexsort((best, -score[best]))]].tolist()


def chain(docs: list[np.ndarray], length: int, room: int) -> Iterator[int]:
    """The order in which the documents of a shard fill windows of ``length`` tokens, ``room`` of the first being left.

    The document that begins a window is its seed; its unused neighbours fill the window in order of
    score, and the last, cut off at the window's end, seeds the next one.
    """
    index, used = Bm25(docs), np.zeros(len(docs), bool)
    free, waiting, seed, ranked = 0, room, None, []
    for _ in range(len(docs)):
        ranked = [d for d in ranked if not used[d]]
        if not ranked and seed is not None:
            ranked = index.neighbours(seed, used)
        if ranked:
            doc = ranked.pop(0)
        else:
            while used[free]:
                free += 1
            doc = free
        used[doc] = True
        if seed is None or len(docs[doc]) >= waiting:  # a new window begins with this document
            seed, ranked = doc, []
        waiting = length - (len(docs[doc]) - waiting) % length if len(docs[doc]) >= waiting else waiting - len(docs[doc])
        yield doc


def word_vector(ids: np.ndarray) -> np.ndarray:
    """Logarithms of term counts; terms are hashed to ``PLACES`` places."""
    return np.log1p(np.bincount((ids * np.uint32(2_654_435_761)) >> np.uint32(21), minlength=PLACES)).astype(np.float32)


def centres_of(vectors: np.ndarray, cells: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: the weights of the places and unit centres (columns), each beside one that is like it."""
    idf = np.log1p(len(vectors) / (1 + (vectors > 0).sum(0))).astype(np.float32)
    x = vectors * idf
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    cells = min(cells, len(x))
    chosen, near = [0], x @ x[0]
    while len(chosen) < cells:  # begins with documents that are unlike each other
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        at = (x @ centres.T).argmax(1)
        for c in np.unique(at).tolist():
            mean = x[at == c].sum(0)
            centres[c] = mean / max(1e-9, np.linalg.norm(mean))
    like, order, left = centres @ centres.T, [0], set(range(1, cells))
    while left:
        order.append(max(left, key=lambda c: (like[order[-1], c], -c)))
        left.remove(order[-1])
    return idf, np.round(centres[order], 4).T.copy()


def cells_of(vectors: np.ndarray, idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre and, within it, the second nearest."""
    like = (vectors * idf) @ centres
    if like.shape[1] < 2:
        return np.zeros(len(vectors), np.int64)
    two = np.argsort(-like, axis=1, kind="stable")[:, :2].astype(np.int64)
    return two[:, 0] * like.shape[1] + two[:, 1]


def places_of(sizes: dict[int, int], shard_bytes: int) -> tuple[list[tuple[int, int, int]], int]:
    """``(cell, first shard, shards)`` in the order of cells, and the number of shards.

    Cells follow each other in a shard as long as they fit; one above ``shard_bytes`` has shards of its own.
    """
    out, shard, held = [], 0, 0
    for cell, size in sorted(sizes.items()):
        if held and held + size > shard_bytes:
            shard, held = shard + 1, 0
        parts = max(1, math.ceil(size / shard_bytes))
        out.append((cell, shard, parts))
        shard, held = (shard + parts, 0) if parts > 1 else (shard, held + size)
    return out, shard + (held > 0)


def pack_documents(
    docs: DataFrame,
    length: int = 1024,
    end_id: int = 0,
    shard_bytes: int = 24 << 20,
    tokenizer_path: str | None = None,
    ranks_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The pieces ``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)`` of sequences of ``length`` tokens.

    A document is the ids of its whole text and ``end_id``. Documents are dealt over shards of about
    ``shard_bytes`` of text by their words: cells of like documents, learnt from up to ``CELLS * LEARNT`` of them, go
    to one shard whole; only a cell above ``shard_bytes`` is dealt over several, by a hash of the row and its place. A BM25
    index of the whole shard, looked up with all terms of the document that seeds a window, returns unused
    neighbours, and these fill it. Neighbours in another shard are not seen. Documents are cut where a window ends,
    so every sequence is full but the last of a shard. ``ids`` are little-endian 32-bit numbers.

    Texts are encoded once; their ids are written to the checkpoint folder and shuffled once; a task holds one
    shard. Cases: a null or empty text is the end id alone; a missing id stays missing; repeated rows are packed
    each; an empty table gives no piece.
    """
    spark = docs.sparkSession
    files = (tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # the place tells repeats of a row apart, when a cell of them is dealt
    rows = rows.withColumns({"key": F.xxhash64("id", "text"), "deal": F.xxhash64("id", "text", F.monotonically_increasing_id())})
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()

    def encoded(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """The ids of the texts in runs of about ``ENCODE_CHARS``, with the place each run begins at."""
        encoder, low = encoder_of_process(*files), 0
        sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + ENCODE_CHARS, side="right")))
            yield low, encoder.encode(texts.slice(low, high - low))
            low = high
            pa.default_memory_pool().release_unused()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, found in encoded(batch.column("text")):
                raw = [word_vector(d).astype("<f2").tobytes() for d in found]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(low, len(raw)), pa.array(raw, pa.binary())], names=["key", "vector"])

    model = None
    if total > shard_bytes:
        cells = min(CELLS, 2 * math.ceil(total / shard_bytes))
        some = rows.filter(F.pmod("key", F.lit(max(1, count // (cells * LEARNT)))) == 0).groupBy("key").agg(F.first("text").alias("text"))
        learnt = sorted(tuple(r) for r in some.mapInArrow(vectors, "key long, vector binary").collect())
        if learnt:
            known = np.frombuffer(b"".join(v for _, v in learnt), "<f2").reshape(-1, PLACES).astype(np.float32)
            model = spark.sparkContext.broadcast(centres_of(known, cells))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_of = pc.add(pc.cast(pc.binary_length(batch.column("text")), pa.int64()), 1)  # an empty text counts too
            for low, found in encoded(batch.column("text")):
                n = len(found)
                cell = cells_of(np.stack([word_vector(d) for d in found]), *model.value) if model else np.zeros(n, np.int64)
                narrow = [not len(d) or int(d.max()) < 1 << 16 for d in found]
                raw = [d.astype("<u2" if small else "<u4").tobytes() for d, small in zip(found, narrow)]
                columns = [*(batch.column(c).slice(low, n) for c in ("id", "key", "deal")), bytes_of.slice(low, n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell), pa.array(narrow), pa.array(raw, pa.binary())], names=[c.split()[0] for c in CODED.split(", ")])

    coded = stored(rows.mapInArrow(code, CODED))
    # at most CELLS squared rows reach the driver
    sizes = {r[0]: r[1] for r in coded.groupBy("cell").agg(F.sum("size")).collect()}
    places, shards = places_of(sizes, shard_bytes)
    dealt = spark.createDataFrame(places or [(0, 0, 1)], "cell long, first int, parts int")
    shard = (F.col("first") + F.pmod("deal", F.col("parts").cast("long"))).cast("int")
    placed = coded.join(F.broadcast(dealt), "cell").select("id", "key", "narrow", "tokens", shard.alias("shard"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, at = TaskContext.get().partitionId() << 33, 0
        names = [c.split()[0] for c in PIECE.split(", ")]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(zip(*out))], names=names)

        def packed(ids: list[int | None], tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, at
            out, made = [], 0
            for d in chain(tokens, length, length - at):
                mine, start = tokens[d], 0
                raw = mine.astype("<u4").tobytes()  # bytes: arrays of memoryviews are never freed by Arrow
                while start < len(mine):
                    n = min(length - at, len(mine) - start)
                    out.append((ids[d], start, n, len(mine), sequence, at, raw[4 * start : 4 * (start + n)]))
                    start, at = start + n, at + n
                    if at == length:
                        sequence, at = sequence + 1, 0
                made += len(mine)
                if made >= OUT_TOKENS:
                    yield batch_of(out)
                    out, made = [], 0
            if out:
                yield batch_of(out)

        ids, tokens = [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            for small, raw in zip(batch.column("narrow").to_pylist(), batch.column("tokens")):
                kind = "<u2" if small else "<u4"
                tokens.append(np.append(np.frombuffer(raw.as_buffer(), kind), np.array([end_id], kind)))  # a copy
        del batches
        pa.default_memory_pool().release_unused()
        if ids:
            yield from packed(ids, tokens)

    return placed.repartitionById(max(1, shards), "shard").sortWithinPartitions("key", "id").select("id", "narrow", "tokens").mapInArrow(pack, PIECE)


def pieces_with_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_bm25_packing")
def bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_with_digests(pack_documents(table(spark, sf_dir, "documents")))
