"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.archives import store
from sheetwise.llm.registry import query, table
from sheetwise.llm.text import LOWER, UPPER, rows_kept
from sheetwise.session import checkpoint_folder, settle

#: every ASCII byte that is no letter or digit ends a word; A-Z become a-z
WORD_BYTES = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else LOWER.encode()[UPPER.encode().index(c)] if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)
MADE = ["n_words", "n_hit", "hit_spans", "items", "contaminated"]
#: blocks of tables that a worker keeps
KEPT = 4
FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
FOUND_ARROW = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class ShiftTables:
    """Wu-Manber tables for the test strings of one length.

    ``shift`` says for a block of two words how far the search may move on when it ends here; 0 means
    that some test string ends with the block, and ``ends`` lists those.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.free = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ends: dict[tuple[bytes, ...], list[tuple[list[bytes], set[str]]]] = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                block = words[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.free), length - end)
            self.ends[words[-self.block :]].append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Where a test string starts, and the items that hold it."""
        shift, free, length, block = self.shift.get, self.free, self.length, self.block
        at, n = length, len(words)
        while at <= n:
            seen = tuple(words[at - block : at])
            step = shift(seen, free)
            if step:
                at += step
                continue
            for pattern, items in self.ends[seen]:
                if words[at - length : at] == pattern:
                    yield at - length, items
            at += 1


def matcher(windows: list[tuple[str, str]]) -> list[ShiftTables]:
    """Tables for (words joined by a space, item id) pairs, one per length."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    interned: dict[bytes, bytes] = {}
    for window, item in windows:
        words = tuple(interned.setdefault(w, w) for w in window.encode("utf-8", "surrogatepass").split(b" "))
        by_length[len(words)][words].add(item)
    return [ShiftTables(patterns, length) for length, patterns in sorted(by_length.items())]


def find(tables: list[ShiftTables], text: str | None, before: dict | None = None) -> dict:
    words = words_of(text)
    spans = [(s["start"], s["end"]) for s in before["spans"]] if before else []
    items = set(before["items"]) if before else set()
    for t in tables:
        for start, found in t.search(words):
            spans.append((start, start + t.length))
            items |= found
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    return {"n_words": len(words), "spans": [{"start": s, "end": e} for s, e in merged], "items": sorted(items)}


def item_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """The distinct (window, item) pairs; an item of fewer words, but not none, is one window."""

    def cut(batches):
        for batch in batches:
            pairs = set()
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    pairs.add((b" ".join(words[i : i + window]).decode("utf-8", "surrogatepass"), item))
            rows = sorted(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["window", "item"])

    item = F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null"))
    return benchmark.select(item.alias("item"), F.col(f"`{text_col}`")).mapInArrow(cut, "window string, item string").distinct()


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    block_windows: int = 50_000,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``hit_spans``, ``items`` and ``contaminated``.

    A word is a run of ASCII letters and digits (A-Z lower-cased) and all other characters beyond ASCII. The
    test strings are the windows of ``window`` consecutive words of an item; an item of fewer words, but
    not none, is one test string. Every occurrence in a document marks its words; ``hit_spans`` are the
    merged word ranges [start, end), ``items`` the sorted ids of the items with an occurrence.

    Each task searches with shift tables over blocks of two words: most positions are skipped, the
    block that ends a test string selects candidates and a direct comparison confirms them. The test strings
    are written to the checkpoint folder in blocks of about ``block_windows``, from which a task makes its tables;
    a worker keeps up to ``KEPT`` blocks. With more of them, each batch of documents meets one block after
    another, so memory does not grow with the benchmark and the documents are read once, never shuffled
    and never written.

    Cases: a null or empty text has no words and no hits; a missing item id is named "null"; repeated rows
    and repeated items change nothing; an empty benchmark leaves every document clean. Input columns
    that carry the name of a result are replaced.
    """
    spark = docs.sparkSession
    windows = settle(item_windows(benchmark, window, item_col, item_text_col))
    blocks = max(1, math.ceil(windows.count() / block_windows))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)))
    folder = f"{checkpoint_folder(spark)}/table-{uuid.uuid4()}"
    windows.repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    filled = sorted(r[0] for r in windows.select("block").distinct().collect())

    @F.arrow_udf(FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        system, path = store(folder)
        known: dict[int, list[ShiftTables]] = {}

        def tables(block: int) -> list[ShiftTables]:
            if block in known:
                return known[block]
            pairs = dataset.dataset(f"{path}/block={block}", schema=pa.schema([("window", pa.string()), ("item", pa.string())]), filesystem=system, format="parquet").to_table()
            made = matcher(list(zip(pairs["window"].to_pylist(), pairs["item"].to_pylist())))
            if len(filled) <= KEPT:
                known[block] = made
            return made

        for texts in batches:
            found = None
            for block in filled:
                mine = tables(block)
                found = [find(mine, t.as_py(), found and found[i]) for i, t in enumerate(texts)]
            yield pa.array(found if filled else [find([], t.as_py()) for t in texts], FOUND_ARROW)

    names = [c for c in docs.columns if c.lower() not in MADE]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], search(F.col(f"`{text_col}`")).alias("__found"))
    hit = F.aggregate("__found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    results = [F.col("__found.n_words").alias("n_words"), hit.alias("n_hit"), F.col("__found.spans").alias("hit_spans"), F.col("__found.items").alias("items")]
    return rows.select(*[F.col(f"`{c}`") for c in names], *results, (F.size("__found.spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents in which no test string occurs, with the columns they came with."""
    return rows_kept(docs, lambda d: find_contamination(d, benchmark, **kw).filter(~F.col("contaminated")), MADE)


CONTAMINATION_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), test AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS w
  FROM item, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0
), hits AS (
  SELECT d.doc_id, d.i, t.n, t.item_id
  FROM (SELECT doc_id, i, l.n, array_to_string(ws[i : i + l.n - 1], ' ') AS w
        FROM doc, (SELECT DISTINCT n FROM test) l, unnest(range(1, len(ws) - l.n + 2)) AS u(i)) d
  JOIN test t ON d.w = t.w AND d.n = t.n
), words AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS u(k) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(w.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.list, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN words w ON d.doc_id = w.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""


@query("op9_decontaminate", CONTAMINATION_SQL)
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
