"""What a chain of filters does together: survivors of every subset and every order, from one word per document."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.registry import query, table
from sheetwise.llm.stored import stored
from sheetwise.llm.text import SPACE, UPPER, row_id

#: a word has a bit per subset of the filters, so five filters fill 32 bits
MOST = 5
#: what is counted: all documents, those labelled good and those labelled toxic
KINDS = ("all", "good", "toxic")
#: a task hands its counts on when it has met so many parts
PARTS_AT_ONCE = 1_024

Condition = Callable[[Column], Column]


def survival_words(n: int) -> list[int]:
    """For each set of failed filters (a bit mask) the word whose bit s says that subset s removes nothing."""
    return [sum(1 << s for s in range(2**n) if not s & failed) for failed in range(2**n)]


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set.

    Carry-save adders take three words of one weight to a sum of that weight and a carry of twice the weight, all
    32 columns at once; two words at most are left per weight and only these are unpacked.
    """
    total, weight, level = np.zeros(32, np.int64), 1, np.ascontiguousarray(words, "<u4")
    while len(level):
        carries = []
        while (third := len(level) // 3) > 0:
            a, b, c, rest = level[:third], level[third : 2 * third], level[2 * third : 3 * third], level[3 * third :]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            level = np.concatenate([odd ^ c, rest])
        total += weight * np.unpackbits(level.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return total


def subset_survivors(words: DataFrame) -> DataFrame:
    """``(part, survivors)``: for each kind of document and each subset of the filters the documents it leaves.

    ``words`` has ``part``, ``word``, ``good`` and ``toxic``. ``survivors`` is an array of 32 counts for each of
    ``KINDS``. Tasks return sums, so a part with a third of all documents is a few rows for each task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            counts = pa.array([list(v) for v in sums.values()], pa.list_(pa.int64()))
            batch = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), counts], names=["part", "counts"])
            sums.clear()
            return batch

        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            word, code = batch.column("word").to_numpy().astype(np.uint32), coded.indices.to_numpy()
            marks = [batch.column(k).to_numpy(zero_copy_only=False) for k in KINDS[1:]]
            order = np.argsort(code, kind="stable")
            borders = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
            for part, start, end in zip(coded.dictionary.to_pylist(), borders, borders[1:]):
                rows = order[start:end]
                some = [positional_popcount(word[rows]), *(positional_popcount(word[rows[m[rows]]]) for m in marks)]
                sums[part] = sums.get(part, 0) + np.concatenate(some)
            if len(sums) > PARTS_AT_ONCE:
                yield out()
        yield out()

    sums = words.select("part", "word", *KINDS[1:]).mapInArrow(count, "part string, counts array<long>")
    cells = sums.select("part", F.posexplode("counts").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    # at most 96 cells a part
    return cells.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda c: c["n"]).alias("survivors"))


def judged(
    docs: DataFrame,
    labels: DataFrame,
    conditions: dict[str, Condition],
    repeats: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """A row ``(id, part, failed, word, good, toxic)`` per document: a bit per failed filter and the survival word.

    A condition says of a text whether it fails. ``repeats`` names a further filter, failed by documents whose
    text a smaller id has too. Texts are read once; only ids, digests and marks are shuffled, and only digests
    that several ids share come back to their documents.

    Cases: a null text is empty and equal to other empty texts; a missing id counts as the smallest, and has no
    label; rows that share an id do not fail each other as repeats; of several labels of a document one is
    enough; a null part is the empty one; further columns play no role; an empty table gives no rows.
    """
    letters = [*conditions, *([repeats] if repeats else [])]
    if len(letters) > MOST:
        raise ValueError(f"{len(letters)} filters do not fit into a 32-bit word")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bits = [F.when(fails(F.col("text")), 1 << i).otherwise(0) for i, fails in enumerate(conditions.values())]
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    raw = docs.select(row_id(id_col).alias("id"), part.alias("part"), text.alias("text"))
    marks = raw.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("failed"))
    if repeats:
        marks = stored(marks)
        shared = marks.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
        shared = stored(shared.select("digest", "first"))
        again = F.when(F.col("id") > F.col("first"), 1 << len(conditions)).otherwise(0)
        marks = marks.join(shared, "digest", "left").select("id", "part", (F.col("failed") + again).alias("failed"))
    known = labels.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    )
    known = known.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    words = F.array(*[F.lit(w).cast("long") for w in survival_words(len(letters))])
    no = F.lit(False)
    return marks.join(known, "id", "left").select(
        "id", "part", "failed", F.element_at(words, F.col("failed") + 1).alias("word"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    )


def orders_of(survivors: DataFrame, letters: Sequence[str]) -> DataFrame:
    """Every order of the filters step by step, from ``(part, survivors)``.

    A step's filter comes after those before it in the order. ``kept`` and ``removed`` are the documents it leaves and
    takes, ``redundant`` those that fail it but were gone, ``unique_fails`` those that fail it alone,
    ``good_lost`` and ``toxic_lost`` the labelled ones it takes, ``shapley`` what it takes over all orders together.
    """
    n, everything = len(letters), 2 ** len(letters) - 1
    orders = F.split(F.lit(" ".join("".join(map(str, order)) for order in itertools.permutations(range(n)))), " ")
    names = F.array(*[F.lit(x) for x in letters])

    def left(kind: str, subset: Column | int) -> Column:
        return F.element_at("survivors", F.lit(KINDS.index(kind) * 32 + 1) + subset)

    def taken(kind: str, before: Column | int, after: Column | int) -> Column:
        return left(kind, before) - left(kind, after)

    def over_all_orders(f: int) -> Column:
        others = [s for s in range(2**n) if not s >> f & 1]
        ways = [math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) for s in others]
        return sum((taken("all", s, s | 1 << f) * w for s, w in zip(others, ways)), F.lit(0).cast("long"))

    per_filter = {
        "fails": [taken("all", 0, 1 << f) for f in range(n)],
        "alone": [taken("all", everything & ~(1 << f), everything) for f in range(n)],
        "shapley": [over_all_orders(f) for f in range(n)],
    }
    wide = survivors.select("part", "survivors", *[F.array(*v).alias(c) for c, v in per_filter.items()], F.explode(orders).alias("order"))
    at = wide.select("*", F.posexplode(F.split("order", "")).alias("place", "filter")).withColumn("filter", F.col("filter").cast("int"))
    earlier = [F.when(F.instr("order", str(f)) <= F.col("place"), 1 << f).otherwise(0) for f in range(n)]
    at = at.withColumn("before", sum(earlier, F.lit(0)))
    at = at.withColumn("after", F.col("before") + F.element_at(F.array(*[F.lit(1 << f) for f in range(n)]), F.col("filter") + 1))
    order = F.transform(F.split("order", ""), lambda f: F.element_at(names, f.cast("int") + 1))
    here = F.col("filter") + 1
    removed = taken("all", F.col("before"), F.col("after"))
    return at.select(
        "part",
        F.array_join(order, "").alias("filter_order"),
        (F.col("place") + 1).alias("step"),
        left("all", F.col("after")).alias("kept"),
        removed.alias("removed"),
        (F.element_at("fails", here) - removed).alias("redundant"),
        F.element_at("alone", here).alias("unique_fails"),
        taken("good", F.col("before"), F.col("after")).alias("good_lost"),
        taken("toxic", F.col("before"), F.col("after")).alias("toxic_lost"),
        F.element_at("shapley", here).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Condition], repeats: str | None = None, **columns: str) -> DataFrame:
    """``orders_of`` the filters over ``judged`` documents: rows for each part, order and step, zeros included."""
    letters = [*conditions, *([repeats] if repeats else [])]
    return orders_of(subset_survivors(judged(docs, labels, conditions, repeats, **columns)), letters)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


# The limits and letters of the five filters.
FILTERS: dict[str, Condition] = {
    "A": lambda text: F.size(_words(text)) < 100,
    "B": lambda text: F.size(F.array_distinct(_words(text))) * 100 < F.size(_words(text)) * 80,
    "C": lambda text: (F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))) * 100 > F.char_length(text) * 10,
    "D": lambda text: text.rlike("[#$%&*|]"),
}

AUDIT_SQL = r"""
WITH letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), steps AS (
  SELECT filter_order, step, l.bit,
         (SELECT coalesce(sum(bit), 0) FROM letters WHERE contains(filter_order[1:step - 1], letter)) AS before
  FROM orders, unnest(range(1, 6)) u(step) JOIN letters l ON l.letter = filter_order[step]
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), firsts AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1
), failing AS (
  SELECT part,
         (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS f,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM texts JOIN firsts USING (t)
), counted AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM failing GROUP BY part, f
), done AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (f & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (f & before = 0 AND f & bit <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (f & before <> 0 AND f & bit <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (f = bit), 0) AS unique_fails,
         coalesce(sum(g) FILTER (f & before = 0 AND f & bit <> 0), 0) AS good_lost,
         coalesce(sum(x) FILTER (f & before = 0 AND f & bit <> 0), 0) AS toxic_lost
  FROM counted, (SELECT filter_order, step, bit, CAST(before AS INTEGER) AS before FROM steps) GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM done
"""


@query("op11_filter_interactions", AUDIT_SQL)
def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), FILTERS, repeats="E")
