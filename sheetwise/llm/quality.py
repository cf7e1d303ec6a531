"""Quality rules: statistics of a text, and an isolation forest over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.registry import query, table
from sheetwise.llm.stored import stored
from sheetwise.llm.text import SPACE, row_id, rows_kept
from sheetwise.session import settle

# What counts as a symbol, and the ASCII punctuation.
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: bytes that are no character of a word: white space, and all but the first byte of a character
NOT_COUNTED = SPACE.encode() + bytes(range(0x80, 0xC0))

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIELDS = [*BASE, "n_punctuation", "n_distinct_words"]
STATS = f"struct<{','.join(f'{f}:bigint' for f in FIELDS)}>"
MADE = ["stats", "base_failed", "score_step", "kept"]
#: words whose windows are repeated are found in windows of so many
WINDOW = 5


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """The words that lie in a window of ``WINDOW`` words found twice or more in the text."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    key, size = ids[:n], kinds
    for j in range(1, WINDOW):
        if size * kinds >= 2**62:  # number the prefixes anew, so that keys stay exact
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max()) + 1
        key, size = key * kinds + ids[j : n + j], size * kinds
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    inside = np.zeros(len(ids), bool)
    for j in range(WINDOW):
        inside[j : n + j] |= counts[at] > 1
    return int(inside.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of ``FIELDS`` of one whole text; a null or empty text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(raw.translate(None, NOT_COUNTED)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(numbers)),
        len(raw) - len(raw.translate(None, PUNCTUATION)),
        len(numbers),
    )


def statistics_of(text: Column) -> Column:
    @F.arrow_udf(STATS)
    def each(texts: pa.Array) -> pa.Array:
        rows = [statistics(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FIELDS))], names=FIELDS)

    return each(text)


def features(stats: np.ndarray) -> np.ndarray:
    """Rates that do not depend on a text's length, from columns in the order of ``FIELDS``."""
    words, chars, symbols, _, repeats, punctuation, distinct = np.maximum(stats, 0).T
    return np.column_stack([x / np.maximum(words, 1) for x in (chars, symbols, repeats, punctuation, distinct)])


def expected_path(n: np.ndarray) -> np.ndarray:
    """The mean path of an unsuccessful search among n values, by which path lengths are normalised."""
    n = np.asarray(n, float)
    more = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, more, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Isolation trees as complete binary trees: feature, threshold and, where a path ends, its length."""

    feature: np.ndarray
    threshold: np.ndarray
    ends: np.ndarray  # the path length of a leaf, -1 for an inner node
    norm: float

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, subsample: int, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        size = min(subsample, len(sample))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (depth + 1) - 1
        feature, threshold, ends = np.zeros((trees, nodes), np.int16), np.zeros((trees, nodes)), np.full((trees, nodes), -1.0)
        for t in range(trees):
            todo = [(0, 0, sample[rng.choice(len(sample), size, replace=False)])]
            while todo:
                node, level, rows = todo.pop()
                low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
                varied = np.flatnonzero(high > low)
                if level == depth or not len(varied):
                    ends[t, node] = level + expected_path(len(rows))
                    continue
                f = rng.choice(varied)
                cut = rng.uniform(low[f], high[f])
                feature[t, node], threshold[t, node] = f, cut
                todo += [(2 * node + 1, level + 1, rows[rows[:, f] < cut]), (2 * node + 2, level + 1, rows[rows[:, f] >= cut])]
        return cls(feature, threshold, ends, max(float(expected_path(size)), 1.0))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Near 1 for what few random splits set apart, 0.5 and less for what lies among the rest."""
        total, at_row = np.zeros(len(rows)), np.arange(len(rows))
        for feature, threshold, ends in zip(self.feature, self.threshold, self.ends):
            node = np.zeros(len(rows), np.int64)
            while (inner := ends[node] < 0).any():
                down = 2 * node + 1 + (rows[at_row, feature[node]] >= threshold[node])
                node = np.where(inner, down, node)
            total += ends[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


#: scores are compared in so many steps
STEPS = 2_000


def _failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (stats["n_repeat_words"] * 100 > stats["n_words"] * 20)


def _scorer(forest: Forest):
    @F.arrow_udf("int")
    def step(stats: pa.Array) -> pa.Array:
        values = np.column_stack([stats.field(i).to_numpy(zero_copy_only=False) for i in range(len(FIELDS))])
        return pa.array((forest.score(features(values)) * STEPS).astype(np.int32))

    return step


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    trees: int = 100,
    subsample: int = 256,
    caution: float = 3.0,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """The documents with ``stats``, ``base_failed``, ``score_step`` and ``kept``.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in repeated windows of five.
    An isolation forest over rates of the statistics scores the rest. It is fitted on at most ``trees`` *
    ``subsample`` labelled rows, chosen by a hash of their id; this bound is the only sample.
    The threshold is set on all labelled rows that pass the base rules: the score that maximises the share
    of bad rows (``quality`` 0) rejected less ``caution`` times the share of good rows rejected. A document is
    kept if it passes the base rules and scores below the threshold. Counts by score step and label are all
    that reaches the driver besides the sample. Statistics are computed once: the rows are written with them
    (without the text if ``with_text`` is false) and read again for the verdict.

    Cases: a null or empty text has no words and fails; a missing label is no label, repeated labels of a
    document count each; without labelled rows of both kinds only the base rules decide; repeated rows are
    judged alike; input columns named like a result are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in MADE]
    text = F.col(f"`{text_col}`")
    marked = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), "quality")
    carried = [F.col(f"`{c}`") for c in names if with_text or c != text_col]
    tagged = docs.select(*carried, row_id(id_col).alias("__id"), statistics_of(text).alias("stats"))
    tagged = stored(tagged.withColumn("base_failed", _failed(F.col("stats"))))
    known = tagged.select(F.col("__id").alias("id"), "stats").join(marked, "id").filter(~_failed(F.col("stats")))
    known = settle(known)
    tagged = tagged.drop("__id")
    bound = trees * subsample
    share = min(1.0, 1.2 * bound / max(1, known.count()))
    order = F.xxhash64(F.lit(seed), "id")
    drawn = known.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.orderBy(F.pmod(order, F.lit(1 << 30)), "id", "stats").limit(2 * bound).select("id", "stats.*")
    picked = [tuple(r)[1:] for r in sorted(drawn.collect(), key=lambda r: (xxhash.xxh64_intdigest(str(r["id"])), tuple(r)))][:bound]
    if not picked:
        return tagged.withColumns({"score_step": F.lit(None).cast("int"), "kept": ~F.col("base_failed")})
    forest = Forest.fit(features(np.array(picked, np.float64)), trees, subsample, seed)
    step = _scorer(forest)
    counts = np.zeros((2, STEPS + 2))
    for r in known.groupBy(step("stats").alias("step"), "quality").count().collect():
        counts[r["quality"], r["step"]] += r["count"]
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows that score a step or more
    cut = STEPS + 1
    if counts[0].sum() and counts[1].sum():
        gain = above[0] / counts[0].sum() - caution * above[1] / counts[1].sum()
        cut = int(len(gain) - 1 - np.argmax(gain[::-1]))
    scored = tagged.withColumn("score_step", step("stats"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score_step") < cut))


def keep_good(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    return rows_kept(docs, lambda d: apply_rules(d, labels, **kw).filter("kept"), MADE)


@query("op3_quality_forest")
def quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), with_text=False)
    return ruled.select("doc_id", *[f"stats.{f}" for f in BASE], "base_failed", "kept", "score_step")
