"""Toxicity of texts: a convolutional classifier over hashed words, trained in numpy, scored in Spark tasks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.registry import query, table
from sheetwise.llm.stored import stored

#: letters, digits and all that is not ASCII make words, so words match whatever punctuation touches them
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: words are hashed into so many buckets; only buckets met in training hold a vector
BUCKETS = 2**24
#: words of one pass of the network; a longer text goes through in pieces
PIECE = 32_768
#: raw scores are counted in so many steps between -LIMIT and LIMIT
STEPS, LIMIT = 400, 10.0


def word_hashes(text: str | None, words: int = PIECE) -> Iterator[np.ndarray]:
    """The buckets of the lower-cased words of one whole text, ``words`` at a time."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    found = (zlib.crc32(m[0]) % BUCKETS for m in WORD.finditer(raw))
    if len(raw) <= words:  # cannot hold more words than that
        yield np.array([zlib.crc32(w) % BUCKETS for w in WORD.findall(raw)], np.int32)
        return
    while len(some := np.fromiter(islice(found, words), np.int32)):
        yield some


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Network:
    """Word vectors, filters of several widths, the largest response of each over the text, and a weighted sum.

    ``vectors[0]`` is zero and stands for words not met in training and for what lies beyond a text's end.
    """

    buckets: np.ndarray  # sorted; bucket i has vector i + 1
    vectors: np.ndarray
    filters: list[np.ndarray]  # per width: (width, dimensions, filters)
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    @property
    def margin(self) -> int:
        return len(self.filters) - 1

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.buckets, hashes), len(self.buckets) - 1)
        return np.where(self.buckets[at] == hashes, at + 1, 0)

    def projections(self) -> np.ndarray:
        """Each vector under each filter at each of its places: what a word adds to a response."""
        return self.vectors @ np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)

    def responses(self, projected: np.ndarray, n: int) -> np.ndarray:
        """The responses of all filters at the first ``n`` places, from the rows of ``projections`` of the words."""
        parts, at = [], 0
        for f in self.filters:
            width, count = f.shape[0], f.shape[2]
            total = projected[:n, at : at + count].copy()
            for j in range(1, width):
                total += projected[j : j + n, at + j * count : at + (j + 1) * count]
            parts.append(total)
            at += width * count
        return np.concatenate(parts, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.weights + self.offset


def scores(network: Network, projections: np.ndarray, texts: Sequence[str | None]) -> np.ndarray:
    """The raw score of each whole text; a long text is read piece by piece, with the words that windows share repeated."""
    pooled = np.full((len(texts), len(network.bias)), -np.inf, np.float32)
    margin = network.margin
    rows, starts, ends, owners, filled = [], [], [], [], 0
    pad = np.zeros(margin, np.int64)

    def flush() -> None:
        nonlocal filled
        if owners:
            ids = np.concatenate([*rows, pad, np.zeros(1, np.int64)])
            found = network.responses(projections[ids], len(ids) - margin)
            borders = np.stack([starts, ends], axis=1).reshape(-1)
            np.maximum.at(pooled, owners, np.maximum.reduceat(found, borders, axis=0)[::2])
        for part in (rows, starts, ends, owners):
            part.clear()
        filled = 0

    def add(owner: int, ids: np.ndarray, whole: bool) -> None:
        nonlocal filled
        # a text's last piece is padded; from any other one the windows that reach beyond it are left to the next
        count = max(1, len(ids)) if whole else len(ids) - margin
        starts.append(filled)
        ends.append(filled + count)
        owners.append(owner)
        rows.extend([ids, pad] if len(ids) else [np.zeros(1, np.int64), pad])
        filled += max(1, len(ids)) + margin
        if filled >= PIECE:
            flush()

    for owner, text in enumerate(texts):
        before = None
        for hashes in word_hashes(text):
            ids = network.ids(hashes)
            if before is not None:
                add(owner, before, False)
                ids = np.concatenate([before[len(before) - margin :], ids])
            before = ids
        add(owner, before if before is not None else np.zeros(0, np.int64), True)
    flush()
    return np.round(network.logits(pooled.astype(np.float64)), 6)  # alike in whatever batch a text comes


def train(
    docs: Sequence[np.ndarray],
    labels: np.ndarray,
    dims: int = 16,
    filters: int = 8,
    widths: int = 3,
    min_docs: int = 3,
    epochs: int = 6,
    batch: int = 32,
    least_steps: int = 400,
    seed: int = 42,
) -> Network:
    """Fit a network to word buckets and labels; the same input gives the same network.

    A bucket gets a vector if ``min_docs`` documents hold it; its first component starts at the bucket's log odds.
    Few documents are gone through more often, until ``least_steps`` batches have been seen.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    kinds = [np.unique(d) for d in docs]
    buckets, at, held = np.unique(np.concatenate(kinds), return_inverse=True, return_counts=True)
    toxic = np.bincount(at, np.repeat(labels, [len(k) for k in kinds]), len(buckets))
    often = held >= min_docs
    buckets, held, toxic = buckets[often].astype(np.int64), held[often], toxic[often]
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    odds = np.log((toxic + 2 * share) / (held - toxic + 2 * (1 - share))) - np.log(share / (1 - share))
    vectors = rng.normal(0, 0.1, (len(buckets) + 1, dims)).astype(np.float32)
    vectors[1:, 0] = np.clip(odds, -3, 3)
    vectors[0] = 0
    weights = [rng.normal(0, (w * dims) ** -0.5, (w, dims, filters)).astype(np.float32) for w in range(1, widths + 1)]
    for f in weights:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.5 / len(f)
    net = Network(buckets, vectors, weights, np.zeros(widths * filters, np.float32), rng.normal(0, 0.1, widths * filters).astype(np.float32), float(np.log(share / (1 - share))))
    ids = [net.ids(d) for d in docs]
    pad = np.zeros(net.margin, np.int64)
    squares = np.full(vectors.shape, 1e-3, np.float32)  # of the gradients of word vectors
    dense = [*net.filters, net.bias, net.weights]
    first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    step = 0
    for _ in range(max(epochs, -(-least_steps * batch // max(1, len(ids))))):
        order = rng.permutation(len(ids))
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            parts = [ids[i] if len(ids[i]) else np.zeros(1, np.int64) for i in some]
            lengths = np.array([len(p) + net.margin for p in parts])
            words = np.concatenate([x for p in parts for x in (p, pad)] + [pad])
            starts = np.cumsum(lengths) - lengths
            x = net.vectors[words]
            wide = x @ np.concatenate([f[j] for f in net.filters for j in range(len(f))], axis=1)
            found = net.responses(wide, len(words) - net.margin)
            pooled = np.maximum.reduceat(found, starts, axis=0)
            row, column = np.nonzero(found == np.repeat(pooled, lengths, axis=0))
            place = np.zeros(pooled.shape, np.int64)
            place[np.repeat(np.arange(len(some)), lengths)[row[::-1]], column[::-1]] = row[::-1]
            active = np.maximum(pooled + net.bias, 0)
            error = ((_sigmoid(active @ net.weights + net.offset) - labels[some]) / len(some)).astype(np.float32)
            down = error[:, None] * net.weights * (active > 0)
            grads, at_words, pulls = [], [], []
            for w, f in enumerate(net.filters):
                span = slice(w * f.shape[2], (w + 1) * f.shape[2])
                grad = np.empty_like(f)
                for j in range(len(f)):
                    here = place[:, span] + j
                    grad[j] = np.einsum("if,ifd->df", down[:, span], x[here])
                    at_words.append(words[here].reshape(-1))
                    pulls.append((down[:, span, None] * f[j].T).reshape(-1, f.shape[1]))
                grads.append(grad)
            grads += [down.sum(axis=0), active.T @ error]
            step += 1
            for p, g, m, v in zip(dense, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            net.offset -= 0.01 * float(error.sum())
            touched, where = np.unique(np.concatenate(at_words), return_inverse=True)
            pull = np.zeros((len(touched), dims), np.float32)
            np.add.at(pull, where, np.concatenate(pulls))
            pull[touched == 0] = 0
            squares[touched] += pull * pull
            net.vectors[touched] -= 0.05 * pull / np.sqrt(squares[touched])
    return net


def scaling(counts: np.ndarray, at: np.ndarray) -> tuple[float, float]:
    """``(a, b)`` such that sigmoid(a * raw + b) gives the share of label 1; ``counts`` are by label and step.

    Newton's steps on the likelihood, with a weak pull towards (1, 0) that also settles counts of one label.
    """
    a, b = 1.0, 0.0
    n, ones = counts.sum(axis=0), counts[1]
    for _ in range(50):
        p = _sigmoid(a * at + b)
        off, curve = p * n - ones, p * (1 - p) * n
        grad = np.array([(off * at).sum() + (a - 1), off.sum() + b])
        bend = np.array([[(curve * at * at).sum() + 1, (curve * at).sum()], [(curve * at).sum(), curve.sum() + 1]])
        move = np.linalg.solve(bend, grad)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
        if np.abs(move).max() < 1e-9:
            break
    return max(a, 1e-3), b


def best_cut(counts: np.ndarray) -> int | None:
    """The step from which on calling a text toxic has the best F1; None without both labels."""
    if not counts[0].sum() or not counts[1].sum():
        return None
    hits, called = counts[1][::-1].cumsum()[::-1], counts.sum(axis=0)[::-1].cumsum()[::-1]
    return int(np.argmax(2 * hits / np.maximum(called + counts[1].sum(), 1)))


def _remainder(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 4


def held_out(id_: Column) -> Column:
    """Rows whose labels nothing is learned from; a missing id is not one of them."""
    return F.coalesce(_remainder(id_) == 2, F.lit(False))


def _order(id_: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), id_)


def fit(docs: DataFrame, known: DataFrame, most: int, max_words: int, seed: int, text: Column, id_: Column) -> tuple[Network | None, Column]:
    """The network, and which ids of ``known`` it was not fitted on.

    Three quarters of the labelled ids, at most ``most`` of them, are drawn by a hash of the id; of their texts
    those of at most ``max_words`` words are used. This is the only sample.
    """
    drawn = F.pmod(_order(F.col("id"), seed), F.lit(4)) != 0
    chosen = known.filter(drawn).orderBy(_order(F.col("id"), seed), "id").limit(most)
    chosen = chosen.toArrow()  # at most ``most`` narrow rows
    if not chosen.num_rows:
        return None, F.lit(True)

    @F.arrow_udf("array<int>")
    def hashed(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            parts = list(islice(word_hashes(t.as_py(), max_words), 2))
            out.append(None if len(parts) > 1 else (parts[0] if parts else np.zeros(0, np.int32)))
        return pa.array(out, pa.list_(pa.int32()))

    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen))
    rows = docs.select(id_.cast("long").alias("id"), text.alias("text")).join(picked, "id").select("id", "toxic", hashed("text").alias("words"))
    # one text an id; the filter comes after the grouping, because before it Spark would hash all texts to judge it
    rows = rows.groupBy("id", "toxic").agg(F.min("words").alias("words")).filter(F.col("words").isNotNull())
    rows = rows.toArrow().sort_by("id")
    free = ~drawn if chosen.num_rows < most else ~drawn | (_order(F.col("id"), seed) > _last(chosen, docs.sparkSession, seed))
    if len(set(labels := rows.column("toxic").to_pylist())) < 2:
        return None, free
    words = rows.column("words").combine_chunks()
    edges, flat = words.offsets.to_numpy(), words.values.to_numpy()
    return train([flat[s:e] for s, e in zip(edges, edges[1:])], np.array(labels), seed=seed), free


def _last(chosen: pa.Table, spark: SparkSession, seed: int) -> int:
    return spark.createDataFrame(chosen).agg(F.max(_order(F.col("id"), seed))).first()[0]


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    most: int = 6_000,
    max_words: int = 4_096,
    min_labelled: int = 50,
    languages: int = 1_000,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    carry: Sequence[str] = (),
) -> DataFrame:
    """A row per document: ``id``, the columns ``carry``, ``held_out``, ``score`` (0 to 1) and ``flagged``.

    A network is fitted on a bounded sample of labelled rows (see ``fit``; ``most`` documents of at most ``max_words``
    words) and scores every whole text in one pass; the scores are written and not computed twice. All labelled
    rows outside the sample then scale the score to a probability and set the threshold of each language, by
    counts per step and label; the ``languages`` with most labelled rows, at least ``min_labelled``, have their own
    threshold, others the overall one. Labels, languages and ids are never input of a score; rows with a held-out id
    lend no label.

    Cases: a null or empty text is scored as a text of no known word; a missing id has no label; a document with
    several labels is toxic if one says so; rows that share an id are scored each; a missing language has the
    overall threshold; without labels of both kinds all scores are the share of toxic labels (0 if there are none) and
    nothing is flagged; an empty table gives no rows.
    """
    text, id_ = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    marked = labels.filter(id_.isNotNull() & F.col("toxic").isin(0, 1)).select(id_.cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = marked.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    network, free = fit(docs, known, most, max_words, seed, text, id_)
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    base = docs.select(id_.cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), *kept, text.alias("text"))
    out = lambda rows, *made: rows.select("id", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], held_out(F.col("id")).alias("held_out"), *made)
    if network is None:
        share = known.agg(F.avg("toxic")).first()[0] or 0.0
        return out(base, F.lit(float(share)).alias("score"), F.lit(False).alias("flagged"))
    model = docs.sparkSession.sparkContext.broadcast((network, network.projections()))  # bounded by the sample

    @F.arrow_udf("double")
    def raw(texts: pa.Array) -> pa.Array:
        net, projections = model.value
        return pa.array(scores(net, projections, texts.to_pylist()))

    rows = stored(base.withColumn("raw", raw("text")).drop("text"))
    step = F.least(F.greatest(F.floor((F.col("raw") + LIMIT) * (STEPS / 2 / LIMIT)), F.lit(0)), F.lit(STEPS - 1)).cast("int")
    judged = rows.select("id", "lang", step.alias("step")).join(known.filter(free), "id")
    counted = stored(judged.groupBy("lang", "step", "toxic").count())
    at = (np.arange(STEPS) + 0.5) * (2 * LIMIT / STEPS) - LIMIT

    def grid(cells) -> np.ndarray:
        counts = np.zeros((2, STEPS))
        for r in cells:
            counts[r["toxic"], r["step"]] += r["n"]
        return counts

    overall = grid(counted.groupBy("step", "toxic").agg(F.sum("count").alias("n")).collect())
    a, b = scaling(overall, at)
    many = counted.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.sum("count").alias("n")).filter(F.col("n") >= min_labelled)
    common = many.orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    cells: dict[str, list] = {}
    for r in counted.withColumnRenamed("count", "n").join(F.broadcast(common), "lang").collect():
        cells.setdefault(r["lang"], []).append(r)
    general = best_cut(overall)
    cuts = {lang: cut for lang, some in sorted(cells.items()) if (cut := best_cut(grid(some))) is not None}
    limit = F.lit(STEPS if general is None else general)
    if cuts:
        limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]), F.col("lang")), limit)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("raw") * a + b)))
    return out(rows, score.alias("score"), (step >= limit).alias("flagged"))


@query("op13_toxicity_cnn")
def toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0)
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", predicted.alias("predicted"), "flagged")
