"""Line deduplication: drop lines that too many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.registry import query, table
from sheetwise.llm.stored import stored
from sheetwise.llm.text import SPACE, lower_ascii, row_id, without


def _without_positions(lines: Column, dropped: Column) -> Column:
    """``lines`` joined again without the sorted positions ``dropped``: one slice per gap, so linear in both."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(F.size(lines)))
    gaps = F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.array_join(F.flatten(gaps), "\n")


def dedup_lines(
    docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents without the lines that at least ``min_docs`` documents share.

    A line's key is the line without white space at both ends, A-Z lower-cased. A key of at least
    ``min_chars`` code points found in ``min_docs`` documents stays only in the document with the largest
    id, where all its lines stay. Returns the input's columns, ``text`` rebuilt, and ``n_lines`` (before)
    and ``n_dropped``; input columns of these two names are replaced.

    Lines are exploded as two 64-bit hashes of the key with the line's position, never as text. Documents
    per key are counted after one pre-aggregation to (key, document), so a line that a third of the corpus
    holds is one row per task. The positions to drop come back to their document, which is cut and
    joined in place.

    Cases: a null or empty text is one empty line (and is returned as the empty text); rows that share an
    id are one document for the count but keep their own texts; a missing id counts as one document
    with the smallest id; repeated rows stay repeated; an empty table stays empty.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(*without(docs, text_col, "n_lines", "n_dropped"), row_id(id_col).alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__hash"))
    key = F.btrim(F.col("__line"), F.lit(SPACE))
    lines = (
        rows.select("__id", "__hash", F.posexplode(F.split(lower_ascii(F.col("__text")), "\n", -1)).alias("__at", "__line"))
        .select("__id", "__hash", "__at", key.alias("__key"))
        .filter(F.char_length("__key") >= min_chars)
        .select("__id", "__hash", "__at", F.xxhash64("__key").alias("__k1"), F.xxhash64(F.lit(1), "__key").alias("__k2"))
    )
    shared = (
        lines.select("__k1", "__k2", "__id")
        .distinct()
        .groupBy("__k1", "__k2")
        .agg(F.count("*").alias("__docs"), F.max("__id").alias("__keeper"))
        .filter(F.col("__docs") >= min_docs)
        .drop("__docs")
    )
    # written first: a join of two plain exchanges can be split where one line is very common
    shared = stored(shared)
    drops = (
        lines.join(shared, ["__k1", "__k2"])
        .filter(F.col("__id") != F.col("__keeper"))
        .groupBy("__id", "__hash")
        .agg(F.array_sort(F.collect_set("__at")).alias("__drop"))
    )
    split = F.split("__text", "\n", -1)
    none = F.array().cast("array<int>")
    joined = rows.join(drops, ["__id", "__hash"], "left").withColumn("__drop", F.coalesce("__drop", none))
    kept = F.when(F.size("__drop") == 0, F.col("__text")).otherwise(_without_positions(split, F.col("__drop")))
    made = {text_col: kept, "n_lines": F.size(split).cast("long"), "n_dropped": F.size("__drop").cast("long")}
    same = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*[made[c].alias(c) if c == text_col else F.col(f"`{c}`") for c in same], *[made[c].alias(c) for c in ("n_lines", "n_dropped")])


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(ls, i) AS line,
         translate(trim(list_extract(ls, i), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d, unnest(range(1, len(ls) + 1)) AS u(i)
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), flagged AS (
  SELECT l.*, s.k IS NOT NULL AND s.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""


@query("op2_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
