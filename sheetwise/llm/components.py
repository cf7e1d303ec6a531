"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.session import settle


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``: the smallest node that can be reached.

    Large-star and small-star rounds (Kiveris et al., 2014): every node hands its larger neighbours, then
    its smaller ones, to the smallest node it knows, until nothing changes. A round is joins and minima with
    map-side combination; neighbours are never gathered into one row, and each round is written to the
    checkpoint folder. A link with a null end is ignored, a node linked only to itself is not returned,
    repeated links count once.
    """
    at = F.least("a", "b"), F.greatest("a", "b")
    known = links.filter(F.col("a") != F.col("b")).select(at[1].alias("u"), at[0].alias("v")).distinct()
    known = settle(known)
    mark = _mark(known)
    while mark[0]:
        both = known.union(known.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        known = settle(small.union(least).distinct())
        last, mark = mark, _mark(known)
        if mark == last:
            break
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")).union(known.select("v", "v").distinct())
