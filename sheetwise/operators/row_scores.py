"""Scoring answers from their rows, whatever their size: no answer is gathered into one cell or one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators.scale import PART_ROWS, range_part
from sheetwise.session import settle


def answer_values(lines: DataFrame) -> DataFrame:
    """The different values ``(query_id, number, words, n)`` of answers given as ``(query_id, line)``.

    A line is a JSON object, whose cells are the values, or plain text, which is one value. A value that
    reads as a number is one; missing cells and NaN are no values. ``n`` says how often a value occurs.
    """
    cells = F.map_values(F.from_json("line", "map<string,string>"))
    one = F.coalesce(F.when(F.startswith("line", F.lit("{")), cells), F.array("line"))
    values = lines.select("query_id", F.explode(one).alias("v")).filter(F.trim("v") != "")
    number = F.col("v").try_cast("double")
    values = values.select("query_id", number.alias("number"), F.when(number.isNull(), F.trim("v")).alias("words"))
    return values.filter("number is null or not isnan(number)").groupBy("query_id", "number", "words").agg(F.count("*").alias("n"))


def _events(values: DataFrame, eps: float) -> DataFrame:
    """For both directions the points where a needed value's reach begins and ends, and the values at hand."""
    slack = eps + 1e-9
    v = F.col("number")

    def at(way: int, need: str, have: str) -> list[Column]:
        row = lambda pos, kind, need_, have_: F.struct(F.lit(way).alias("way"), pos.alias("pos"), F.lit(kind).alias("kind"), need_.alias("need"), have_.alias("have"))
        no = F.lit(0).cast("long")
        wanted, held = F.col(need), F.col(have)
        return [
            F.when(wanted > 0, row(v - slack, 0, wanted, no)),
            F.when(held > 0, row(v, 1, no, held)),
            F.when(wanted > 0, row(v + slack, 2, wanted, no)),
        ]

    points = F.array(*at(0, "n_given", "n_correct"), *at(1, "n_correct", "n_given"))
    numbers = values.filter(v.isNotNull())
    return numbers.select("query_id", F.inline(F.filter(points, lambda p: p.isNotNull())))


def unmatched(values: DataFrame, eps: float, part_rows: int = PART_ROWS) -> DataFrame:
    """``(query_id, way)`` where the needed numbers do not all find a number of their own within ``eps``.

    ``values`` has ``number``, ``n_correct`` and ``n_given``; way 0 needs the given numbers among the correct
    ones, way 1 the other way round. Reaches on a line have a perfect matching if every stretch of needed values
    meets as many values at hand (Hall's condition). With running counts this says: at the end of a needed value's
    reach, needed values so far less values at hand so far never exceed the least such difference at
    the beginning of a reach. Both are running sums and a running minimum, taken inside ranges of
    the sorted points and carried over ranges by one short table, so one answer spreads over many tasks.
    """
    events = _events(values, eps)
    placed = events.withColumn("part", range_part(events, ["query_id", "way", "pos"], part_rows=part_rows))
    inside = Window.partitionBy("part", "query_id", "way").orderBy("pos", "kind")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins, ends = F.col("kind") == 0, F.col("kind") == 2
    run = placed.select(
        "part",
        "query_id",
        "way",
        "pos",
        "kind",
        "need",
        "have",
        (F.sum(F.when(begins, F.col("need")).otherwise(0)).over(so_far) - F.when(begins, F.col("need")).otherwise(0)).alias("begun"),
        F.sum(F.when(ends, F.col("need")).otherwise(0)).over(so_far).alias("ended"),
        F.sum("have").over(so_far).alias("held"),
    )
    run = run.withColumn("least", F.min(F.when(begins, F.col("begun") - F.col("held"))).over(so_far))
    over = F.when(ends, F.col("ended") - F.col("held"))
    parts = run.groupBy("part", "query_id", "way").agg(
        F.sum(F.when(begins, F.col("need")).otherwise(0)).alias("b"),
        F.sum(F.when(ends, F.col("need")).otherwise(0)).alias("e"),
        F.sum("have").alias("h"),
        F.min("least").alias("least"),
        F.max(over).alias("most"),
        F.max(over - F.col("least")).alias("gap"),
    )
    # a row per range and answer: an answer has as many as it fills ranges
    answer = Window.partitionBy("query_id", "way").orderBy("part")
    before = answer.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    carried = parts.withColumns({f"o{c}": F.coalesce(F.sum(c).over(before), none) for c in ("b", "e", "h")})
    carried = carried.withColumn("floor", F.min(F.col("least") + F.col("ob") - F.col("oh")).over(before))
    here = F.col("gap") + F.col("oe") - F.col("ob") > 0
    earlier = F.col("most") + F.col("oe") - F.col("oh") > F.col("floor")
    return carried.filter(F.coalesce(here, F.lit(False)) | F.coalesce(earlier, F.lit(False))).select("query_id", "way").distinct()


def score_rows(correct: DataFrame, given: DataFrame, eps: float = 0.01, part_rows: int = PART_ROWS) -> DataFrame:
    """``(query_id, n_correct, n_given, score)`` per question with a correct answer, from rows ``(query_id, line)``.

    The rules are those of ``tolerant_match``, by value: a correct answer of numbers alone must occur in the given
    one; of a correct table with words, all that was given must be found in it, at least one value. Numbers find
    one of their own within ``eps``, words equal ones, as often as they occur; order, columns and further
    values do not matter. Two empty answers agree; a question without a given answer scores 0.
    """
    a = answer_values(correct).select("query_id", "number", "words", F.col("n").alias("n_correct"), F.lit(0).cast("long").alias("n_given"))
    b = answer_values(given).select("query_id", "number", "words", F.lit(0).cast("long").alias("n_correct"), F.col("n").alias("n_given"))
    values = settle(a.unionByName(b).groupBy("query_id", "number", "words").agg(F.sum("n_correct").alias("n_correct"), F.sum("n_given").alias("n_given")))
    word = F.col("words").isNotNull()
    sizes = values.groupBy("query_id").agg(
        F.sum("n_correct").alias("n_correct"),
        F.sum("n_given").alias("n_given"),
        F.coalesce(F.max(word & (F.col("n_correct") > 0)), F.lit(False)).alias("worded"),
        F.count_if(word & (F.col("n_given") > F.col("n_correct"))).alias("strange"),
    )
    short = unmatched(values, eps, part_rows).groupBy("query_id").agg(F.collect_set("way").alias("short"))
    rows = correct.select("query_id").distinct().join(sizes, "query_id", "left").join(short, "query_id", "left")
    n_correct, n_given = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n_correct", "n_given"))
    failed = lambda way: F.coalesce(F.array_contains("short", way), F.lit(False))
    good = (
        F.when(n_correct == 0, n_given == 0)
        .when(F.col("worded"), (n_given > 0) & (F.col("strange") == 0) & ~failed(0))
        .otherwise(~failed(1))
    )
    return rows.select("query_id", n_correct.alias("n_correct"), n_given.alias("n_given"), good.cast("int").alias("score"))
