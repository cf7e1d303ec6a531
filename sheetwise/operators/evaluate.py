"""Tagging questions and scoring answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import text
from sheetwise.operators.cleaning import general_only, non_blank_queries

_QUOTED = r"""(^|[^\w])(?:'[^'\n]*'|"[^"\n]*")([^\w]|$)"""
_DRAWING = r"(?i)(?:plot|chart)(?:s|ed|ted|ing|ting)?\b|\bgraphs?\b|\bvisuali[sz]|\bhistograms?\b|\bscatter|\bfigures?\b|\bdiagrams?\b|\bdraw(?:s|n|ing)?\b"


def tag_question(c: Column | str) -> Column:
    """``plot`` when the question asks for a drawing, else ``general``.

    Quoted names are left out first: a column called 'Plot' is not a wish to
    see one. This is a word rule, not a model.
    """
    c = F.col(c) if isinstance(c, str) else c
    quoted = c.contains("'") | c.contains('"')
    bare = F.when(quoted, F.regexp_replace(c, _QUOTED, "$1 $2")).otherwise(c)
    return F.when(bare.rlike(_DRAWING), F.lit("plot")).otherwise(F.lit("general"))


def tag_queries(queries: DataFrame, tagger: str | object = "rule", fixed: str | None = None) -> DataFrame:
    """Add ``tagged_query_type``.

    ``fixed`` overrides all questions. ``tagger`` is ``"rule"`` or a function
    from column to column (for example a pandas UDF around a model).
    """
    if fixed not in (None, "plot", "general"):
        raise ValueError("a fixed type is 'plot' or 'general'")
    if fixed:
        tag = F.lit(fixed)
    elif tagger == "rule":
        tag = tag_question("user_query")
    elif callable(tagger):
        tag = tagger(F.col("user_query"))
    else:
        raise ValueError(f"unknown tagger {tagger!r}")
    return queries.withColumn("tagged_query_type", tag)


def same_text(a: Column | str, b: Column | str) -> Column:
    """1 when two answers are equal apart from white space around them."""
    return F.coalesce(text.strip(a) == text.strip(b), F.lit(False)).cast("int")


def score_exact(pairs: DataFrame) -> DataFrame:
    """Mean exact score over general questions: ``(n, score)``; NULL when there are none."""
    scored = general_only(pairs).select(same_text("correct", "answer").alias("s"))
    return scored.agg(F.count("*").alias("n"), F.avg("s").alias("score"))


_DATE = r"\d{4}-\d{2}-\d{2}"
#: a sign counts at the start or after a separator only; thousands may be grouped, an exponent may follow
_NUMBER = r"(?:(?<![\w.)\]])-)?(?:\d{1,3}(?:,\d{3})+(?![\d])|\d+)(?:\.\d+)?(?:[eE][+-]?\d+)?"


def _dates_in(c: Column) -> Column:
    """The different dates of a text in order."""
    none = F.array().cast("array<string>")
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(_DATE), 0)))
    return F.when(c.contains("-"), found).otherwise(none)


def numbers_in(c: Column) -> Column:
    """All numbers of a text; dates do not count as numbers."""
    bare = F.when(c.contains("-"), F.regexp_replace(c, _DATE, " ")).otherwise(c)
    return F.transform(F.regexp_extract_all(bare, F.lit(_NUMBER), 0), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def _each_near(inner: Column, outer: Column, eps: float) -> Column:
    """Every number of ``inner`` has one of ``outer`` of its own within ``eps``.

    Both are sorted and ``outer`` is run through once: a number takes the first
    that is near enough; one that is passed by fails for good (-1).
    """
    slack = eps + 1e-9

    def run(pair: Column) -> Column:
        small, large = pair["small"], pair["large"]

        def step(at: Column, y: Column) -> Column:
            x = F.get(small, at)
            near = F.when(y < x - slack, at).when(y <= x + slack, at + 1).otherwise(F.lit(-1))
            return F.when((at < 0) | (at >= F.size(small)), at).otherwise(near)

        return F.aggregate(large, F.lit(0), step) == F.size(small)

    pair = F.struct(F.sort_array(inner).alias("small"), F.sort_array(outer).alias("large"))
    several = F.get(F.transform(F.array(pair), run), F.lit(0))
    one = F.exists(outer, lambda y: F.abs(y - F.get(inner, F.lit(0))) <= slack)
    return F.when(F.size(inner) == 1, one).otherwise(several)


def tolerant_match(correct: Column | str, answer: Column | str, eps: float = 0.01) -> Column:
    """1 when an answer agrees with the correct one by the judging rules, else 0.

    Equal texts agree. Dates must be the same set. A single number must occur
    in the answer, within ``eps``. Several bare numbers must all occur, in any
    order and as often. For a table, an answer that is a list of numbers must consist of
    numbers of the table. Without numbers, one text must contain the other.
    """
    texts = F.struct(
        text.strip(correct).alias("a"), F.coalesce(text.strip(answer), F.lit("")).alias("b")
    )

    def judged(t: Column) -> Column:
        parts = F.struct(
            t["a"].alias("a"),
            t["b"].alias("b"),
            _dates_in(t["a"]).alias("dates_a"),
            _dates_in(t["b"]).alias("dates_b"),
            numbers_in(t["a"]).alias("na"),
            numbers_in(t["b"]).alias("nb"),
        )
        return F.when(t["a"] == t["b"], F.lit(True)).otherwise(F.get(F.transform(F.array(parts), agree), F.lit(0)))

    def agree(p: Column) -> Column:
        a, b, na, nb = p["a"], p["b"], p["na"], p["nb"]
        worded_a, worded_b = a.rlike("[A-Za-z]{2,}"), b.rlike("[A-Za-z]{2,}")
        by_number = F.when(~worded_a, _each_near(na, nb, eps)).otherwise(
            ~worded_b & (F.size(nb) > 0) & _each_near(nb, na, eps)
        )
        low_a, low_b = F.lower(a), F.lower(b)
        by_text = (a != "") & (b != "") & (F.contains(low_b, low_a) | F.contains(low_a, low_b))
        return (
            F.when(F.size(p["dates_a"]) > 0, p["dates_a"] == p["dates_b"])
            .when(F.size(na) > 0, by_number | (worded_a & by_text))
            .otherwise(by_text)
        )

    # bound once: strip, dates and numbers are read by several rules
    result = F.get(F.transform(F.array(texts), judged), F.lit(0))
    return F.coalesce(result, F.lit(False)).cast("int")


def score_tolerant(pairs: DataFrame, eps: float = 0.01) -> DataFrame:
    """Mean tolerant score over general questions: ``(n, score)``."""
    scored = general_only(pairs).select(tolerant_match("correct", "answer", eps).alias("s"))
    return scored.agg(F.count("*").alias("n"), F.avg("s").alias("score"))


def executable_rate(
    details: DataFrame,
    cohort: str,
    cohorts: Sequence[str],
    success: str = "successful_code_execution",
    exclude_crashed: bool = False,
) -> DataFrame:
    """``(cohort, n_queries, n_executable, rate)`` for each named cohort.

    A question whose call crashed has no success flag. It counts as not
    executable, or is left out with ``exclude_crashed``. An empty cohort is
    present with rate 0.
    """
    rows = details.filter(F.col(success).isNotNull()) if exclude_crashed else details
    ok = F.coalesce(F.col(success), F.lit(False)).cast("int")
    seen = rows.groupBy(F.col(cohort).cast("string").alias("cohort")).agg(
        F.count("*").alias("n_queries"), F.sum(ok).alias("n_executable"), F.avg(ok).alias("rate")
    )
    spark = details.sparkSession
    names = spark.createDataFrame([(c,) for c in cohorts], "cohort string")
    return names.join(seen, "cohort", "left").na.fill({"n_queries": 0, "n_executable": 0, "rate": 0.0})


def tagging_accuracy(tagged: DataFrame, truth: str = "has_plot_answer") -> DataFrame:
    """``(n, accuracy, accuracy_plot, accuracy_general)`` against the known answer kind."""
    rows = non_blank_queries(tagged)
    is_plot = F.coalesce(F.col(truth), F.lit(False))
    right = ((F.col("tagged_query_type") == "plot") == is_plot).cast("int")
    return rows.agg(
        F.count("*").alias("n"),
        F.avg(right).alias("accuracy"),
        F.avg(F.when(is_plot, right)).alias("accuracy_plot"),
        F.avg(F.when(~is_plot, right)).alias("accuracy_general"),
    )


def reuse_plans(queries: DataFrame, former: DataFrame) -> DataFrame:
    """Take plan, tag, planner prompt and plot path from a former run.

    Plan and tag belong together; a row that has only one of them gets an
    ``error``.
    """
    taken = ["plan", "tagged_query_type", "prompt_user_for_planner", "plot_filename"]
    rest = queries.drop(*taken)
    joined = rest.join(former.select("query_id", *taken), "query_id", "left")
    half = F.col("plan").isNull() != F.col("tagged_query_type").isNull()
    return joined.withColumn("error", F.when(half, F.lit("plan and tag must both be given or both be absent")))
