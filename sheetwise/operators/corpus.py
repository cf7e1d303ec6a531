"""Pages, snippets and chart texts as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import text

#: words one of which a data-analysis snippet contains (fixed values)
SNIPPET_WORDS = ("df", "pandas", "DataFrame", "dt")

EXAMPLE_PROMPT = (
    "Documentation of '{method_name}' in pandas gives these examples:\n'{examples}'\n\n"
    "Write one short usage example with made-up column names. Answer with the code alone, "
    "between ```python and ```. No imports, no tests.\n"
)


def page_links(pages: DataFrame, suffix: str, base: str, html: str = "html") -> DataFrame:
    """One row per link whose target ends in ``suffix``, as a full address."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)
    rows = pages.select(*[c for c in pages.columns if c != html], F.explode(found).alias("href"))
    rows = rows.withColumn("href", text.decode_entities("href")).filter(F.col("href").endswith(suffix))
    return rows.withColumn("full_url", F.concat(F.lit(base), F.col("href")))


def page_heading(html: str = "html") -> Column:
    """Text of the first ``h1``, up to a ``#``."""
    inner = F.regexp_extract(F.col(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    has = F.col(html).rlike(r"(?i)<h1[\s>]")
    name = F.when(has, text.strip(text.strip_tags(inner))).otherwise(F.lit(text.NO_NAME))
    return text.clean_method_name(name, cut=True)


# Elements without an end tag, and those whose end tag may be left out.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
OPEN_ENDED = ("p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "colgroup")


def siblings_until(region: Column, stop_tags: Sequence[str]) -> Column:
    """The part of ``region`` whose elements follow its start on the same level, up to a stop tag on that level.

    The depth is folded over the tags: a stop tag inside another element does not count, the end of the
    element that holds the region does. Elements that may go without an end tag have no depth.
    """
    pieces = F.split(region, r"(?=<[/a-zA-Z])")

    def tag_of(p: Column) -> Column:
        name = F.lower(F.regexp_extract(p, r"\A</?([a-zA-Z][a-zA-Z0-9]*)", 1))
        flat = (name == "") | name.isin(*VOID, *OPEN_ENDED) | p.rlike(r"\A<[^>]*/>")
        step = F.when(flat, 0).when(F.startswith(p, F.lit("</")), -1).otherwise(1)
        return F.struct(step.alias("step"), ((step == 1) & name.isin(*stop_tags)).alias("stop"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("kept"), F.lit(False).alias("done"))

    def walk(at: Column, tag: Column) -> Column:
        done = at["done"] | ((at["depth"] == 0) & (tag["stop"] | (tag["step"] < 0)))
        depth = F.when(done, at["depth"]).otherwise(at["depth"] + tag["step"])
        return F.struct(depth.alias("depth"), (at["kept"] + F.when(done, 0).otherwise(1)).alias("kept"), done.alias("done"))

    kept = F.aggregate(F.transform(pieces, tag_of), start, walk)["kept"]
    return F.array_join(F.slice(pieces, F.lit(1), kept), "")


def doc_examples(
    pages: DataFrame,
    heading: str = "Examples",
    block_tag: str = "pre",
    stop_tags: Sequence[str] = ("h2", "h3"),
    url_part: str = "",
    html: str = "html",
    url: str = "url",
    nested: bool = False,
) -> DataFrame:
    """``(page_id, method_name, examples)`` of documentation pages.

    The examples are the texts of all ``block_tag`` elements between the first
    paragraph that contains ``heading`` and the next stop tag. With ``nested`` only elements on the
    paragraph's own level are looked at: a stop tag inside one of them does not end the examples (``siblings_until``).
    """
    # every piece but the first starts with a paragraph
    pieces = F.split(F.col(html), r"(?i)(?=<p[\s>])")
    starts = F.transform(
        pieces,
        lambda p: p.rlike(r"\A(?i)<p[\s>]")
        & text.strip_tags(F.get(F.split(p, "(?i)</p>"), F.lit(0))).contains(heading),
    )
    at = F.array_position(starts, F.lit(True)).cast("int")
    region = F.array_join(F.slice(pieces, F.greatest(at, F.lit(1)), F.size(pieces)), "")
    # drop the heading paragraph itself, then all from the next section on
    region = F.regexp_replace(region, r"\A(?is).*?</p>", "")
    if nested:
        region = siblings_until(region, [t.lower() for t in stop_tags])
    else:
        region = F.get(F.split(region, rf"(?i)<(?:{'|'.join(stop_tags)})[\s>]"), F.lit(0))
    blocks = F.regexp_extract_all(region, F.lit(rf"(?is)<{block_tag}(?:\s[^>]*)?>(.*?)</{block_tag}>"), 1)
    examples = F.array_join(F.transform(blocks, text.strip_tags), "\n")
    return pages.filter(F.col(url).contains(url_part)).select(
        "page_id",
        page_heading(html).alias("method_name"),
        F.when(at > 0, examples).otherwise(F.lit(text.NO_EXAMPLES)).alias("examples"),
    )


def example_prompts(docs: DataFrame) -> DataFrame:
    """A prompt per documented method."""
    return docs.withColumn(
        "prompt", text.fill(EXAMPLE_PROMPT, {"method_name": F.col("method_name"), "examples": F.col("examples")})
    )


def resume_after(df: DataFrame, key: str, marker, order: str) -> DataFrame:
    """Rows after the first one whose key equals ``marker``; none if it is absent."""
    last = df.filter(F.col(key) == F.lit(marker)).agg(F.min(order)).scalar()
    return df.filter(F.col(order) > last)


def coder_records(queries: DataFrame) -> DataFrame:
    return queries.select(
        "coder_prompt", "plan", F.col("final_generated_code").alias("generated_code"), "query_id"
    )


def parse_chart_table(df: DataFrame, key: str, col: str) -> DataFrame:
    """Rows of linearised chart texts: ``(key, title, position, label, value)``.

    ``<0x0A>`` ends a line. The title is the second cell of the first line;
    of the others, those with exactly two cells count.
    """
    lines = F.split(F.replace(F.col(col), F.lit("<0x0A>"), F.lit("\n")), "\n")
    title = text.strip(F.get(F.split(F.get(lines, F.lit(0)), r"\|"), F.lit(1)))
    rows = df.select(key, title.alias("title"), F.posexplode(lines).alias("position", "line"))
    cells = rows.filter("position > 0").withColumn("cells", F.split("line", r"\|")).filter(F.size("cells") == 2)
    return cells.select(
        key,
        "title",
        "position",
        text.strip(F.get("cells", F.lit(0))).alias("label"),
        text.strip(F.get("cells", F.lit(1))).alias("value"),
    )
