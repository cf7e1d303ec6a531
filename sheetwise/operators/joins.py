"""Joins of tables and of question sheets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators import scale


def merge(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    match_nulls: bool = False,
    salts: int | str = 0,
    hot_rows: int = scale.GROUP_ROWS,
) -> DataFrame:
    """Inner equi-join on columns of the same name.

    Other columns that both sides have get the suffixes ``_x`` and ``_y``.
    ``match_nulls`` lets missing keys meet each other. Spark's adaptive
    execution splits skewed partitions by itself; ``salts > 1`` does it in the
    plan instead: rows of a key with more than ``hot_rows`` left rows are
    spread over that many parts and only those keys of the right side are
    repeated. With ``salts="auto"`` a sketch of both sides finds the frequent keys, and
    each is cut into as many parts on either side as ``hot_rows`` asks for, up to ``MOST_CELLS`` pairs of parts
    of all keys; their rows are joined as tiles (``_join_tiles``), the others as they are.
    """
    on = list(on)
    both = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: f"{c}_x" for c in both})
    right = right.withColumnsRenamed({c: f"{c}_y" for c in both})
    columns = left.columns + [c for c in right.columns if c not in on]

    keys = list(on)
    if salts == "auto":
        if not match_nulls:  # no cells for keys that meet nothing
            left, right = (side.filter(" and ".join(f"`{c}` is not null" for c in on)) for side in (left, right))
        cut = _cut(left, right, on, hot_rows)
        if not cut:
            return _join(left, right, on, match_nulls).select(*columns)
        rest = [side.filter(F.col("__hot").isNull()).drop("__hot", "__own", "__others") for side in cut]
        return _join(*rest, on, match_nulls).select(*columns).union(_join_tiles(*cut, on, match_nulls).select(*columns))
    hot = scale.hot_keys(left, on, hot_rows) if salts > 1 else None
    if hot is not None:
        spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))
        copies = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
        still = F.lit(0).cast("long")
        left = _flag(left, hot, on).withColumn("__salt", F.when(F.col("__hot"), spread).otherwise(still))
        right = _flag(right, hot, on).withColumn(
            "__salt", F.explode(F.when(F.col("__hot"), copies).otherwise(F.array(still)))
        )
        left, right, keys = left.drop("__hot"), right.drop("__hot"), [*on, "__salt"]
    return _join(left, right, keys, match_nulls).select(*columns)


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], match_nulls: bool) -> DataFrame:
    if not match_nulls:
        return left.join(right, list(keys), "inner")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"__r_{k}"])
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, "inner")


#: frequent keys a sketch names, and counters it keeps; a key it misses holds less than one row in so many counters
TOP_KEYS, COUNTERS = 1_000, 20_000
#: cells the grids of all frequent keys have at most, but for one a key: a row is repeated over its row or column of them
MOST_CELLS = 1_024
#: rows of a tile; pairs of tiles are put out one after the other, so the same few values return again and again
#: and the files of the result stay small
TILE_ROWS = 256
SALTS = ["__salt_l", "__salt_r"]


def _key_hash(df: DataFrame, on: Sequence[str]) -> Column:
    """One number per key, alike on both sides of a join whatever their number types; missing cells count as a value."""
    parts = []
    for c in on:
        kind = dict(df.dtypes)[c]
        number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        # adding zero makes one of the two zeros
        value = F.col(f"`{c}`").cast("double") + F.lit(0.0) if number else F.col(f"`{c}`").cast("string")
        parts += [value.isNull(), value]
    return F.xxhash64(*parts)


def _frequent(df: DataFrame, on: Sequence[str], hot_rows: int) -> dict[int, int]:
    """Hashes and estimated counts of the keys with more than ``hot_rows`` rows: one scan of the key columns."""
    top = df.select(_key_hash(df, on).alias("h")).agg(F.expr(f"approx_top_k(h, {TOP_KEYS}, {COUNTERS})").alias("top")).first()["top"]
    return {r["item"]: r["count"] for r in top or [] if r["count"] > hot_rows}


def _grid(left_rows: int, right_rows: int, hot_rows: int, cells: int = MOST_CELLS) -> tuple[int, int]:
    """Parts of a key on either side: about ``hot_rows`` rows each, or larger ones of like size where that is too many cells."""
    l, r = (max(1, -(-n // hot_rows)) for n in (left_rows, right_rows))  # noqa: E741
    if l * r <= cells:
        return l, r
    # the repeated rows are fewest when both sides of a cell hold like many
    l = min(l, cells, max(1, math.isqrt(cells * l // r)))  # noqa: E741
    return l, min(r, cells // l)


def _cut(left: DataFrame, right: DataFrame, on: Sequence[str], hot_rows: int) -> list[DataFrame]:
    """Both sides with the hash of a frequent key (``__hot``, else missing), the part of it a row lies in (``__own``) and
    the number of parts of the other side (``__others``); no sides if there is no frequent key.

    The cells are dealt to the keys by their pairs. A side whose sketch does not name a key has at most ``hot_rows`` rows of it.
    """
    counts = [_frequent(side, on, hot_rows) for side in (left, right)]
    rows = {h: [c.get(h, hot_rows) for c in counts] for h in sorted({*counts[0], *counts[1]})}
    if not rows:
        return []
    pairs = sum(l * r for l, r in rows.values())  # noqa: E741
    grid = [(h, *_grid(l, r, hot_rows, max(1, MOST_CELLS * l * r // pairs))) for h, (l, r) in rows.items()]  # noqa: E741
    # at most two sketches' keys
    hot = F.broadcast(left.sparkSession.createDataFrame(grid, "__h long, __l int, __r int"))
    out = []
    for side, own, sizes in ((left, 0, ("__l", "__r")), (right, 1, ("__r", "__l"))):
        plain = [F.col(f"`{f.name}`") for f in side.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
        marked = side.withColumn("__h", _key_hash(side, on)).join(hot, "__h", "left")
        mine, others = (F.coalesce(F.col(c), F.lit(1)) for c in sizes)
        part = F.pmod(F.xxhash64(F.lit(own), *plain), mine.cast("long")).cast("int")
        held = F.when(F.col("__l").isNotNull(), F.col("__h"))
        out.append(marked.select(*[F.col(f"`{c}`") for c in side.columns], held.alias("__hot"), part.alias("__own"), others.alias("__others")))
    return out


def _over_cells(side: DataFrame, own: int) -> DataFrame:
    """Every row repeated over the cells of its row or column of the grid."""
    cells = F.sequence(F.lit(0), F.col("__others") - 1)
    return side.withColumn(SALTS[own], F.col("__own")).withColumn(SALTS[1 - own], F.explode(cells)).drop("__own", "__others")


def spread_hot_keys(left: DataFrame, right: DataFrame, on: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with two further key columns, by which their frequent keys are cut; and all key columns.

    A frequent key is a grid: its left rows lie in one row of it each, its right rows in one column, and every row is
    repeated over the cells of its row or column, so each pair meets in one cell. A side that is not
    frequent is one row or column. Other keys are left alone. The grids have ``MOST_CELLS`` cells in all, so the
    repeated rows grow like the tables, not like the pairs. The sketches decide the cutting, not the result.
    """
    cut = _cut(left, right, on, hot_rows)
    if not cut:
        return left, right, list(on)
    left, right = (_over_cells(side, own).drop("__hot") for own, side in enumerate(cut))
    return left, right, [*on, *SALTS]


def _join_tiles(left: DataFrame, right: DataFrame, on: Sequence[str], match_nulls: bool) -> DataFrame:
    """The frequent keys of two cut sides, joined by tiles of up to ``TILE_ROWS`` rows.

    A tile holds rows of one key and part, and is repeated over the cells in place of its rows. Where two tiles meet,
    their rows are paired one by one.
    """
    keys = [f"__k{i}" for i in range(len(on))]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles, held = [], []
    for own, side in enumerate((left, right)):
        # the left keys go along as they are: grouping makes one of the two zeros
        held.append([c for c in side.columns if c not in ("__hot", "__own", "__others") and not (own and c in on)])
        by = ["__hot", "__own", "__others", *keys]
        rows = side.filter(F.col("__hot").isNotNull()).withColumns({k: F.col(f"`{c}`") for k, c in zip(keys, on)})
        # numbered, so a tile stays small however often a row is repeated
        number = F.row_number().over(Window.partitionBy("__hot", "__own").orderBy("__hot")) - 1
        cells = [F.col(f"`{c}`") for c in held[own]] or [F.lit(True)]
        held_rows = F.collect_list(F.struct(*(x.alias(f"__{i}") for i, x in enumerate(cells)))).alias("__rows")
        packed = rows.withColumn("__tile", F.floor(number / TILE_ROWS)).groupBy(*by, "__tile").agg(held_rows)
        lists = [F.col(f"__rows.__{i}").alias(f"__list_{own}_{i}") for i in range(len(cells))]
        spread = _over_cells(packed.select(*by, *lists), own)
        spread = spread.withColumnsRenamed({c: f"{c}_{own}" for c in ("__hot", *SALTS, *keys)})
        # a given number of parts, as few bytes may be many pairs
        tiles.append(spread.repartition(parts, *(f"{c}_{own}" for c in ("__hot", *SALTS))))
    met = F.lit(True)
    for c in ("__hot", *SALTS, *keys):
        a, b = (F.col(f"{c}_{own}") for own in (0, 1))
        met &= a.eqNullSafe(b) if match_nulls and c in keys else a == b
    # a tile on the right with all those on the left
    pairs = tiles[1].join(tiles[0], met, "inner")
    for own, names in enumerate(held):
        kept = [f"`{c}`" for c in held[0]] if own else [c for c in pairs.columns if c.startswith("__list_1_")]
        first = F.posexplode(f"__list_{own}_0").alias("__at", "__first")
        cells = [F.col("__first"), *(F.get(f"__list_{own}_{i}", F.col("__at")) for i in range(1, len(names)))]
        # Spark holds what one row of a generated loop yields: the loop begins anew for every pair of tiles and every left row
        pairs = pairs.coalesce(parts).select("*", first).select(*(x.alias(c) for x, c in zip(cells, names)), *kept)
    return pairs


def _flag(df: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Mark the rows whose key is hot."""
    keys = hot.select(*[F.col(k).alias(f"__h_{k}") for k in on], F.lit(True).alias("__hot"))
    condition = None
    for k in on:
        same = df[k].eqNullSafe(keys[f"__h_{k}"])
        condition = same if condition is None else condition & same
    joined = df.join(keys, condition, "left")
    return joined.select(*df.columns, F.coalesce("__hot", F.lit(False)).alias("__hot"))


def concat_columns(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]
) -> DataFrame:
    """Paste two tables side by side by row position; the shorter one ends in nulls.

    Columns that both have get the suffixes ``_x`` and ``_y``, as in ``merge``.
    """
    both = [c for c in left.columns if c in right.columns]
    left_order, right_order = ([f"{c}{s}" if c in both else c for c in o] for o, s in ((left_order, "_x"), (right_order, "_y")))
    left = left.withColumnsRenamed({c: f"{c}_x" for c in both})
    right = right.withColumnsRenamed({c: f"{c}_y" for c in both})
    a = scale.row_index(left, left_order)
    b = scale.row_index(right, right_order)
    return a.join(b, "row_index", "full_outer")


def answers_as_text(lines: DataFrame) -> DataFrame:
    """Whole answers ``(query_id, answer)`` from the rows ``(query_id, row, line)`` of one run."""
    held = F.array_sort(F.collect_list(F.struct("row", "line")))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("answer"))


def pair_answers(correct: DataFrame, agent: DataFrame, strict: bool = False, answers: DataFrame | None = None) -> DataFrame:
    """Answers side by side per question: ``query_id, correct, answer`` plus the sheet's columns.

    With ``answers``, the answer table of one run, an answer is all its rows there and not the text of its detail.
    A question the agent did not answer has a null answer, or is an error
    when ``strict``.
    """
    given = agent.select("query_id", F.col("result_repl_stdout").alias("answer"), F.lit(True).alias("__answered"))
    if answers is not None:
        whole = answers_as_text(answers).withColumnRenamed("answer", "__whole")
        given = given.join(whole, "query_id", "left").select("query_id", F.coalesce("__whole", "answer").alias("answer"), "__answered")
    pairs = correct.withColumnRenamed("result_repl_stdout", "correct").join(given, "query_id", "left")
    if strict:
        missing = pairs.filter(F.col("__answered").isNull()).select("query_id").take(1)
        if missing:
            raise KeyError(f"no answer for query_id {missing[0]['query_id']}")
    return pairs.drop("__answered")


def overlay_details(queries: DataFrame, details: DataFrame, key: str = "query_id") -> DataFrame:
    """Write detail fields over the sheet's; rows without a detail row keep theirs."""
    fields = [c for c in details.columns if c != key]
    fresh = details.select(key, *[F.col(c).alias(f"__new_{c}") for c in fields])
    joined = queries.join(fresh, key, "left")
    out = []
    for c in queries.columns:
        if c in fields:
            out.append(F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    out += [F.col(f"__new_{c}").alias(c) for c in fields if c not in queries.columns]
    return joined.select(*out)


def attach_table(queries: DataFrame, profiles: DataFrame, key: str = "table_name") -> DataFrame:
    """Each question with the profile rows of its own table.

    Adaptive execution broadcasts the profiles if their real size allows it.
    """
    return queries.join(profiles, key, "left")
