"""Sources, projections, filters, joins, sets, order and reshaping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sheetwise.operators import cleaning, joins, ordering, reshape, setops
from sheetwise.operators.corpus import SNIPPET_WORDS
from sheetwise.plans.registry import SPARSE_EVENTS, hash_sql, in_place, nan_events, query, rounded, sparse_events, table
from sheetwise.sources.registry import TableRegistry
from sheetwise.sources.tables import cast_all_string, from_sql, load_table

# ---- sources ----


@query("src_parquet", "SELECT * FROM lineitem")
def _(spark, d):
    return load_table(spark, f"{d}/lineitem.parquet")


_STATUS = """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus"""


@query("src_sql", _STATUS)
def _(spark, d):
    registry = TableRegistry(spark)
    registry.register("orders", f"{d}/orders.parquet")
    registry.get("orders")
    return from_sql(spark, _STATUS)


# ---- projections, filters, cleaning ----


@query("filter_rows", "SELECT * FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def _(spark, d):
    return cleaning.filter_rows(
        table(spark, d, "lineitem"), (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")
    )


@query("filter_query", "SELECT * FROM lineitem WHERE l_discount > 0.08 OR l_tax = 0")
def _(spark, d):
    return cleaning.filter_rows(table(spark, d, "lineitem"), "l_discount > 0.08 or l_tax = 0")


@query("select_cols", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def _(spark, d):
    return cleaning.select_columns(table(spark, d, "lineitem"), ["l_orderkey", "l_extendedprice"])


@query("drop_cols", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(spark, d):
    return cleaning.drop_columns(table(spark, d, "customer"), ["c_name", "c_acctbal"])


@query(
    "rename_cols",
    "SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer",
)
def _(spark, d):
    names = {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"}
    return cleaning.rename_columns(table(spark, d, "customer"), names)


@query("drop_missing", f"SELECT * FROM {SPARSE_EVENTS} WHERE value IS NOT NULL")
def _(spark, d):
    return cleaning.drop_missing(sparse_events(spark, d))


@query(
    "fill_missing",
    f"SELECT event_id, ts, user_id, k, event_type, coalesce(value, -1.0) AS value FROM {SPARSE_EVENTS}",
)
def _(spark, d):
    return cleaning.fill_missing(sparse_events(spark, d), {"value": -1.0})


@query(
    "blank_nan",
    f"""SELECT event_id, ts, user_id, k, CASE WHEN lower(event_type) = 'nan' THEN '' ELSE event_type END AS event_type,
    value FROM {SPARSE_EVENTS}""",
)
def _(spark, d):
    return cleaning.blank_nan_text(sparse_events(spark, d))


@query(
    "cast_cols",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
    c_acctbal, CAST(NULL AS INTEGER) AS c_mktsegment FROM customer""",
)
def _(spark, d):
    types = {"c_custkey": "string", "c_nationkey": "double", "c_mktsegment": "int"}
    return cleaning.cast_columns(table(spark, d, "customer"), types, strict=False)


@query("cast_all_string", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def _(spark, d):
    return cast_all_string(table(spark, d, "nation"))


@query(
    "row_index",
    "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS row_index FROM customer",
)
def _(spark, d):
    few = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return cleaning.row_index(few, ["c_acctbal", "c_custkey"])


@query("set_index", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    return cleaning.set_index(table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey"), "o_orderkey")


@query("head_n", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10")
def _(spark, d):
    return cleaning.head(table(spark, d, "orders"), 10, ["o_orderdate", "o_orderkey"])


@query("ratio_col", "SELECT *, l_extendedprice / nullif(l_tax, 0) AS price_per_tax FROM lineitem")
def _(spark, d):
    return cleaning.ratio_column(table(spark, d, "lineitem"), "l_extendedprice", "l_tax", "price_per_tax")


@query("range_power", "SELECT round(pow(max(l_quantity) - min(l_discount), 3), 4) AS result FROM lineitem")
def _(spark, d):
    return rounded(cleaning.range_power(table(spark, d, "lineitem"), "l_quantity", "l_discount", 3), 4, "result")


_ASKED = """(SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'NaN' WHEN conv_id % 7 = 0 THEN '  ' ELSE text END
 AS user_query FROM conversations WHERE role = 'user')"""


@query(
    "non_blank",
    f"SELECT * FROM {_ASKED} WHERE trim(user_query) <> '' AND lower(trim(user_query)) <> 'nan'",
)
def _(spark, d):
    talk = table(spark, d, "conversations").filter("role = 'user'")
    asked = talk.select(
        "conv_id",
        "turn",
        F.when(F.col("conv_id") % 5 == 0, "NaN")
        .when(F.col("conv_id") % 7 == 0, "  ")
        .otherwise(F.col("text"))
        .alias("user_query"),
    )
    return cleaning.non_blank_queries(asked)


@query(
    "train_eligible",
    """SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'plot' ELSE 'general' END AS tagged_query_type
    FROM documents JOIN labels USING (doc_id) WHERE source NOT IN ('src1', 'src2') AND quality = 1""",
)
def _(spark, d):
    runs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    runs = runs.select(
        "doc_id",
        F.when(F.col("source").isin("src1", "src2"), "plot").otherwise("general").alias("tagged_query_type"),
        (F.col("quality") == 1).alias("successful_code_execution"),
    )
    return cleaning.training_eligible(runs).drop("successful_code_execution")


@query(
    "corpus_filter",
    """SELECT doc_id, lang FROM documents
    WHERE (contains(text, 'df') OR contains(text, 'pandas') OR contains(text, 'DataFrame') OR contains(text, 'dt'))
      AND (lang = 'en' OR contains(text, 'and'))""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    return cleaning.corpus_filter(docs, "text", SNIPPET_WORDS, ["and"], F.col("lang") == "en").select("doc_id", "lang")


@query("apply_col", "SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment FROM customer")
def _(spark, d):
    return cleaning.apply_column(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", F.upper)


@query("apply_col_pandas", "SELECT c_custkey, c_acctbal, c_acctbal * 2 + 1 AS doubled FROM customer")
def _(spark, d):
    few = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return cleaning.apply_column(few, "c_acctbal", _double, "doubled", python_type="double")


def _double(values: pd.Series) -> pd.Series:
    return values * 2 + 1


# ---- joins ----


@query(
    "merge_inner",
    """SELECT o_custkey AS custkey, o_orderkey, o_totalprice, c_name, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice")
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_name", "c_mktsegment")
    return joins.merge(orders, customer, ["custkey"])


@query(
    "concat_cols",
    """SELECT row_index, c_custkey, s_suppkey FROM
    (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row_index FROM customer)
    FULL JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS row_index FROM supplier)
    USING (row_index)""",
)
def _(spark, d):
    a = table(spark, d, "customer").select("c_custkey")
    b = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    pasted = joins.concat_columns(a, b, ["c_custkey"], ["s_acctbal", "s_suppkey"])
    return pasted.select("row_index", "c_custkey", "s_suppkey")


def answer_sheets(spark, d):
    """User turns as the correct sheet, the assistant's next turns as the agent's."""
    talk = table(spark, d, "conversations")
    correct = talk.filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.when(F.col("conv_id") % 3 == 0, "plot").otherwise("general").alias("tagged_query_type"),
        F.col("text").alias("result_repl_stdout"),
    )
    same = F.col("conv_id") % 4 == 0
    asked = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    agent = talk.filter("role = 'assistant'").withColumn("turn", F.col("turn") - 1).join(asked, ["conv_id", "turn"], "left")
    agent = agent.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.when(same, F.concat(F.lit(" "), F.col("asked"))).otherwise(F.col("text")).alias("result_repl_stdout"),
    )
    return correct, agent


PAIRS = """(
  SELECT c.conv_id * 1000 + c.turn AS query_id,
         CASE WHEN c.conv_id % 3 = 0 THEN 'plot' ELSE 'general' END AS tagged_query_type, c.text AS correct,
         CASE WHEN a.conv_id % 4 = 0 THEN ' ' || c.text ELSE a.text END AS answer
  FROM conversations c LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
    ON a.conv_id = c.conv_id AND a.turn = c.turn + 1
  WHERE c.role = 'user'
)"""


@query("pair_answers", f"SELECT * FROM {PAIRS}")
def _(spark, d):
    return joins.pair_answers(*answer_sheets(spark, d))


@query(
    "overlay_details",
    """SELECT d.doc_id AS query_id, d.source AS plan, CASE WHEN toxic = 1 THEN 'toxic' ELSE d.lang END AS tagged_query_type,
    quality = 1 AS successful_code_execution FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, d):
    sheet = table(spark, d, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("source").alias("plan"), F.col("lang").alias("tagged_query_type")
    )
    details = table(spark, d, "labels").select(
        F.col("doc_id").alias("query_id"),
        F.when(F.col("toxic") == 1, "toxic").alias("tagged_query_type"),
        (F.col("quality") == 1).alias("successful_code_execution"),
    )
    return joins.overlay_details(sheet, details)


@query(
    "attach_profile",
    """SELECT lang AS table_name, doc_id AS query_id, n_columns, longest FROM documents JOIN
    (SELECT lang, count(*) AS n_columns, max(n_chars) AS longest FROM documents GROUP BY lang) USING (lang)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("lang", "table_name")
    profiles = docs.groupBy("table_name").agg(F.count("*").alias("n_columns"), F.max("n_chars").alias("longest"))
    questions = docs.select("table_name", F.col("doc_id").alias("query_id"))
    return joins.attach_table(questions, profiles)


# ---- order ----


@query("sort_by", "SELECT *, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) - 1 AS row_index FROM customer")
def _(spark, d):
    placed = ordering.sort_by(table(spark, d, "customer"), ["c_mktsegment", "c_acctbal"], [True, False], ["c_custkey"])
    return in_place(placed)


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, d):
    return ordering.top_k(table(spark, d, "orders"), "o_totalprice", 10, ["o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("bottom_k", "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size, p_partkey LIMIT 11")
def _(spark, d):
    return ordering.bottom_k(table(spark, d, "part"), "p_size", 11, ["p_partkey"], ["p_partkey", "p_name", "p_size"])


@query(
    "top_k_ratio",
    """SELECT p_partkey, p_retailprice / nullif(p_size, 0) AS ratio FROM part
    ORDER BY p_retailprice / nullif(p_size, 0) DESC NULLS LAST, p_partkey LIMIT 3""",
)
def _(spark, d):
    return ordering.top_k_ratio(table(spark, d, "part"), "p_retailprice", "p_size", 3, ["p_partkey"], ["p_partkey"])


@query(
    "first_samples",
    """WITH f AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)
    SELECT 'c_custkey' AS column_name, 0 AS position, string_agg(CAST(c_custkey AS VARCHAR), '|' ORDER BY c_custkey) AS samples FROM f
    UNION ALL SELECT 'c_name', 1, string_agg(c_name, '|' ORDER BY c_custkey) FROM f
    UNION ALL SELECT 'c_nationkey', 2, string_agg(CAST(c_nationkey AS VARCHAR), '|' ORDER BY c_custkey) FROM f
    UNION ALL SELECT 'c_acctbal', 3, string_agg(CAST(c_acctbal AS VARCHAR), '|' ORDER BY c_custkey) FROM f
    UNION ALL SELECT 'c_mktsegment', 4, string_agg(c_mktsegment, '|' ORDER BY c_custkey) FROM f""",
)
def _(spark, d):
    found = ordering.first_samples(table(spark, d, "customer"), 3, ["c_custkey"])
    return found.select("column_name", "position", F.array_join("sample_values", "|").alias("samples"))


@query("seeded_shuffle", f"SELECT *, row_number() OVER (ORDER BY {hash_sql(228, 'o_orderkey')}, o_orderkey) - 1 AS row_index FROM orders")
def _(spark, d):
    return in_place(ordering.seeded_shuffle(table(spark, d, "orders"), 228, ["o_orderkey"]))


@query(
    "split_counts",
    """WITH n AS (SELECT count(*) AS n FROM orders)
    SELECT 'validation' AS split, CAST(floor(n * 0.05) AS BIGINT) AS n_rows, CAST(floor(n * 0.05) AS BIGINT) AS n_keys FROM n
    UNION ALL SELECT 'train', n - CAST(floor(n * 0.05) AS BIGINT), n - CAST(floor(n * 0.05) AS BIGINT) FROM n""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    train, validation = ordering.split_train_validation(orders, 0.05, 1337, ["o_orderkey"])
    both = train.withColumn("split", F.lit("train")).unionByName(validation.withColumn("split", F.lit("validation")))
    return both.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"))


@query(
    "split_rows",
    f"""SELECT o_orderkey, CASE WHEN p <= floor(n * 0.05) THEN 'validation' ELSE 'train' END AS split FROM
    (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql(1337, 'o_orderkey')}, o_orderkey) AS p, count(*) OVER () AS n FROM orders)""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    train, validation = ordering.split_train_validation(orders, 0.05, 1337, ["o_orderkey"])
    return train.withColumn("split", F.lit("train")).unionByName(validation.withColumn("split", F.lit("validation")))


@query("probe_set", f"SELECT * FROM orders ORDER BY {hash_sql(1337, 'o_orderkey')}, o_orderkey LIMIT 20")
def _(spark, d):
    _, validation = ordering.split_train_validation(table(spark, d, "orders"), 0.05, 1337, ["o_orderkey"])
    return ordering.select_first(validation, 20, 1337, ["o_orderkey"])


@query(
    "length_buckets",
    """SELECT CAST(floor(length(text) / 500) AS BIGINT) AS bucket, count(*) AS n_rows, CAST(min(length(text)) AS INTEGER) AS shortest,
    CAST(max(length(text)) AS INTEGER) AS longest FROM documents GROUP BY 1""",
)
def _(spark, d):
    return ordering.length_buckets(table(spark, d, "documents"), "text", 500)


@query("group_by_length", "SELECT doc_id, text FROM documents")
def _(spark, d):
    return ordering.group_by_length(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"])


# ---- sets ----


@query(
    "concat_rows",
    """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""",
)
def _(spark, d):
    a = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return setops.concat_rows([a, b])


@query(
    "concat_splits",
    """SELECT lower(text) AS code, 'documentation' AS split FROM documents
    UNION ALL SELECT lower(text), 'benchmark' FROM benchmark UNION ALL SELECT lower(text), 'instruct' FROM conversations""",
)
def _(spark, d):
    names = {"documentation": "documents", "benchmark": "benchmark", "instruct": "conversations"}
    return setops.concat_splits(
        {k: table(spark, d, t).select("text", F.lower("text").alias("code")) for k, t in names.items()}
    )


@query(
    "extend_split",
    """SELECT item_id, text, 'train' AS split FROM benchmark UNION ALL SELECT item_id, text, 'train_upd' FROM benchmark
    UNION ALL SELECT doc_id, text, 'train_upd' FROM documents""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return setops.extend_split(table(spark, d, "benchmark"), docs)


@query(
    "merge_pairs",
    """SELECT lang AS input, text AS output FROM documents
    UNION ALL SELECT role, text FROM conversations""",
)
def _(spark, d):
    a = table(spark, d, "documents").select(F.col("lang").alias("input_prompt"), F.col("text").alias("completed_code"))
    b = table(spark, d, "conversations").select(
        F.col("role").alias("input_prompt"), F.col("text").alias("completed_code")
    )
    return setops.merge_pairs([a, b])


@query(
    "frame_diff",
    """WITH a AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer),
    b AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, c_acctbal
          FROM customer WHERE c_custkey % 7 <> 0)
    SELECT *, 'left' AS side, CAST(1 AS BIGINT) AS times FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    UNION ALL SELECT *, 'right', CAST(1 AS BIGINT) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def _(spark, d):
    a = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    moved = F.when(F.col("c_custkey") % 10 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))
    return setops.frame_diff(a, a.filter("c_custkey % 7 <> 0").withColumn("c_nationkey", moved))


# ---- reshaping ----


@query(
    "pivot_mean",
    """SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS "F",
    round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS "O" FROM lineitem GROUP BY l_returnflag""",
)
def _(spark, d):
    wide = reshape.pivot_table(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity")
    return rounded(wide, 6, "F", "O")


@query(
    "pivot_multi",
    """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity_mean,
    min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max,
    round(avg(l_extendedprice), 4) AS l_extendedprice_mean FROM lineitem GROUP BY ALL""",
)
def _(spark, d):
    spec = {"l_quantity": ["mean"], "l_extendedprice": ["min", "max", "mean"]}
    wide = reshape.pivot_multi(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], spec)
    return rounded(rounded(wide, 6, "l_quantity_mean"), 4, "l_extendedprice_mean")


@query(
    "melt",
    """SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""",
)
def _(spark, d):
    return reshape.melt(
        table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]
    )


@query(
    "crosstab",
    """SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS "0", count(*) FILTER (user_id % 3 = 1) AS "1",
    count(*) FILTER (user_id % 3 = 2) AS "2" FROM events GROUP BY event_type""",
)
def _(spark, d):
    events = table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("shard"))
    return reshape.crosstab(events, "event_type", "shard")


@query(
    "get_dummies",
    """SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INTEGER) AS "l_returnflag_A",
    CAST(l_returnflag = 'N' AS INTEGER) AS "l_returnflag_N", CAST(l_returnflag = 'R' AS INTEGER) AS "l_returnflag_R"
    FROM lineitem""",
)
def _(spark, d):
    few = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return reshape.get_dummies(few, "l_returnflag", as_int=True)


@query("pivot_wide", "SELECT c_nationkey, c_custkey, c_acctbal AS value FROM customer")
def _(spark, d):
    wide, customers = reshape.pivot_blocks(table(spark, d, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal", "max")
    return reshape.melt_blocks(wide, customers, ["c_nationkey"], "c_custkey")


_SHIP_DAY = "CAST(datediff('day', TIMESTAMP '1990-01-01', CAST(l_shipdate AS TIMESTAMP)) AS BIGINT)"


@query("pivot_days", f"SELECT l_returnflag, {_SHIP_DAY} AS day, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL")
def _(spark, d):
    day = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1990-01-01"))).cast("long")
    items = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", day.alias("day"))
    wide = reshape.pivot_table(items, ["l_returnflag"], "day", "l_extendedprice", "max")
    names = [c for c in wide.columns if c != "l_returnflag"]
    long = reshape.melt(wide, ["l_returnflag"], names, "day", "value").filter("value is not null")
    return long.withColumn("day", F.col("day").cast("long"))


_NUMBERED = """(SELECT o_custkey, row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS number
  FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey))"""


@query(
    "pivot_sparse",
    f"""SELECT o_orderpriority, CAST(floor(number / 1000) AS BIGINT) AS chunk, list(number ORDER BY number) AS numbers,
    list(cell ORDER BY number) AS cells FROM
    (SELECT o_orderpriority, o_custkey, max(o_totalprice) AS cell FROM orders GROUP BY ALL) JOIN {_NUMBERED} USING (o_custkey) GROUP BY ALL""",
)
def _(spark, d):
    return reshape.pivot_sparse(table(spark, d, "orders"), ["o_orderpriority"], "o_custkey", "o_totalprice", "max", width=1000)[0]


@query("category_numbers", """SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS number
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)""")
def _(spark, d):
    return reshape.category_numbers(table(spark, d, "orders"), "o_custkey")


@query("pivot_long", "SELECT user_id, event_type, round(avg(value), 6) AS value FROM events GROUP BY user_id, event_type")
def _(spark, d):
    return rounded(reshape.pivot_long(table(spark, d, "events"), ["user_id"], "event_type", "value"), 6, "value")


@query(
    "pivot_nan",
    f"""SELECT user_id % 7 AS shard, round(avg(value) FILTER (event_type = 'click'), 6) AS click,
    round(avg(value) FILTER (event_type = 'view'), 6) AS "view" FROM {SPARSE_EVENTS} GROUP BY user_id % 7""",
)
def _(spark, d):
    events = nan_events(spark, d).withColumn("shard", F.col("user_id") % 7)
    wide = reshape.pivot_table(events, ["shard"], "event_type", "value", column_values=["click", "view"])
    return rounded(wide, 6, "click", "view")


@query("top_k_nan", f"SELECT event_id, value FROM {SPARSE_EVENTS} WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 10")
def _(spark, d):
    return ordering.top_k(nan_events(spark, d), "value", 10, ["event_id"], ["event_id", "value"])


@query(
    "sort_by_nan",
    f"SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) - 1 AS row_index FROM {SPARSE_EVENTS}",
)
def _(spark, d):
    few = nan_events(spark, d).select("event_id", "value")
    return in_place(ordering.sort_by(few, ["value"], False, ["event_id"])).select("event_id", "row_index")


@query(
    "concat_same_names",
    """SELECT row_index, key_x, name_x, key_y, name_y FROM
    (SELECT c_custkey AS key_x, c_name AS name_x, row_number() OVER (ORDER BY c_custkey) - 1 AS row_index FROM customer)
    FULL JOIN (SELECT s_suppkey AS key_y, s_name AS name_y, row_number() OVER (ORDER BY s_suppkey) - 1 AS row_index FROM supplier)
    USING (row_index)""",
)
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return joins.concat_columns(a, b, ["key"], ["key"])


@query(
    "frame_close",
    """SELECT o_orderkey, 'o_totalprice' AS "column", o_orderkey % 10 = 0 AS far FROM orders WHERE o_orderkey % 10 = 0
    UNION ALL SELECT o_orderkey, '__row', false FROM orders WHERE o_orderkey % 97 = 1 AND o_orderkey % 10 <> 0""",
)
def _(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    moved = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") * 1.001).otherwise(F.col("o_totalprice") * (1 + 1e-9))
    b = a.filter("o_orderkey % 97 <> 1 or o_orderkey % 10 = 0").withColumn("o_totalprice", moved)
    found = setops.frame_close(a, b, ["o_orderkey"])
    return found.select("o_orderkey", "column", (F.col("column") == "o_totalprice").alias("far"))


_HOT = "CASE WHEN {0} % 3 = 0 THEN NULL ELSE {1} END"


@query(
    "merge_skewed",
    f"""WITH l AS (SELECT {_HOT.format("c_custkey", "c_nationkey")} AS key, c_custkey FROM customer),
    r AS (SELECT {_HOT.format("s_suppkey", "s_nationkey")} AS key, s_suppkey FROM supplier)
    SELECT l.key, c_custkey, s_suppkey FROM l JOIN r ON l.key IS NOT DISTINCT FROM r.key""",
)
def _(spark, d):
    left = table(spark, d, "customer").selectExpr(_HOT.format("c_custkey", "c_nationkey") + " AS key", "c_custkey")
    right = table(spark, d, "supplier").selectExpr(_HOT.format("s_suppkey", "s_nationkey") + " AS key", "s_suppkey")
    return joins.merge(left, right, ["key"], match_nulls=True, salts="auto", hot_rows=200)


# every row of a user is one of a repeated key; missing users meet as well
_REPEATED = "SELECT CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id END AS user_id, event_type, value{0} AS value FROM events{1}"
_MOVED = " * CASE WHEN event_id % 50 = 3 THEN 1.5 ELSE 1 + 1e-9 END", " WHERE event_id % 211 <> 5"


@query(
    "frame_close_repeats",
    f"""WITH a AS ({_REPEATED.format("", "")}), b AS ({_REPEATED.format(*_MOVED)}),
    x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, value) AS r FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)),
    y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, value) AS r FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)),
    j AS (SELECT coalesce(x.user_id, y.user_id) AS user_id, x.r AS xr, y.r AS yr, x.event_type AS ta, y.event_type AS tb, x.value AS va, y.value AS vb
      FROM x FULL JOIN y ON x.r = y.r AND x.user_id IS NOT DISTINCT FROM y.user_id)
    SELECT user_id, '__row' AS "column", count(*) AS n FROM j WHERE xr IS NULL OR yr IS NULL GROUP BY ALL
    UNION ALL SELECT user_id, 'event_type', count(*) FROM j WHERE ta <> tb GROUP BY ALL
    UNION ALL SELECT user_id, 'value', count(*) FROM j WHERE abs(va - vb) > 1e-8 + 1e-5 * abs(vb) GROUP BY ALL""",
)
def _(spark, d):
    events = table(spark, d, "events")
    events.createOrReplaceTempView("__repeated_events")
    a, b = (spark.sql(_REPEATED.format(*x).replace("FROM events", "FROM __repeated_events")) for x in (("", ""), _MOVED))
    found = setops.frame_close(a, b, ["user_id"])
    return found.groupBy("user_id", "column").agg(F.count("*").alias("n"))
