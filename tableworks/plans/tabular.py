"""Queries over sources and table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile as P
from ..session import scratch_path, table
from ..sources import tables as S
from .registry import query

# --- tables with gaps, derived by a rule both engines can state -------------------------------

GAPS_SQL = """
WITH gaps AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_nationkey = 3 THEN NULL WHEN c_nationkey = 4 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_nationkey = 5 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)
"""


def customer_with_gaps(spark, sf) -> DataFrame:
    nation = F.col("c_nationkey")
    return table(spark, sf, "customer").withColumns(
        {
            "c_acctbal": F.when(nation == 3, None).when(nation == 4, F.lit(float("nan"))).otherwise(F.col("c_acctbal")),
            "c_mktsegment": F.when(nation == 5, None).otherwise(F.col("c_mktsegment")),
        }
    )


# --- sources ----------------------------------------------------------------------------------


@query("read_table", "SELECT * FROM orders")
def read_table(spark, sf):
    return S.read_table(spark, f"{sf}/orders.parquet")


@query("read_table_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_table_csv(spark, sf):
    customers = table(spark, sf, "customer")
    path = scratch_path(spark, "customer.csv")
    customers.write.option("header", True).csv(path)
    return S.read_table(spark, path, schema=customers.schema)


@query("read_text_corpus", "SELECT source, length(text) AS n_chars, md5(text) AS text_md5 FROM documents")
def read_text_corpus(spark, sf):
    """A file per document, in a folder per source; the writer ends each with a line end."""
    path = scratch_path(spark, "corpus")
    S.write_text_corpus(table(spark, sf, "documents"), path, text="text", by="source")
    text = F.regexp_replace("text", r"\n\z", "")
    name = F.regexp_extract("source", "source=([^/]+)/", 1)
    return S.read_text_corpus(spark, path).select(name.alias("source"), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


def experiment_lines(spark, sf) -> DataFrame:
    """Log lines from events: one JSON record each, broken for one event type, blank for another."""
    record = F.concat(
        F.lit('{"task": "optimization", "target": "value", "model": "'), F.col("event_type"),
        F.lit('", "metrics": {"test_accuracy": '), F.col("value").cast("decimal(18,6)").cast("string"),
        F.lit(', "rmse": '), (F.col("value") * 2).cast("decimal(18,6)").cast("string"),
        F.lit('}, "best_params": {"C": '), F.col("user_id").cast("string"),
        F.lit('}, "timestamp": '), F.col("event_id").cast("string"), F.lit("}"),
    )
    return table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", F.substring(record, 1, 40))
        .when(F.col("event_type") == "view", F.lit("  "))
        .otherwise(record)
        .alias("value")
    )


def experiment_log(spark, sf) -> DataFrame:
    path = scratch_path(spark, "experiments")
    experiment_lines(spark, sf).write.text(path)
    return S.read_jsonl_lenient(spark, path)


LOG_SQL = """
WITH log AS (
  SELECT event_type AS model, round(value, 6) AS test_accuracy, round(value * 2, 6) AS rmse, user_id,
         event_id::DOUBLE AS timestamp
  FROM events WHERE event_type NOT IN ('error', 'view'))
"""


@query(
    "read_jsonl_lenient",
    LOG_SQL + """
SELECT 'optimization' AS task, 'value' AS target, model, round(test_accuracy, 6) AS test_accuracy,
       round(rmse, 6) AS rmse, '{"C":' || user_id || '}' AS best_params, timestamp FROM log""",
)
def read_jsonl_lenient(spark, sf):
    return experiment_log(spark, sf).select(
        "task", "target", "model",
        F.round(F.col("metrics")["test_accuracy"], 6).alias("test_accuracy"),
        F.round(F.col("metrics")["rmse"], 6).alias("rmse"),
        F.regexp_replace("best_params", " ", "").alias("best_params"),
        "timestamp",
    )


@query(
    "append_jsonl",
    """SELECT 'event' AS task, event_type AS model, round(value, 6) AS score, 1700000000.0::DOUBLE AS timestamp,
       n AS n_appends FROM events, (SELECT 2::BIGINT AS n)""",
)
def append_jsonl(spark, sf):
    """Two appends after a reset; every record is there as often as it was appended."""
    path = scratch_path(spark, "log")
    rows = table(spark, sf, "events").select("event_id", F.lit("event").alias("task"), F.col("event_type").alias("model"), "value")
    S.append_jsonl(rows, path, now=1.0)
    S.append_jsonl(rows, path, reset=True, now=1.7e9)
    S.append_jsonl(rows, path, now=1.7e9)
    schema = "event_id BIGINT, task STRING, model STRING, value DOUBLE, timestamp DOUBLE"
    log = S.read_jsonl_lenient(spark, path, schema=schema)
    return log.groupBy("event_id", "task", "model", F.round("value", 6).alias("score"), "timestamp").agg(
        F.count("*").alias("n_appends")
    ).drop("event_id")


@query("replicate_to", """
WITH sized AS (SELECT count(*) AS n, (5 * count(*)) // 2 AS want FROM part),
ranked AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part)
SELECT p_partkey, p_name, (rep * sized.n + pos)::BIGINT AS row_no
FROM ranked, sized, range(0, 3) AS r(rep) WHERE rep * sized.n + pos < want""")
def replicate_to(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return S.replicate_to(parts, n=parts.count() * 5 // 2, key="p_partkey")


@query("read_binary_images", """
SELECT page_id, md5(html) AS digest, octet_length(encode(html))::BIGINT AS n_bytes, url AS path FROM pages""")
def read_binary_images(spark, sf):
    """Page bytes stand in for image bytes: written as a struct of bytes and path, read back."""
    path = scratch_path(spark, "images") + ".parquet"
    pages = table(spark, sf, "pages")
    pages.select(
        "page_id", F.struct(F.col("html").cast("binary").alias("bytes"), F.col("url").alias("path")).alias("image")
    ).write.parquet(path)
    return S.read_binary_images(spark, path).select(
        "page_id", F.md5("bytes").alias("digest"), F.length("bytes").cast("long").alias("n_bytes"), "path"
    )


@query("build_vector_index", """
SELECT label, count(*) AS n, count(*) AS n_ids, 64::BIGINT AS dim FROM embeddings GROUP BY label""")
def build_vector_index(spark, sf):
    vectors = table(spark, sf, "embeddings")
    index = S.build_vector_index(vectors, scratch_path(spark, "index"), vector="embedding", dim=64)
    return index.groupBy("label").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.max(F.size("embedding")).cast("long").alias("dim")
    )


@query("write_predictions", "SELECT c_custkey, c_name, round(c_acctbal * 2, 2) AS predictions FROM customer")
def write_predictions(spark, sf):
    scored = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.round(F.col("c_acctbal") * 2, 2).alias("predictions")
    )
    path = scratch_path(spark, "predictions")
    S.write_predictions(scored, path)
    return S.read_table(spark, path, schema=scored.schema)


# --- profiles ---------------------------------------------------------------------------------


@query("profile_shape", "SELECT count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
def profile_shape(spark, sf):
    return P.profile_shape(table(spark, sf, "lineitem"))


GAP_COUNTS_SQL = GAPS_SQL + """,
counts AS (
  SELECT 0::BIGINT AS ordinal, 'c_custkey' AS "column", count(*) FILTER (c_custkey IS NULL) AS n_missing FROM gaps
  UNION ALL SELECT 1, 'c_name', count(*) FILTER (c_name IS NULL) FROM gaps
  UNION ALL SELECT 2, 'c_nationkey', count(*) FILTER (c_nationkey IS NULL) FROM gaps
  UNION ALL SELECT 3, 'c_acctbal', count(*) FILTER (c_acctbal IS NULL OR isnan(c_acctbal)) FROM gaps
  UNION ALL SELECT 4, 'c_mktsegment', count(*) FILTER (c_mktsegment IS NULL) FROM gaps)
"""


@query("profile_missing", GAP_COUNTS_SQL + """
SELECT ordinal, "column", n_missing, (SELECT sum(n_missing) FROM counts)::BIGINT AS n_missing_total FROM counts""")
def profile_missing(spark, sf):
    return P.profile_missing(customer_with_gaps(spark, sf))


@query("profile_missing_top", GAP_COUNTS_SQL + """
SELECT ordinal, "column", n_missing, (SELECT sum(n_missing) FROM counts)::BIGINT AS n_missing_total
FROM counts WHERE n_missing > 0 ORDER BY ordinal LIMIT 5""")
def profile_missing_top(spark, sf):
    return P.profile_missing(customer_with_gaps(spark, sf), top=5)


@query("profile_types", GAP_COUNTS_SQL + """
SELECT ordinal, "column",
       CASE WHEN "column" IN ('c_custkey', 'c_nationkey', 'c_acctbal') THEN 'numeric' ELSE 'categorical' END AS kind,
       (SELECT count(*) FROM gaps) - n_missing AS n_present
FROM counts""")
def profile_types(spark, sf):
    return P.profile_types(customer_with_gaps(spark, sf))


@query("profile_types_training", """
SELECT ordinal::BIGINT AS ordinal, "column", kind, (SELECT count(*) FROM lineitem) AS n_present
FROM (VALUES (0, 'l_orderkey', 'numeric'), (1, 'l_partkey', 'numeric'), (2, 'l_suppkey', 'numeric'),
      (3, 'l_linenumber', 'categorical'), (4, 'l_quantity', 'numeric'), (5, 'l_extendedprice', 'numeric'),
      (6, 'l_discount', 'numeric'), (7, 'l_tax', 'numeric'), (8, 'l_returnflag', 'categorical'),
      (9, 'l_linestatus', 'categorical'), (10, 'l_shipdate', 'categorical')) AS t(ordinal, "column", kind)""")
def profile_types_training(spark, sf):
    return P.profile_types(table(spark, sf, "lineitem"), rule="strict64")


@query("profile_numeric_target", """
SELECT count(DISTINCT l_extendedprice) AS n_distinct, min(l_extendedprice) AS min_value,
       max(l_extendedprice) AS max_value, round(avg(l_extendedprice), 4) AS mean_value FROM lineitem""")
def profile_numeric_target(spark, sf):
    out = P.profile_numeric_target(table(spark, sf, "lineitem"), col="l_extendedprice")
    return out.withColumn("mean_value", F.round("mean_value", 4))


@query("profile_categorical_target", """
WITH c AS (SELECT c_mktsegment AS class, count(*) AS n FROM customer GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS n_distinct, class, n, row_number() OVER (ORDER BY n DESC, class) AS rank
FROM c ORDER BY n DESC, class LIMIT 3""")
def profile_categorical_target(spark, sf):
    return P.profile_categorical_target(table(spark, sf, "customer"), col="c_mktsegment")


@query("profile_categorical_target_wide", """
SELECT count(DISTINCT c_name) AS n_distinct, NULL::VARCHAR AS class, NULL::BIGINT AS n, 1::BIGINT AS rank FROM customer""")
def profile_categorical_target_wide(spark, sf):
    return P.profile_categorical_target(table(spark, sf, "customer"), col="c_name")


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark, sf):
    return P.preview(table(spark, sf, "orders"), key="o_orderkey")


@query("profile_preview_columns", GAPS_SQL + """,
head AS (SELECT * FROM gaps ORDER BY c_custkey LIMIT 20)
SELECT 0::BIGINT AS ordinal, 'c_custkey' AS "column", 'bigint' AS dtype, count(*) AS n_rows,
       count(c_custkey) AS n_present, count(DISTINCT c_custkey) AS n_distinct FROM head
UNION ALL SELECT 1, 'c_name', 'string', count(*), count(c_name), count(DISTINCT c_name) FROM head
UNION ALL SELECT 2, 'c_nationkey', 'int', count(*), count(c_nationkey), count(DISTINCT c_nationkey) FROM head
UNION ALL SELECT 3, 'c_acctbal', 'double', count(*), count(c_acctbal) FILTER (NOT isnan(c_acctbal)),
       count(DISTINCT c_acctbal) FILTER (NOT isnan(c_acctbal)) FROM head
UNION ALL SELECT 4, 'c_mktsegment', 'string', count(*), count(c_mktsegment), count(DISTINCT c_mktsegment) FROM head""")
def profile_preview_columns(spark, sf):
    return P.profile_preview_columns(customer_with_gaps(spark, sf), n=50, key="c_custkey")


@query("context_sample", GAPS_SQL + """,
head AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM gaps ORDER BY c_custkey LIMIT 3),
cells AS (
  SELECT 'row ' || r AS section, 'c_custkey' AS name, c_custkey::VARCHAR AS value FROM head
  UNION ALL SELECT 'row ' || r, 'c_name', c_name FROM head
  UNION ALL SELECT 'row ' || r, 'c_nationkey', c_nationkey::VARCHAR FROM head
  UNION ALL SELECT 'row ' || r, 'c_acctbal', CASE WHEN isnan(c_acctbal) THEN 'NaN' ELSE c_acctbal::VARCHAR END FROM head
  UNION ALL SELECT 'row ' || r, 'c_mktsegment', c_mktsegment FROM head),
counts AS (
  SELECT 'missing' AS section, 'c_custkey' AS name, (count(*) FILTER (c_custkey IS NULL))::VARCHAR AS value FROM gaps
  UNION ALL SELECT 'missing', 'c_name', (count(*) FILTER (c_name IS NULL))::VARCHAR FROM gaps
  UNION ALL SELECT 'missing', 'c_nationkey', (count(*) FILTER (c_nationkey IS NULL))::VARCHAR FROM gaps
  UNION ALL SELECT 'missing', 'c_acctbal', (count(*) FILTER (c_acctbal IS NULL OR isnan(c_acctbal)))::VARCHAR FROM gaps
  UNION ALL SELECT 'missing', 'c_mktsegment', (count(*) FILTER (c_mktsegment IS NULL))::VARCHAR FROM gaps),
types AS (
  SELECT 'type' AS section, name, value
  FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) t(name, value))
SELECT * FROM cells UNION ALL SELECT * FROM counts UNION ALL SELECT * FROM types""")
def context_sample(spark, sf):
    return P.context_sample(customer_with_gaps(spark, sf), key="c_custkey")


@query("task_gate", """
SELECT 'l_extendedprice' AS target, 'classification' AS task, count(DISTINCT l_extendedprice) AS n_distinct,
       count(DISTINCT l_extendedprice) <= 20 AS allowed FROM lineitem
UNION ALL SELECT 'l_linenumber', 'classification', count(DISTINCT l_linenumber), count(DISTINCT l_linenumber) <= 20 FROM lineitem
UNION ALL SELECT 'l_returnflag', 'classification', count(DISTINCT l_returnflag), true FROM lineitem
UNION ALL SELECT 'l_returnflag', 'regression', count(DISTINCT l_returnflag), false FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'regression', count(DISTINCT l_extendedprice), true FROM lineitem""")
def task_gate(spark, sf):
    lines = table(spark, sf, "lineitem")
    cases = [
        ("l_extendedprice", "classification"), ("l_linenumber", "classification"), ("l_returnflag", "classification"),
        ("l_returnflag", "regression"), ("l_extendedprice", "regression"),
    ]
    gates = [P.task_gate(lines, target=t, task=k) for t, k in cases]
    out = gates[0]
    for gate in gates[1:]:
        out = out.unionByName(gate)
    return out


@query("value_distribution", """
SELECT l_returnflag AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 6)::DOUBLE AS pct
FROM lineitem GROUP BY l_returnflag""")
def value_distribution(spark, sf):
    out = P.value_distribution(table(spark, sf, "lineitem"), col="l_returnflag")
    return out.withColumn("pct", F.round(F.col("pct").cast("double"), 6))


# --- extracted items --------------------------------------------------------------------------

ITEMS_SQL = """
WITH items AS (
  SELECT doc_id AS item_id, text AS content,
         CASE WHEN lang = 'de' THEN 'structured' ELSE 'text' END AS type,
         CASE WHEN lang = 'de' THEN 'table' WHEN lang = 'es' THEN 'chart' WHEN lang = 'fr' THEN '' END AS subtype,
         CASE WHEN n_chars < 2000 THEN (n_chars // 100)::INTEGER END AS page_number,
         CASE WHEN lang = 'de' AND n_chars < 1500 THEN 'TABLE ' || doc_id END AS table_content,
         CASE WHEN lang IN ('de', 'es') AND n_chars < 2500 THEN base64(encode(source))
              WHEN lang = 'es' THEN 'not base64!' END AS image_content,
         CASE WHEN lang <> 'es' THEN source END AS source_name
  FROM documents)
"""


def extracted_items(spark, sf) -> DataFrame:
    """Nested extraction items from documents; members are absent by rules on language and size."""
    lang, size = F.col("lang"), F.col("n_chars")
    image = F.when(lang.isin("de", "es") & (size < 2500), F.base64(F.col("source").cast("binary"))).when(
        lang == "es", F.lit("not base64!")
    )
    subtype = F.when(lang == "de", "table").when(lang == "es", "chart").when(lang == "fr", "")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.struct(
            F.col("text").alias("content"),
            F.struct(
                F.when(lang == "de", "structured").otherwise("text").alias("type"),
                subtype.alias("subtype"),
                F.when(size < 2000, F.floor(size / 100).cast("int")).alias("page_number"),
            ).alias("content_metadata"),
            F.when(
                (lang == "de") & (size < 1500), F.struct(F.concat(F.lit("TABLE "), "doc_id").alias("table_content"))
            ).alias("table_metadata"),
            F.when(image.isNotNull(), F.struct(image.alias("content"))).alias("image_metadata"),
            F.when(lang != "es", F.struct(F.col("source").alias("source_name"))).alias("source_metadata"),
        ).alias("metadata"),
    )


@query("filter_by_subtype", ITEMS_SQL + """
SELECT item_id, page_number, table_content FROM items WHERE subtype = 'table'""")
def filter_by_subtype(spark, sf):
    return P.filter_by_subtype(extracted_items(spark, sf), subtype="table").select(
        "item_id", "metadata.content_metadata.page_number", "metadata.table_metadata.table_content"
    )


@query("filter_by_subtype_last", ITEMS_SQL + """
SELECT item_id, page_number FROM items WHERE subtype = 'table' ORDER BY item_id DESC LIMIT 1""")
def filter_by_subtype_last(spark, sf):
    tables = P.filter_by_subtype(extracted_items(spark, sf), subtype="table")
    return P.last_item(tables, order="item_id").select("item_id", "metadata.content_metadata.page_number")


@query("modality_counts", ITEMS_SQL + """
SELECT count(*) AS n_items, count(image_content) AS n_with_image, count(*) - count(image_content) AS n_text_only FROM items""")
def modality_counts(spark, sf):
    return P.modality_counts(extracted_items(spark, sf), image="metadata.image_metadata.content")


@query("select_pages", """
SELECT doc_id, (ordinal - 1)::BIGINT AS page, paragraph FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS paragraph,
         generate_subscripts(string_split(text, chr(10)), 1) AS ordinal FROM documents)
WHERE ordinal - 1 >= 4 AND ordinal - 1 < 10""")
def select_pages(spark, sf):
    docs = table(spark, sf, "documents")
    pages = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("page", "paragraph"))
    return P.select_pages(pages, start=4, stop=10).withColumn("page", F.col("page").cast("long"))
