"""Queries over chunks, vectors, search, reranking and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.encoders import HashEncoder
from ..operators import retrieval as R
from ..operators import search as S
from ..session import table
from .registry import query
from .tabular import ITEMS_SQL, extracted_items

# --- chunks and texts -------------------------------------------------------------------------

CHUNKS_SQL = """
WITH chunks AS (
  SELECT doc_id, lang, source, n_chars, chunk_no, substr(text, chunk_no * 680 + 1, 800) AS chunk FROM (
    SELECT *, unnest(range(0, greatest(1, ceil((length(text) - 120) / 680.0))::BIGINT)) AS chunk_no
    FROM documents WHERE length(text) > 0))
"""


@query("chunk_fixed", CHUNKS_SQL + "SELECT * FROM chunks")
def chunk_fixed(spark, sf):
    return R.chunk_fixed(table(spark, sf, "documents"), text="text", key="doc_id")


@query("chunk_recursive")
def chunk_recursive(spark, sf):
    return R.chunk_recursive(table(spark, sf, "documents"), text="text", key="doc_id")


@query("prefix_text", """
SELECT doc_id AS id, 'passage: ' || text AS text FROM documents UNION ALL SELECT item_id, 'query: ' || text FROM benchmark""")
def prefix_text(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return R.prefix_text(docs, col="text", kind="passage").unionByName(R.prefix_text(questions, col="text", kind="query"))


@query("truncate_text", "SELECT doc_id, substr(text, 1, 8000) AS text FROM documents")
def truncate_text(spark, sf):
    return R.truncate_text(table(spark, sf, "documents").select("doc_id", "text"), col="text", n=8000)


ENCODED_SQL = """
WITH coded AS (
  SELECT doc_id, CASE lang WHEN 'de' THEN base64(encode(text)) WHEN 'es' THEN 'not base64!' WHEN 'fr' THEN '' ELSE text END AS content,
         lang, text FROM documents)
"""


def encoded_documents(spark, sf):
    lang = F.col("lang")
    one_line = F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "")  # Spark breaks lines every 76 characters
    content = (
        F.when(lang == "de", one_line).when(lang == "es", "not base64!").when(lang == "fr", "").otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select("doc_id", "lang", content.alias("content"))


@query("sniff_base64", ENCODED_SQL + """
SELECT doc_id, length(content) > 100 AND instr(substr(content, 1, 50), ' ') = 0 AS is_base64 FROM coded""")
def sniff_base64(spark, sf):
    return R.sniff_base64(encoded_documents(spark, sf), col="content").select("doc_id", "is_base64")


@query("decode_base64", ENCODED_SQL + r"""
SELECT doc_id, CASE WHEN regexp_full_match(solid, '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}(==)?|[A-Za-z0-9+/]{3}=?)?') AND length(raw) > 0
            THEN md5(from_base64(rpad(solid, (ceil(length(solid) / 4.0) * 4)::INTEGER, '='))) END AS digest FROM (SELECT doc_id, content AS raw, regexp_replace(content, '\s', '', 'g') AS solid FROM coded)""")
def decode_base64(spark, sf):
    return R.decode_base64(encoded_documents(spark, sf), col="content").select("doc_id", F.md5("decoded").alias("digest"))


# --- vectors ----------------------------------------------------------------------------------

HASHED_SQL = r"""
words AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM texts),
counts AS (SELECT id, (('0x' || substr(md5(w), 1, 6))::BIGINT % 64)::BIGINT AS slot, count(*)::DOUBLE AS n FROM words GROUP BY ALL),
sparse AS (SELECT id, slot, n / (sqrt(sum(n * n) OVER (PARTITION BY id)) + 1e-12) AS value FROM counts)
"""


@query("embed_batches", "WITH texts AS (SELECT doc_id AS id, 'passage: ' || text AS text FROM documents)," + HASHED_SQL + """
SELECT id AS doc_id, slot, round(value, 6) AS value FROM sparse""")
def embed_batches(spark, sf):
    docs = R.prefix_text(table(spark, sf, "documents").select("doc_id", "text"), col="text", kind="passage")
    out = R.embed_batches(docs, col="text", encoder=HashEncoder)
    long = out.select("doc_id", F.posexplode_outer("embedding").alias("slot", "value")).where("value <> 0")
    return long.select("doc_id", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


@query("masked_mean_pool", """
WITH tokens AS (SELECT label, embedding[i]::DOUBLE AS x, i - 1 AS slot, embedding[1] > 0 AS live FROM embeddings, range(1, 65) t(i)),
means AS (SELECT label, slot, avg(x) AS m FROM tokens WHERE live GROUP BY ALL)
SELECT label, slot, round(m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-12), 6) AS value FROM means""")
def masked_mean_pool(spark, sf):
    tokens = table(spark, sf, "embeddings").withColumn("mask", (F.col("embedding")[0] > 0).cast("int"))
    out = R.masked_mean_pool(tokens, vectors="embedding", mask="mask", by="label")
    long = out.select("label", F.posexplode_outer("embedding").alias("slot", "value"))
    return long.select("label", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


@query("l2_normalize", """
SELECT vec_id, i - 1 AS slot, round(embedding[i]::DOUBLE * (1 + label) /
       (sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * (1 + label)) ** 2))) + 1e-12), 6) AS value
FROM embeddings, range(1, 65) t(i)""")
def l2_normalize(spark, sf):
    scaled = table(spark, sf, "embeddings").withColumn("embedding", F.expr("transform(embedding, x -> cast(x AS DOUBLE) * (1 + label))"))
    out = R.l2_normalize(scaled, col="embedding")
    long = out.select("vec_id", F.posexplode_outer("embedding").alias("slot", "value"))
    return long.select("vec_id", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


def _knn_sql(score: str, order: str, shown: str = "round(s, 9)") -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {score} AS s FROM v AS q, v),
ranked AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS rank FROM pairs)
SELECT query_id, id, rank, round({shown}, 6) AS score FROM ranked WHERE rank <= 6"""


def _knn(metric: str):
    def run(spark, sf):
        vectors = table(spark, sf, "embeddings")
        out = S.knn_topk(vectors, vectors, k=6, metric=metric, query_id="vec_id", id="vec_id")
        return out.withColumn("score", F.round("score", 6))

    return run


query("knn_topk", _knn_sql("list_dot_product(q.e, v.e)", "round(s, 9) DESC"))(_knn("ip"))
query("knn_topk_cosine", _knn_sql("list_cosine_similarity(q.e, v.e)", "round(s, 9) DESC"))(_knn("cosine"))
query("knn_topk_l2", _knn_sql("list_distance(q.e, v.e)", "round(s * s, 9)", "sqrt(round(s * s, 9))"))(_knn("l2"))


@query("knn_lsh")
def knn_lsh(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return S.knn_lsh(vectors, vectors, k=6, dim=64, query_id="vec_id", id="vec_id").withColumn("score", F.round("score", 6))


@query("metadata_filtered_knn", _knn_sql("list_dot_product(q.e, v.e)", "round(s, 9) DESC").replace("FROM v AS q, v)", "FROM v AS q, v WHERE v.vec_id IN (SELECT vec_id FROM embeddings WHERE label IN (1, 3)))"))
def metadata_filtered_knn(spark, sf):
    """Every vector as a query, two labels to be searched."""
    vectors = table(spark, sf, "embeddings")
    out = S.knn_topk(vectors, vectors, k=6, query_id="vec_id", id="vec_id", where="label IN (1, 3)")
    return out.withColumn("score", F.round("score", 6))


@query("lookup_payload", _knn_sql("list_dot_product(q.e, v.e)", "round(s, 9) DESC").replace("SELECT query_id, id, rank, round(round(s, 9), 6) AS score FROM ranked WHERE rank <= 6", """
SELECT query_id, id, rank, lang, source, n_chars FROM ranked JOIN documents ON id = doc_id WHERE rank <= 6"""))
def lookup_payload(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return R.lookup_payload(_knn("ip")(spark, sf), docs).drop("score")


# --- rerank, context, citations ---------------------------------------------------------------

PAIRS_SQL = r"""
WITH opening AS (SELECT conv_id AS query_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
pairs AS (SELECT query_id, query, turn AS id, text AS passage FROM opening JOIN conversations ON conv_id = query_id WHERE role = 'assistant'),
tokens AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS qw,
                  list_distinct(regexp_extract_all(lower(passage), '[\p{L}\p{N}]+')) AS pw FROM pairs),
scored AS (SELECT query_id, query, id, passage,
                  round(CASE WHEN len(qw) = 0 THEN 0.0 ELSE len(list_intersect(qw, pw))::DOUBLE / len(qw) END, 9) AS rerank_score FROM tokens),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rerank_rank FROM scored)
"""


def message_pairs(spark, sf):
    """Opening question of each thread against every reply in it."""
    messages = table(spark, sf, "conversations")
    opening = messages.where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("query"))
    replies = messages.where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), F.col("text").alias("passage"))
    return opening.join(replies, "query_id")


@query("rerank", PAIRS_SQL + "SELECT query_id, id, rerank_rank, round(rerank_score, 6) AS rerank_score FROM ranked WHERE rerank_rank <= 3")
def rerank(spark, sf):
    out = R.rerank(message_pairs(spark, sf), top_n=3)
    return out.select("query_id", "id", "rerank_rank", F.round("rerank_score", 6).alias("rerank_score"))


@query("pair_prompt", PAIRS_SQL + r"""
SELECT query_id, id, 'question:' || query || ' ' || chr(10) || ' ' || chr(10) || ' passage:' || passage AS prompt FROM pairs""")
def pair_prompt(spark, sf):
    return R.pair_prompt(message_pairs(spark, sf)).select("query_id", "id", "prompt")


@query("assemble_context", PAIRS_SQL + r"""
SELECT query_id, string_agg('[Source ID: ' || rerank_rank || ' | Type: TEXT | Page: ' || id || ']' || chr(10) || passage || chr(10) || chr(10), '' ORDER BY rerank_rank) AS context,
       count(*) AS n_hits FROM ranked WHERE rerank_rank <= 3 GROUP BY query_id""")
def assemble_context(spark, sf):
    best = R.rerank(message_pairs(spark, sf), top_n=3).withColumns({"type": F.lit("text"), "page": F.col("id")})
    return R.assemble_context(best, text="passage")


@query("assemble_context_numbered", PAIRS_SQL + r"""
SELECT query_id, string_agg(rerank_rank || '. ' || passage, chr(10) || chr(10) ORDER BY rerank_rank) AS context, count(*) AS n_hits
FROM ranked WHERE rerank_rank <= 3 GROUP BY query_id""")
def assemble_context_numbered(spark, sf):
    return R.assemble_context(R.rerank(message_pairs(spark, sf), top_n=3), text="passage", style="numbered")


@query("citation_check", PAIRS_SQL + """,
kept AS (SELECT query_id, rerank_rank AS source_id, id AS page, passage FROM ranked WHERE rerank_rank <= 3),
cited AS (SELECT query_id, source_id, page, 2::BIGINT AS n_cited, true AS found FROM kept
          UNION ALL SELECT query_id, source_id, -1, 1, false FROM kept)
SELECT * FROM cited""")
def citation_check(spark, sf):
    """Answers that cite every kept hit twice and each once with a wrong page."""
    best = R.rerank(message_pairs(spark, sf), top_n=3).withColumns({"rank": F.col("rerank_rank"), "page": F.col("id")})
    good = F.format_string("[Source ID: %d, Page: %d]", "rank", "page")
    wrong = F.format_string("[Source ID: %d, Page: -1]", "rank")
    answers = best.select("query_id", F.concat(F.lit("As said "), good, F.lit(" and "), wrong, F.lit(", again "), good, F.lit(" [Source ID: x]")).alias("answer"))
    return R.citation_check(answers, best)


@query("retrieve_rerank_context", CHUNKS_SQL + """,
texts AS (SELECT doc_id * 16777216 + chunk_no AS id, 'passage: ' || chunk AS text FROM chunks
          UNION ALL SELECT -1 - item_id, 'query: ' || text FROM benchmark),""" + HASHED_SQL + r""",
q AS (SELECT -1 - id AS query_id, slot, value FROM sparse WHERE id < 0),
pairs AS (SELECT query_id, id, sum(q.value * s.value) AS s FROM q JOIN sparse AS s USING (slot) WHERE s.id >= 0 GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM pairs),
found AS (SELECT query_id, h.id, b.text AS query, c.chunk AS passage, c.lang, c.chunk_no,
                 list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}]+')) AS qw,
                 list_distinct(regexp_extract_all(lower(c.chunk), '[\p{L}\p{N}]+')) AS pw
          FROM hits h JOIN chunks c ON h.id = c.doc_id * 16777216 + c.chunk_no JOIN benchmark b ON query_id = item_id WHERE rank <= 20),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(len(list_intersect(qw, pw))::DOUBLE / len(qw), 9) DESC, id) AS r FROM found)
SELECT query_id, string_agg('[Source ID: ' || r || ' | Type: ' || upper(lang) || ' | Page: ' || chunk_no || ']' || chr(10) || passage || chr(10) || chr(10), '' ORDER BY r) AS context,
       count(*) AS n_hits FROM best WHERE r <= 5 GROUP BY query_id""")
def retrieve_rerank_context(spark, sf):
    """Every benchmark text as a question against the chunks of every document."""
    chunks = R.chunk_fixed(table(spark, sf, "documents"), text="text", key="doc_id")
    docs = chunks.select(
        (F.shiftleft(F.col("doc_id"), 24) + F.col("chunk_no")).alias("id"), F.col("chunk").alias("text"),
        F.col("lang").alias("type"), F.col("chunk_no").alias("page"),
    )
    index = R.embed_batches(R.prefix_text(docs, col="text", kind="passage", out="passage"), col="passage", encoder=HashEncoder)
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    questions = R.embed_batches(R.prefix_text(questions, col="query", kind="query", out="q"), col="q", encoder=HashEncoder)
    return R.retrieve_rerank_context(questions, index.select("id", "embedding"), docs, k=20, top_n=5)


# --- extracted items --------------------------------------------------------------------------

FLAT_SQL = ITEMS_SQL + """,
flat AS (SELECT item_id, content AS text, coalesce(source_name, 'Unknown') AS source, coalesce(page_number, -1) AS page, type AS doc_type,
                coalesce(subtype, '') AS subtype, coalesce(nullif(subtype, ''), type) AS type, table_content, image_content FROM items)
"""


@query("flatten_items", FLAT_SQL + "SELECT * FROM flat")
def flatten_items(spark, sf):
    return R.flatten_items(extracted_items(spark, sf))


@query("route_modality", FLAT_SQL + """,
routed AS (SELECT *, subtype IN ('chart', 'table') AND image_content IS NOT NULL AND image_content <> 'not base64!' AS has_image FROM flat)
SELECT item_id, CASE WHEN has_image AND table_content IS NOT NULL THEN table_content ELSE text END AS text, source, page, type,
       CASE WHEN has_image AND table_content IS NOT NULL THEN 'image_text' WHEN has_image THEN 'image' ELSE 'text' END AS modality,
       has_image, CASE WHEN has_image THEN image_content ELSE '' END AS image_b64 FROM routed""")
def route_modality(spark, sf):
    return R.route_modality(R.flatten_items(extracted_items(spark, sf)))
