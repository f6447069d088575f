"""Chunks, embeddings, reranking, contexts and citations around vector search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import CHUNK_OVERLAP, CHUNK_SIZE
from ..functions import text as TX
from ..functions import vectors as V
from ..functions.encoders import encode_with
from ..functions.splitting import recursive_chunks
from ..session import scratch_path
from .guards import posexploded, require_columns
from .search import knn_topk


def _exploded(df: DataFrame, key: str, chunks: Column) -> DataFrame:
    other = [c for c in df.columns if c not in (key, "chunk_no", "chunk")]
    return posexploded(df, [key, *other], chunks, "chunk_no", "chunk")


def chunk_fixed(df: DataFrame, *, text: str, key: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Plain character windows: (key, other columns, chunk_no, chunk)."""
    require_columns(df, text, key)
    return _exploded(df, key, TX.fixed_windows(F.col(text), size, overlap)).drop(text)


def chunk_recursive(df: DataFrame, *, text: str, key: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks cut at paragraphs, lines, words or characters, whichever is coarse enough to fit."""
    require_columns(df, text, key)
    return _exploded(df, key, recursive_chunks(size, overlap)(F.col(text))).drop(text)


def prefix_text(df: DataFrame, *, col: str, kind: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, TX.prefixed(F.col(col), kind))


def embed_batches(df: DataFrame, *, col: str, encoder: Callable, batch: int = 8, out: str = "embedding") -> DataFrame:
    """Vectors from an injected encoder factory, loaded once per worker."""
    require_columns(df, col)
    return df.withColumn(out, encode_with(encoder, batch)(F.col(col)))


def masked_mean_pool(df: DataFrame, *, vectors: str, mask: str, by: str, out: str = "embedding") -> DataFrame:
    """Mean of the token vectors with mask 1 per group, scaled to unit length.

    The mean is a partial aggregate, so a group of any size is combined before the shuffle. A
    group without any such token gives a null vector.
    """
    live = F.col(mask).cast("int") == 1
    sums = df.where(live).groupBy(by).agg(Summarizer.mean(array_to_vector(F.col(vectors).cast("array<double>"))).alias("_mean"))
    pooled = sums.select(by, V.l2_normalized(vector_to_array("_mean")).alias(out))
    masked_out = df.groupBy(by).agg(F.max(live).alias("_live")).where(~F.coalesce("_live", F.lit(False)))
    return pooled.unionByName(masked_out.select(by, F.lit(None).cast("array<double>").alias(out)))


def l2_normalize(df: DataFrame, *, col: str, eps: float = 1e-12) -> DataFrame:
    return df.withColumn(col, V.l2_normalized(F.col(col), eps))


def truncate_text(df: DataFrame, *, col: str, n: int) -> DataFrame:
    return df.withColumn(col, F.substring(col, 1, n))


def sniff_base64(df: DataFrame, *, col: str, out: str = "is_base64") -> DataFrame:
    return df.withColumn(out, TX.looks_base64(F.col(col)))


def decode_base64(df: DataFrame, *, col: str, out: str = "decoded") -> DataFrame:
    return df.withColumn(out, TX.decoded_base64(F.col(col)))


def pair_prompt(df: DataFrame, *, query: str = "query", passage: str = "passage", out: str = "prompt") -> DataFrame:
    return df.withColumn(out, F.concat(F.lit("question:"), F.col(query), F.lit(" \n \n passage:"), F.col(passage)))


#: Hits up to so many rows, a few numbers each, are sent to the documents.
BROADCAST_HITS = 1_000_000


def lookup_payload(hits: DataFrame, docs: DataFrame, *, id: str = "id") -> DataFrame:
    """Hits with the columns of their documents.

    The hits are written to the shared folder first, so that the search runs once and their number is known: up to the bound
    they go to the documents, whose texts are then not shuffled; beyond it both sides are joined by id.
    """
    path = scratch_path(hits.sparkSession, "hits")
    hits.write.parquet(path)
    kept = hits.sparkSession.read.schema(hits.schema).parquet(path)
    small = kept.count() <= BROADCAST_HITS
    joined = docs.join(F.broadcast(kept) if small else kept, id)
    return joined.select(id, *[c for c in hits.columns if c != id], *[c for c in docs.columns if c != id])


def overlap_score(query: Column, passage: Column) -> Column:
    """Share of the distinct query words that occur in the passage."""
    wanted = F.array_distinct(TX.words(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, TX.words(passage))).cast("double"), F.size(wanted).cast("double")), F.lit(0.0))


def rerank(
    pairs: DataFrame, *, scorer: Callable[[Column, Column], Column] = overlap_score, top_n: int = 5, query_id: str = "query_id",
    query: str = "query", passage: str = "passage", id: str = "id",
) -> DataFrame:
    """Score (query, passage) pairs and keep the best ``top_n`` per query, ties by id.

    ``scorer`` maps two columns to a score column; a model goes in as a pandas UDF.
    """
    scored = pairs.withColumn("rerank_score", F.round(scorer(F.col(query), F.col(passage)), 9))
    w = Window.partitionBy(query_id).orderBy(F.desc("rerank_score"), F.asc(id))
    out = scored.withColumn("rerank_rank", F.row_number().over(w)).where(F.col("rerank_rank") <= top_n)
    return out.withColumn("rerank_rank", F.col("rerank_rank").cast("long"))


def assemble_context(
    hits: DataFrame, *, style: str = "sources", query_id: str = "query_id", rank: str = "rerank_rank", text: str = "text",
    type: str = "type", page: str = "page",
) -> DataFrame:
    """Ranked hits to one context per query; a query has as many hits as the search kept."""
    if style == "sources":
        item = F.concat(
            F.lit("[Source ID: "), F.col(rank).cast("string"), F.lit(" | Type: "), F.upper(type), F.lit(" | Page: "),
            F.col(page).cast("string"), F.lit("]\n"), F.col(text), F.lit("\n\n"),
        )
        sep = ""
    elif style == "numbered":
        item = F.concat(F.col(rank).cast("string"), F.lit(". "), F.col(text))
        sep = "\n\n"
    else:
        raise ValueError(f"unknown style {style!r}")
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), item.alias("t"))))
    return hits.groupBy(query_id).agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), sep).alias("context"), F.count("*").alias("n_hits")
    )


def retrieve_rerank_context(
    queries: DataFrame, index: DataFrame, docs: DataFrame, *, k: int | None = None, top_n: int = 3, scorer=overlap_score,
    metric: str = "ip", style: str = "sources",
) -> DataFrame:
    """Search, look up, rerank and assemble in one plan: (query_id, context, n_hits).

    ``queries`` has query_id, query and embedding; ``index`` id and embedding; ``docs`` id, text,
    type and page. Twice ``top_n`` candidates are searched unless ``k`` says otherwise, and only
    those reach the scorer.
    """
    hits = knn_topk(queries, index, k=k or 2 * top_n, metric=metric)
    pairs = lookup_payload(hits, docs).join(queries.select("query_id", "query"), "query_id")
    best = rerank(pairs, scorer=scorer, top_n=top_n, passage="text")
    return assemble_context(best, style=style)


# Fixed value: the form in which answers have to cite a source.
CITATION = r"\[Source ID: (\d+), Page: (-?\d+)\]"


def citation_check(answers: DataFrame, hits: DataFrame, *, query_id: str = "query_id", answer: str = "answer", rank: str = "rank", page: str = "page") -> DataFrame:
    """Every citation of an answer with whether the context holds it: (query_id, source_id, page, n_cited, found)."""
    found = F.regexp_extract_all(answer, F.lit(CITATION), 0)
    cited = answers.select(query_id, F.explode(found).alias("c")).select(
        query_id, F.regexp_extract("c", CITATION, 1).cast("long").alias("source_id"), F.regexp_extract("c", CITATION, 2).cast("long").alias("page")
    )
    counted = cited.groupBy(query_id, "source_id", "page").agg(F.count("*").alias("n_cited"))
    known = hits.select(query_id, F.col(rank).cast("long").alias("source_id"), F.col(page).cast("long").alias("page"), F.lit(True).alias("_known")).distinct()
    return counted.join(known, [query_id, "source_id", "page"], "left").select(
        query_id, "source_id", "page", "n_cited", F.coalesce("_known", F.lit(False)).alias("found")
    )


def flatten_items(df: DataFrame, *, item_id: str = "item_id", meta: str = "metadata") -> DataFrame:
    """Nested extraction items to index rows, with the defaults for absent members."""
    m = F.col(meta)
    content, kind = m["content_metadata"], F.coalesce(m["content_metadata"]["type"], F.lit("text"))
    return df.select(
        item_id,
        m["content"].alias("text"),
        F.coalesce(m["source_metadata"]["source_name"], F.lit("Unknown")).alias("source"),
        F.coalesce(content["page_number"], F.lit(-1)).alias("page"),
        kind.alias("doc_type"),
        F.coalesce(content["subtype"], F.lit("")).alias("subtype"),
        F.coalesce(F.nullif(content["subtype"], F.lit("")), kind).alias("type"),
        m["table_metadata"]["table_content"].alias("table_content"),
        m["image_metadata"]["content"].alias("image_content"),
    )


def route_modality(items: DataFrame) -> DataFrame:
    """Flattened items to what is embedded: text, image, or both.

    Only structured items, tables and charts can carry an image: the attached one, or content
    that looks like base64. It counts only if it can be decoded. Items with neither text nor
    image are left out.
    """
    visual = (F.col("doc_type") == "structured") | F.col("subtype").isin("chart", "table")
    attached = F.nullif(F.col("image_content"), F.lit(""))
    b64 = F.when(visual, F.coalesce(attached, F.when(TX.looks_base64(F.col("text")), F.col("text"))))
    out = items.withColumn("_b64", b64).withColumn("has_image", TX.decoded_base64(F.col("_b64")).isNotNull())
    with_table = F.col("has_image") & (F.length("table_content") > 0)
    modality = F.when(F.coalesce(with_table, F.lit(False)), "image_text").when(F.col("has_image"), "image").otherwise("text")
    out = out.withColumns(
        {
            "modality": modality,
            "text": F.when(F.coalesce(with_table, F.lit(False)), F.col("table_content")).otherwise(F.col("text")),
            "image_b64": F.when(F.col("has_image"), F.col("_b64")).otherwise(""),
        }
    )
    return out.where(F.col("has_image") | (F.length("text") > 0)).drop("_b64", "doc_type", "subtype", "table_content", "image_content")
