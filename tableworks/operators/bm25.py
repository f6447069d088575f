"""BM25 over a postings table with bounds per block, so that a top-k query reads only the blocks that can still count."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .curation import words

K1, B = 1.2, 0.75
#: Documents in a block on average, and blocks scored in full to find a first threshold.
BLOCK_DOCS, SEEDS = 512, 3
#: Rows of small tables that may be broadcast: terms asked for, blocks to score, keys that come repeatedly.
BROADCAST_TERMS = BROADCAST_BLOCKS = BROADCAST_DOCS = 1_000_000
#: Queries that meet a block at a time, on average.
PART_QUERIES = 1024


@dataclass
class Bm25Index:
    """``postings`` (block, term, docs, tfs, sizes, top): the documents of a block that have the term, how often, and their lengths; and the
    largest gain of one of them by one occurrence of the term in a query, but for the factor ``idf`` of ``frequency`` (term, idf).
    ``mean``, ``k1`` and ``b`` make weights of them."""

    postings: DataFrame
    frequency: DataFrame
    mean: float
    k1: float
    b: float


def _gains(tfs: np.ndarray, sizes: np.ndarray, mean: float, k1: float, b: float, idf: np.ndarray | float = 1.0) -> np.ndarray:
    return idf * tfs * (k1 + 1) / (tfs + k1 * (1 - b + b * sizes / mean))


def bm25_index(df: DataFrame, path: str, *, key: str, text: str, block_docs: int = BLOCK_DOCS, k1: float = K1, b: float = B) -> Bm25Index:
    """Index ``df`` (unique key, text) into tables below ``path``.

    The weight of a term is ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b * length / mean length)), with N the
    documents that have a word. Documents are dealt to blocks by a hash of their key, which is the only shuffle of texts; a block's words are
    counted and packed by term where it lies. A frequent term's postings are spread over all blocks. Texts with equal keys are one
    document; their words are counted before, by an aggregate.
    """
    spark = df.sparkSession
    texts = df.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    lengths = texts.select("doc", F.size(words(F.col("text"))).cast("long").alias("own")).where("own > 0")
    lengths = lengths.groupBy("doc").agg(F.sum("own").alias("size"), F.count("*").alias("rows"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.count_if(F.col("rows") > 1).alias("repeated")).first()
    n, mean = corpus.n, corpus.mean or 1.0
    block = F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-n // block_docs)))).cast("int").alias("block")
    once = F.lit(None).cast("array<long>").alias("times")
    single = texts
    if corpus.repeated:
        several = lengths.where("rows > 1").select(F.col("doc").alias("of"))
        several = F.broadcast(several) if corpus.repeated <= BROADCAST_DOCS else several
        same = F.col("doc").eqNullSafe(F.col("of"))
        single = texts.join(several, same, "left_anti")
    rows = single.select(block, "doc", "text").repartition("block").select("block", "doc", words(F.col("text")).alias("words"), once).where(F.size("words") > 0)
    if corpus.repeated:
        found = texts.join(several, same, "left_semi").select("doc", F.explode(words(F.col("text"))).alias("word"))
        counted = found.groupBy("doc", "word").agg(F.count("*").alias("times")).groupBy("doc")
        counted = counted.agg(F.collect_list(F.struct("word", "times")).alias("all"))
        rows = rows.unionByName(counted.select(block, "doc", F.col("all.word").alias("words"), F.col("all.times").alias("times")))

    def packed(held: pa.Table) -> pa.Table:
        """The words of a block's documents, by term."""
        lists, counts = held.column("words").combine_chunks(), held.column("times").combine_chunks()
        own = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        # rows without counts have each word once for each time it occurs
        times = np.ones(len(own), np.int64)
        times[~counts.is_null().to_numpy(zero_copy_only=False)[own]] = counts.flatten().to_numpy(zero_copy_only=False)
        at, place = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(lists) + own, return_inverse=True)
        tfs = np.bincount(place, weights=times).astype(np.int64)
        doc, term = at % max(1, len(lists)), at // max(1, len(lists))
        sizes = np.bincount(own, weights=times, minlength=len(lists)).astype(np.int64)[doc]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        ends = pa.array(np.append(starts, len(at)), pa.int32())
        top = np.maximum.reduceat(_gains(tfs, sizes, mean, k1, b), starts) if len(starts) else np.zeros(0)
        columns = [
            pa.array(np.full(len(starts), held.column("block")[0].as_py()), pa.int32()), coded.dictionary.take(pa.array(term[starts])),
            *(pa.ListArray.from_arrays(ends, x) for x in (held.column("doc").combine_chunks().take(pa.array(doc)), pa.array(tfs), pa.array(sizes))), pa.array(top),
        ]
        return pa.Table.from_arrays(columns, names=["block", "term", "docs", "tfs", "sizes", "top"])

    schema = f"block int, term string, docs array<{texts.schema['doc'].dataType.simpleString()}>, tfs array<long>, sizes array<long>, top double"
    postings = rows.groupBy("block").applyInArrow(packed, schema)
    postings.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    postings = spark.read.schema(schema).parquet(f"{path}/postings")
    frequency = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    frequency = frequency.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    frequency.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/frequency")
    return Bm25Index(postings, spark.read.schema(frequency.schema).parquet(f"{path}/frequency"), mean, k1, b)


def bm25_topk(index: Bm25Index, queries: DataFrame, *, key: str, text: str, k: int, seeds: int = SEEDS) -> DataFrame:
    """(query key, rank, doc, score): the ``k`` best documents for each query, equal scores by key; only documents that share a term.

    First the blocks with the highest bounds are scored, which gives each query a k-th best score so far; then only the blocks whose
    bound reaches it. A block left out cannot hold a better document, so the result is that of scoring all. Postings and queries meet by
    block, so a term that a third of all documents have is no single key, and a block gives its k best per query. Of many queries,
    PART_QUERIES at a time meet a block.
    """
    asked = queries.select(F.col(key).alias("query"), F.explode(words(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    n = asked.agg(F.count_distinct("term").alias("terms"), F.count_distinct("query").alias("queries")).first()
    few = F.broadcast if n["terms"] <= BROADCAST_TERMS else lambda rows: rows
    terms = index.frequency.join(few(asked.select("term").distinct()), "term", "left_semi")
    parts = max(1, -(-n["queries"] // PART_QUERIES))
    mean, k1, b = index.mean, index.k1, index.b
    # only postings and bounds of terms that are asked for are read on; those of a block and term are one row
    postings = index.postings.join(few(terms), "term")
    pairs = asked.join(postings.select("term", "block", (F.col("top") * F.col("idf")).alias("top")), "term")
    reach = pairs.groupBy("query", "block").agg(F.sum(F.col("times") * F.col("top")).alias("bound"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    reach = reach.withColumn("place", place)

    schema = f"query {asked.schema['query'].dataType.simpleString()}, doc {postings.schema['docs'].dataType.elementType.simpleString()}, score double"
    part = F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("part")
    blocks_of = F.broadcast if reach.select("block").distinct().count() <= BROADCAST_BLOCKS else lambda rows: rows

    def scored(blocks: DataFrame) -> DataFrame:
        """The blocks' best. Only their postings are shuffled."""
        wanted = pairs.select("query", "term", "block", "times").join(blocks.select("query", "block"), ["query", "block"])
        asking = wanted.select("query", "term", "times", F.col("block").alias("at"), part)
        held = postings.join(blocks_of(blocks.select("block").distinct()), "block", "left_semi").select("term", "block", "idf", "docs", "tfs", "sizes")
        dealt = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else held.withColumn("part", F.lit(0))
        return asking.groupBy("at", "part").cogroup(dealt.groupBy("block", "part")).applyInArrow(best_of_block, schema)

    def best_of_block(wanted: pa.Table, held: pa.Table) -> pa.Table:
        """The k best of a block for each query that asks for it: no other can be among the k best of all."""
        lists = {x: held.column(x).combine_chunks() for x in ("docs", "tfs", "sizes")}
        own = np.repeat(np.arange(held.num_rows), pc.list_value_length(lists["docs"]).to_numpy(zero_copy_only=False))
        tfs, sizes = (lists[x].flatten().to_numpy(zero_copy_only=False) for x in ("tfs", "sizes"))
        weight = _gains(tfs, sizes, mean, k1, b, held.column("idf").to_numpy()[own])
        flat = pa.table({"term": held.column("term").combine_chunks().take(pa.array(own)), "doc": lists["docs"].flatten(), "weight": weight})
        flat = flat.filter(pc.is_valid(flat.column("doc")))
        rows = wanted.select(["query", "term", "times"]).join(flat, "term", join_type="inner", use_threads=False)
        rows = rows.append_column("gain", pc.multiply(pc.cast(rows.column("times"), pa.float64()), rows.column("weight")))
        sums = rows.group_by(["query", "doc"], use_threads=False).aggregate([("gain", "sum")])
        sums = sums.select(["query", "doc", "gain_sum"]).rename_columns(["query", "doc", "score"])
        sums = sums.sort_by([("query", "ascending"), ("score", "descending"), ("doc", "ascending")])
        own = sums.column("query").combine_chunks().dictionary_encode()
        own = (own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own).indices.to_numpy(zero_copy_only=False)
        return sums.filter(pa.array(np.arange(len(own)) - np.searchsorted(own, own) < k))

    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    first = scored(reach.where(F.col("place") <= seeds)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    least = first.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    # a little below the threshold, as sums of the same weights in another order may differ in the last digits
    rest = reach.where(F.col("place") > seeds).join(least, "query", "left").where("least IS NULL OR bound >= least * (1 - 1e-9)")
    both = first.select("query", "doc", "score").union(scored(rest))
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(key), F.col("rank").cast("int").alias("rank"), "doc", "score")
