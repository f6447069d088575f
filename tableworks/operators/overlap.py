"""Overlap of documents with benchmark items: shared runs of words, how much of an item is covered, the longest common run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from .curation import words

GRAM = 8
#: The index of items is broadcast up to so many bytes; a larger one is joined by shuffling the grams that the filter lets through.
BROADCAST_BYTES = 32 << 20
#: Slots of the filter for each gram, and the most slots (a byte each).
SLOTS, MOST_SLOTS = 16, 1 << 23


def grams(text: Column, n: int) -> Column:
    """array<struct<pos, words>>: every run of ``n`` words and its 0-based place; none for a shorter text."""

    def runs(found: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(found) - n + 1), lambda i: F.struct((i - 1).alias("pos"), F.slice(found, i, n).alias("words")))
        return F.when(F.size(found) >= n, every).otherwise(F.array().cast("array<struct<pos:int,words:array<string>>>"))

    return bound(words(text), runs)


def gram_index(items: DataFrame, *, key: str, text: str, n: int = GRAM) -> DataFrame:
    """(gram, item, item_pos, item_grams): the inverted index, with places; ``item_grams`` counts an item's distinct grams."""
    rows = items.select(F.col(key).alias("item"), F.explode(grams(F.col(text), n)).alias("g"))
    rows = rows.select(F.array_join("g.words", " ").alias("gram"), "item", F.col("g.pos").alias("item_pos")).distinct()
    sizes = rows.groupBy("item").agg(F.countDistinct("gram").alias("item_grams"))
    return rows.join(sizes, "item")


def _slot(run: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(slots)).cast("int")


def _filter(index: DataFrame, slots: int) -> bytes:
    """A byte per slot, 1 where some gram of the index falls."""
    used = index.select(_slot(F.split("gram", " "), slots).alias("s")).distinct().toArrow()["s"].to_pylist()
    out = bytearray(slots)
    for s in used:
        out[s] = 1
    return bytes(out)


def benchmark_overlap(
    df: DataFrame, items: DataFrame, *, key: str, text: str, item_key: str, item_text: str, n: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(key, item key, n_shared, containment, longest_run) of every document and item that share a run of ``n`` words.

    ``n_shared`` counts distinct shared runs, ``containment`` is its share of the item's, ``longest_run`` the most words in a row that both
    have. Documents are scanned once. Each of their runs is first looked up in a filter of bounded size; what it lets through
    (false ones are few) is joined with the index by its words, so a match is exact. Only matches are shuffled: a passage that a third of all
    documents have is spread by document. Words are lower-cased runs of letters and digits. Items shorter than ``n`` words and
    null texts match nothing; rows with one key are one document.
    """
    index = gram_index(items, key=item_key, text=item_text, n=n).cache()
    size = index.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("gram") + 32), F.lit(0)).alias("b")).first()
    slots = min(MOST_SLOTS, 1 << max(10, (size.n * SLOTS).bit_length()))
    bits = F.lit(_filter(index, slots))
    seen = F.filter(grams(F.col(text), n), lambda g: F.substring(bits, _slot(g["words"], slots) + 1, F.lit(1)) == F.lit(b"\x01"))
    hits = df.select(F.col(key).alias("doc"), F.explode(seen).alias("g")).select("doc", F.col("g.pos").alias("pos"), F.array_join("g.words", " ").alias("gram"))
    matches = hits.join(F.broadcast(index) if size.b <= broadcast_bytes else index, "gram")
    along = Window.partitionBy("doc", "item", "diagonal").orderBy("pos")
    placed = matches.withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    placed = placed.withColumn("island", F.col("pos") - F.dense_rank().over(along))
    runs = placed.groupBy("doc", "item", "diagonal", "island").agg((F.max("pos") - F.min("pos") + n).alias("run"))
    longest = runs.groupBy("doc", "item").agg(F.max("run").cast("long").alias("longest_run"))
    shared = matches.groupBy("doc", "item").agg(F.countDistinct("gram").alias("n_shared"), F.first("item_grams").alias("item_grams"))
    out = shared.join(longest, ["doc", "item"])
    return out.select(F.col("doc").alias(key), F.col("item").alias(item_key), "n_shared", (F.col("n_shared") / F.col("item_grams")).alias("containment"), "longest_run")
