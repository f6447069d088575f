"""Operator 1: near-duplicate documents by ProbMinHash, banding and verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Words, counted, mix, read, released, shingles, short_batches, stored, uniform
from .nearpairs import connect
from .registry import query

THRESHOLD = 0.8
#: Of two documents at the threshold, 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9999 share a band.
BANDS, ROWS = 24, 5
#: Bytes of text hashed together; bounds memory.
SLICE = 1 << 20


def prob_min_hash(shingle: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """For each of ``n`` documents the shingle that arrives first in each of ``m`` registers.

    Each shingle is a Poisson process whose rate is its weight: exponential gaps, drawn from its hash, each arrival in a register
    drawn from its hash. Two documents agree in a register with their probability Jaccard. All documents advance together by one
    arrival per round; a shingle ends once its next arrival is later than the latest register of its document.
    """
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    limit = np.full(n, np.inf)
    time = np.zeros(len(shingle))
    turn = 0
    while len(shingle):
        drawn = mix(shingle + np.uint64((2 * turn + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        time = time - np.log(uniform(drawn)) / weight
        early = time < limit[owner]
        shingle, owner, weight, time, drawn = shingle[early], owner[early], weight[early], time[early], drawn[early]
        at = owner * m + (mix(drawn + np.uint64(0xA24BAED4963EE407)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        winner[at[won]] = shingle[won]
        if turn < 16 or turn % 8 == 0:
            live = np.unique(owner) if len(owner) < n else np.arange(n)
            limit[live] = first.reshape(n, m)[live].max(axis=1)
        turn += 1
    return winner.reshape(n, m)


def _sign(batches):
    """doc_id, a digest of the compared words, and one hash per band."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    names = ["doc_id", "digest", "n", "keys"]
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lo = 0
        while lo < len(ids):
            hi, size = lo, 0
            while hi < len(ids) and (hi == lo or size < SLICE):
                size += len(texts[hi] or "")
                hi += 1
            words = Words([(t or "").lower().encode() for t in texts[lo:hi]])
            cut = words.starts
            digests = [
                hashlib.md5(words.hash[a:b].tobytes()).digest() if b > a and i is not None else None
                for i, a, b in zip(ids[lo:hi], cut[:-1], cut[1:])
            ]
            winner = prob_min_hash(*counted(*shingles(words.hash, cut)), hi - lo).reshape(hi - lo, BANDS, ROWS)
            keys = np.broadcast_to(salt, (hi - lo, BANDS)).copy()
            for r in range(ROWS):
                keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + winner[:, :, r])
            lists = [list(k) if d is not None else None for d, k in zip(digests, keys.view(np.int64).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(digests, pa.binary()), pa.array(np.diff(cut)), pa.array(lists, pa.list_(pa.int64()))], names)
            lo = hi


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, component_id, kept) of every row of ``documents`` (doc_id, text).

    Shingles are runs of five words (lower case, without ASCII punctuation; a shorter text is one run), weighted by how often they
    occur. Texts with the same words are one class, ``class_id`` its smallest doc_id. Classes are linked if their probability Jaccard
    is ``threshold`` or more, computed exactly for candidates that share a band; ``component_id`` is the smallest doc_id linked by a
    chain, ``kept`` says that it is the row's own. Copies are never paired with each other.

    Null texts, texts without a word and rows without doc_id link with nothing: their class and component are their doc_id (kept is
    true). Rows repeated with one doc_id get the same result each. Further columns are ignored; an empty table gives none.
    """
    with short_batches(documents.sparkSession):
        signed, by_class = _classes(documents, threshold)
    joined = signed.select("doc_id", "digest").join(by_class, "digest", "left")
    own = F.coalesce("class_id", "doc_id")
    component = F.coalesce("component", own)
    return joined.select(
        "doc_id", own.alias("class_id"), component.alias("component_id"), (F.coalesce(F.col("doc_id") == component, F.lit(True))).alias("kept")
    )


def _classes(documents: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row, and (digest, class_id, component) of every class."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(rows.mapInArrow(released(_sign), "doc_id long, digest binary, n long, keys array<long>"), "minhash")
    classes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    classes = stored(classes, "minhash-classes")
    texts = rows.withColumnRenamed("doc_id", "id")
    members = classes.select(F.explode("keys").alias("key"), F.col("class_id").alias("id"))
    parts = connect(members, classes.select(F.col("class_id").alias("id"), "n"), lambda ids: texts, threshold, weighted=True)
    return signed, classes.select("digest", "class_id").join(parts.withColumnRenamed("id", "class_id"), "class_id", "left")


def deduplicated(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``documents`` that are kept, all columns as they are; of rows repeated with one doc_id one stays."""
    result = stored(near_duplicates(documents, threshold), "minhash-result")
    gone = result.where("NOT kept").select("doc_id").distinct()
    kept = documents.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(documents.columns)
    again = result.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.limit(1).count():
        return kept
    again = stored(again, "repeated")
    few = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    return kept.join(few, "doc_id", "left_anti").select(documents.columns).union(kept.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(documents.columns))


@query("op1_minhash_dedup")
def op1_minhash_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))
