"""Operator 13: ranked lexical search by pipelined term partitioning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import portions, read, released, stored
from .registry import query

TOP = 10
#: Term occurrences of the items that are searched together; their vocabulary is broadcast.
TERMS = 200_000
#: Items of a bundle; documents and postings of a block. They bound what a task holds.
BUNDLE, BLOCK, POSTINGS = 256, 4096, 1 << 20
#: Stages of the pipeline. Each owns the postings of its terms.
OWNERS = 4
SLICE = 1 << 22

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(parts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order, and the first term's number for each text (one more than texts)."""
    lengths = np.array([len(p) + 1 for p in parts], np.int64)
    raw = _LOWER[np.frombuffer(b" ".join([*parts, b""]), np.uint8)]
    solid = ~_BETWEEN[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8)))))
    start, end = edge[::2], edge[1::2]
    at = np.concatenate(([0], np.cumsum(end - start)))
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(raw[solid])])
    return found, np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))


def _item_terms(batches):
    """(q, term, n): every term of an item and how often it occurs there."""
    for batch in batches:
        for q, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part, _ in portions(text.as_py(), _BETWEEN, SLICE):
                counts = pc.value_counts(terms([part])[0])
                words, n = counts.field("values").cast(pa.binary()), counts.field("counts")
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(words), pa.int64()), words, n], ["q", "term", "n"])


def _index(vocabulary: list[bytes]):
    """Postings of the vocabulary, in blocks of documents; the row without a term has the block's documents and their lengths."""

    def scan(batches):
        part, seq = TaskContext.get().partitionId(), 0
        known = pa.array(vocabulary, pa.large_binary())
        docs, sizes, where, what, often, held = [], [], [], [], [], 0

        def flush():
            nonlocal docs, sizes, where, what, often, held, seq
            block, n = part << 32 | seq, np.array(sizes, np.int64)
            at, term, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (where, what, often))
            key, back = np.unique(term * len(docs) + at, return_inverse=True)
            tf = np.bincount(back, tf, len(key)).astype(np.int64)
            term, at = np.divmod(key, len(docs))
            first = np.flatnonzero(np.diff(term, prepend=-1))
            stop = np.append(first[1:], len(term))
            rows = [
                (block, int(term[a]), at[a:b].astype("<u2").tobytes(), tf[a:b].astype("<i8").tobytes(), int(tf[a:b].max()), int(n[at[a:b]].min()), None, None)
                for a, b in zip(first.tolist(), stop.tolist())
            ]
            rows.append((block, None, None, None, None, None, docs, sizes))
            docs, sizes, where, what, often, held, seq = [], [], [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        def run(waiting):
            nonlocal held
            words, cut = terms([p for _, p, _ in waiting])
            index = pc.index_in(words, value_set=known)
            owner = np.repeat(np.arange(len(waiting)), np.diff(cut))
            hit = pc.is_valid(index).to_numpy(zero_copy_only=False)
            key, tf = np.unique(owner[hit] * len(known) + pc.fill_null(index, 0).to_numpy()[hit], return_counts=True)
            owner, term = np.divmod(key, max(1, len(known)))
            edge = np.searchsorted(owner, np.arange(len(waiting) + 1))
            for k, (doc, _, begins) in enumerate(waiting):
                n = int(cut[k + 1] - cut[k])
                if begins:
                    if docs and not sizes[-1]:  # a document without a term is no document
                        docs.pop(), sizes.pop()
                    if len(docs) == BLOCK or held >= POSTINGS:
                        yield flush()
                    docs.append(doc)
                    sizes.append(0)
                sizes[-1] += n
                mine = slice(edge[k], edge[k + 1])
                where.append(np.full(edge[k + 1] - edge[k], len(docs) - 1))
                what.append(term[mine])
                often.append(tf[mine])
                held += int(edge[k + 1] - edge[k])

        waiting, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                begins = True
                for piece, _ in portions(text.as_py(), _BETWEEN, SLICE):
                    waiting.append((doc.as_py(), piece, begins))
                    begins, size = False, size + len(piece) + 1
                    if size >= SLICE:
                        yield from run(waiting)
                        waiting, size = [], 0
        yield from run(waiting)
        if docs and not sizes[-1]:
            docs.pop(), sizes.pop()
        if docs:
            yield flush()

    names = ["block", "term", "at", "tf", "top_tf", "low_n", "docs", "sizes"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return scan


INDEX = "block long, term int, at binary, tf binary, top_tf long, low_n long, docs array<long>, sizes array<long>"
STATE = "bundle int, block long, docs array<long>, sizes array<long>, q binary, d binary, score binary"


def _stage(owner: int, top: int, total_docs: int, total_terms: int):
    """One owner's stage: its terms add to the accumulators of a bundle in a block of documents.

    The rows of later owners come without postings, with a bound on what their terms can add. An accumulator that stays below the
    ``top``-th best of its item even so is given up; so is one of a document that first appears here. The best are never given up,
    and what a document given up may gain later remains below them.
    """

    def add(key, bundles, postings):
        if not bundles.num_rows:
            return bundles
        state = {c: bundles.column(c)[0].as_py() for c in bundles.column_names}
        n = np.array(state["sizes"], np.int64)
        m = 25 + (75 * n * total_docs) // total_terms
        scores = np.zeros((BUNDLE, len(n)), np.int64)
        scores[np.frombuffer(state["q"], "<u2"), np.frombuffer(state["d"], "<u2")] = np.frombuffer(state["score"], "<i8")
        rest = np.zeros(BUNDLE, np.int64)
        names = ["owner", "w", "bound", "at", "tf", "q", "n"]
        for own, w, bound, at, tf, q, times in zip(*(postings.column(c).to_pylist() for c in names)):
            if own > owner:
                rest[q] += np.array(times, np.int64) * bound
                continue
            at, tf = np.frombuffer(at, "<u2"), np.frombuffer(tf, "<i8")
            gain = w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
            for item, t in zip(q, times):
                scores[item, at] += t * gain
        if len(n) > top:
            least = np.partition(scores, len(n) - top, axis=1)[:, len(n) - top]
            scores[scores + rest[:, None] < least[:, None]] = 0
        q, d = np.nonzero(scores)
        state |= {"q": q.astype("<u2").tobytes(), "d": d.astype("<u2").tobytes(), "score": scores[q, d].astype("<i8").tobytes()}
        return pa.Table.from_pylist([state], bundles.schema)

    return add


def _best(top: int):
    """(q, doc_id, score): an item's best documents of a block, ties by doc_id."""

    def pick(batches):
        for batch in batches:
            for state in batch.to_pylist():
                docs = np.array([2**63 - 1 if d is None else d for d in state["docs"]], np.int64)
                null = np.array([d is None for d in state["docs"]], bool)
                q, d = np.frombuffer(state["q"], "<u2"), np.frombuffer(state["d"], "<u2").astype(np.int64)
                score = np.frombuffer(state["score"], "<i8")
                order = np.lexsort((null[d], docs[d], -score, q))
                q, d, score = q[order], d[order], score[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, d, score = (x[place < top] for x in (q, d, score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(state["bundle"] * BUNDLE + q.astype(np.int64)), pa.array(docs[d], pa.int64(), mask=null[d]), pa.array(score)], ["number", "doc_id", "score"]
                )

    return pick


def _search(documents: DataFrame, wanted: list, top: int) -> DataFrame:
    """``wanted`` has (number, term, n) of the items of one round, numbers from 0 on."""
    spark = documents.sparkSession
    vocabulary = sorted({bytes(w.term) for w in wanted})
    index = stored(documents.mapInArrow(released(_index(vocabulary)), INDEX), "postings")
    total = index.where("term IS NULL").select(F.sum(F.size("sizes")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    if not total.n:
        return spark.createDataFrame([], "number long, doc_id long, score long")
    df = {r.term: r.df for r in index.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.length("at") / 2).cast("long").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * total.n + 2) / (2 * f + 1))) for t, f in df.items()}
    load, owner, before = sum(df.values()), {}, 0
    for t in sorted(df, key=lambda t: (-weight[t], t)):  # rare terms first, equal shares of the postings
        owner[t], before = before * OWNERS // load, before + df[t]
    place = {w: k for k, w in enumerate(vocabulary)}
    uses: dict[tuple[int, int], list] = {}
    for w in wanted:
        uses.setdefault((place[bytes(w.term)], w.number // BUNDLE), []).append((w.number % BUNDLE, w.n))
    rows = [(t, b, owner[t], weight[t], [q for q, _ in x], [n for _, n in x]) for (t, b), x in uses.items() if weight.get(t)]
    owned = F.broadcast(spark.createDataFrame(rows, "term int, bundle int, owner int, w long, q array<int>, n array<long>"))
    low_m = F.expr(f"25 + (75 * low_n * {total.n}) div {total.l}")
    bound = F.expr("w * ((1000000000 * top_tf) div (1000 * top_tf + 8 * low_m))")
    postings = index.where("term IS NOT NULL").select(F.col("block").alias("b"), "term", "at", "tf", "top_tf", low_m.alias("low_m")).join(owned, "term").withColumn("bound", bound)
    empty = F.lit(b"")
    bundles = F.explode(F.sequence(F.lit(0), F.lit(max((w.number // BUNDLE for w in wanted), default=0))))
    state = index.where("term IS NULL").select(bundles.alias("bundle"), "block", "docs", "sizes", *[empty.alias(c) for c in ("q", "d", "score")])
    keys = ["bundle", "block"]
    for k in range(OWNERS):
        own = F.col("owner") == k
        sent = postings.where(F.col("owner") >= k).select(
            "bundle", F.col("b").alias("part"), "owner", "w", "bound", F.when(own, F.col("at")).alias("at"), F.when(own, F.col("tf")).alias("tf"), "q", "n"
        )
        state = state.groupBy(*keys).cogroup(sent.groupBy("bundle", "part")).applyInArrow(_stage(k, top, total.n, total.l), STATE)
    return state.mapInArrow(released(_best(top)), "number long, doc_id long, score long")


def ranked_search(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best ``documents`` (doc_id, text) for every row of ``items`` (item_id, text).

    Terms are runs of ASCII letters, digits and non-ASCII characters, compared without case of A-Z. A term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))); a document gains weight * (10^9 tf div (1000 tf + 8 m)) for every occurrence of it
    in the item, with m = 25 + 75 n N div L. Only scores above 0 are given; ties go by doc_id (null last).

    One scan writes the postings of the items' vocabulary in blocks of documents. The terms are shared out to a few owners, the
    rarest first. Bundles of items, with a sparse accumulator per item and document of a block, go from owner to owner by cogroup;
    each adds what its postings give. The last owner's accumulators give an item's best of each block, a window its best of all.
    Scores are whole numbers, so the order of additions does not matter. An accumulator is given up early only where a bound proves
    that it cannot reach the best. A frequent term's postings are spread over all blocks, a long document is read in parts.

    Items are searched in rounds of about TERMS term occurrences (an item is never cut), each with an own scan; the vocabulary of a
    round is broadcast. Null and empty texts have no term: such an item gets no row, such a document no rank and no count. Repeated
    rows, of documents and items, count one by one. Empty tables give no row; further columns are ignored.
    """
    spark = items.sparkSession
    rows = stored(items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("q", F.monotonically_increasing_id()), "items")
    found = rows.select("q", "text").mapInArrow(released(_item_terms), "q long, term binary, n long")
    found = stored(found.groupBy("q", "term").agg(F.sum("n").alias("n")), "item-terms")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rounds = 1 + found.count() // TERMS
    results = spark.createDataFrame([], "q long, doc_id long, score long")
    for k in range(rounds):
        wanted = found.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == k)
        numbers = wanted.select("q").distinct().withColumn("number", F.row_number().over(Window.orderBy("q")).cast("long") - 1)
        numbers = stored(numbers, "item-numbers")
        wanted = wanted.join(F.broadcast(numbers), "q").select("number", "term", "n").collect()
        if wanted:
            best = _search(texts, wanted, top).join(F.broadcast(numbers), "number").select("q", "doc_id", "score")
            results = results.union(best if rounds == 1 else stored(best, "best"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(rows.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


@query("op13_ranked_search", r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term, docs),
items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10""")
def op13_ranked_search(spark, sf_dir):
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
