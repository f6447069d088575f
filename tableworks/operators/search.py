"""Exact and approximate nearest-neighbour search over vector tables of any size.

Similarities are computed as matrix products inside tasks. A task gives at most k candidates
per query, never all pairs, and a window over the candidates picks the final ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .guards import require_columns

BROADCAST_QUERIES = 4096
BROADCAST_BYTES = 128 << 20
BLOCK_ROWS = 16_384
#: Scores that a task holds at a time; rounding makes copies of them.
SCORE_BYTES = 8 << 20
DECIMALS = 9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one Arrow list column as rows; all must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("null vector")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    dim, odd = divmod(len(flat), len(column))
    if odd or not np.array_equal(np.diff(column.offsets.to_numpy()), np.full(len(column), dim)):
        raise ValueError("vectors of different length")
    return flat.reshape(len(column), dim)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer. Rounding makes the order independent of how rows were batched."""
    if metric == "cosine":
        s = _unit(q) @ _unit(v).T
    elif metric == "l2":
        squares = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2.0 * (q @ v.T)
        return -np.sqrt(np.round(np.maximum(squares, 0.0), DECIMALS)) + 0.0
    else:
        s = q @ v.T
    return np.round(s, DECIMALS) + 0.0


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one row of scores, ties by id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


class _Running:
    """The best k so far for every query of one task."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str):
        self.query_ids, self.queries, self.k, self.metric = query_ids, queries, k, metric
        self.ids: list[np.ndarray | None] = [None] * len(query_ids)
        self.scores: list[np.ndarray | None] = [None] * len(query_ids)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids) or not len(self.query_ids):
            return
        if vectors.shape[1] != self.queries.shape[1]:
            raise ValueError(f"query dimension {self.queries.shape[1]}, vector dimension {vectors.shape[1]}")
        step = max(1, SCORE_BYTES // (8 * len(ids)))
        for start in range(0, len(self.query_ids), step):
            block = _scores(self.queries[start:start + step], vectors, self.metric)
            for i, row in enumerate(block, start):
                top = _best(ids, row, self.k)
                got_ids, got = ids[top], row[top]
                if self.ids[i] is not None:
                    got_ids, got = np.concatenate([self.ids[i], got_ids]), np.concatenate([self.scores[i], got])
                    top = _best(got_ids, got, self.k)
                    got_ids, got = got_ids[top], got[top]
                self.ids[i], self.scores[i] = got_ids, got

    def batches(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.query_ids), 2048):
            q, i, s = [], [], []
            for pos in range(start, min(start + 2048, len(self.query_ids))):
                if self.ids[pos] is not None:
                    q.append(np.full(len(self.ids[pos]), self.query_ids[pos]))
                    i.append(self.ids[pos])
                    s.append(self.scores[pos])
            if q:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(q), pa.int64()), pa.array(np.concatenate(i), pa.int64()), pa.array(np.concatenate(s), pa.float64())],
                    names=["query_id", "id", "score"],
                )


_CANDIDATES = "query_id BIGINT, id BIGINT, score DOUBLE"


def _ranked(candidates: DataFrame, k: int, metric: str) -> DataFrame:
    """Final k per query. The window prunes to k inside each task before its shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    out = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    score = -F.col("score") if metric == "l2" else F.col("score")
    return out.select("query_id", "id", F.col("rank").cast("long").alias("rank"), (score + F.lit(0.0)).alias("score"))


def _pick(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    require_columns(df, id_col, vec_col)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))


def _small_queries(queries: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Queries as a matrix when their number and size are within the broadcast bound."""
    head = queries.limit(BROADCAST_QUERIES + 1)
    n, dim = head.agg(F.count("*"), F.max(F.size("vec"))).first()
    if n > BROADCAST_QUERIES or n * (dim or 0) * 8 > BROADCAST_BYTES:
        return None
    table = queries.toArrow()
    return table.column("id").to_numpy(), _matrix(table.column("vec"))


def knn_topk(
    queries: DataFrame, vectors: DataFrame, *, k: int = 6, metric: str = "ip", query_id: str = "query_id",
    query_vec: str = "embedding", id: str = "id", vec: str = "embedding", exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS, broadcast: bool | None = None, where: Column | str | None = None,
) -> DataFrame:
    """Exact ``k`` nearest vectors per query: (query_id, id, rank, score).

    ``metric`` is ``ip``, ``cosine`` or ``l2`` (score is then the distance). Ids are unique
    integers. Scores are compared at nine decimals (squared distances for ``l2``), ties go to the
    lower id. ``where`` is a condition on the columns of ``vectors``; only rows that meet it are searched.

    A query table within the broadcast bound is sent to the tasks that scan the vectors, which
    are not shuffled. Beyond the bound both sides are cut into blocks of about ``block_rows``
    rows by id hash, and each pair of blocks is one bounded group.
    """
    if metric not in ("ip", "cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    q = _pick(queries, query_id, query_vec)
    v = _pick(vectors if where is None else vectors.where(where), id, vec)
    keep = k + 1 if exclude_self else k
    small = _small_queries(q) if broadcast is not False else None
    if small is not None:
        candidates = _scan_with_broadcast(small, v, keep, metric)
    else:
        candidates = _block_pairs(q, v, keep, metric, block_rows)
    if exclude_self:
        candidates = candidates.where(F.col("query_id") != F.col("id"))
    return _ranked(candidates, k, metric)


def _scan_with_broadcast(small, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        best = _Running(ids, matrix, k, metric)
        for batch in batches:
            best.add(batch.column(0).to_numpy(), _matrix(batch.column(1)))
        yield from best.batches()

    return vectors.mapInArrow(run, _CANDIDATES)


def _fitting_rows(vectors: DataFrame, block_rows: int) -> int:
    """Rows of a block, fewer where the vectors are long."""
    first = vectors.select(F.size("vec")).first()
    return max(1, min(block_rows, BROADCAST_BYTES // (8 * max(1, first[0] if first else 1))))


def _block_pairs(queries: DataFrame, vectors: DataFrame, k: int, metric: str, block_rows: int) -> DataFrame:
    block_rows = _fitting_rows(vectors, block_rows)
    q_blocks = max(1, -(-queries.count() // block_rows))
    v_blocks = max(1, -(-vectors.count() // block_rows))

    def blocked(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        )

    left = blocked(queries, "qb", q_blocks, "vb", v_blocks)
    right = blocked(vectors, "vb", v_blocks, "qb", q_blocks)

    return _cogrouped(left, right, ["qb", "vb"], k, metric)


def _cogrouped(left: DataFrame, right: DataFrame, keys: list[str], k: int, metric: str) -> DataFrame:
    """Best k per query inside each pair of bounded blocks with equal ``keys``."""
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(_, q: pa.Table, v: pa.Table) -> pa.Table:
        best = _Running(q.column("id").to_numpy(), _matrix(q.column("vec")), k, metric)
        best.add(v.column("id").to_numpy(), _matrix(v.column("vec")))
        found = pa.Table.from_batches(best.batches(), schema=schema)
        del best, q, v
        pa.default_memory_pool().release_unused()  # workers live on: what a pair of blocks has freed would add up
        return found

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _CANDIDATES)


#: Vectors that a bucket of the approximate search is meant to hold; lowest bits of a code that do not part buckets, so that a query
#: goes once to all the buckets that differ in one of them; blocks of queries are so many times as long as those of vectors.
BUCKET_ROWS, SHARED_BITS, QUERY_BLOCKS = 256, 4, 4
#: Groups of buckets whose sizes may be broadcast.
BROADCAST_GROUPS = 1 << 20


def knn_lsh(
    queries: DataFrame, vectors: DataFrame, *, k: int = 6, metric: str = "ip", query_id: str = "query_id",
    query_vec: str = "embedding", id: str = "id", vec: str = "embedding", dim: int, tables: int = 8, bits: int | None = None,
    seed: int = 42, block_rows: int = BLOCK_ROWS, where: Column | str | None = None,
) -> DataFrame:
    """Approximate search: vectors whose random-hyperplane code equals a query's, or differs in one bit, in one of ``tables``
    tables are scored exactly. Every query gets k answers if there are k vectors: those with fewer candidates are searched exactly.

    ``bits`` follows from the number of vectors unless given, so that a bucket holds about ``BUCKET_ROWS`` of them at any size.
    Inner product and distance are turned into angles first: vectors get one component that makes all norms equal, and for the
    distance one that carries half the squared norm. A bucket of any size is cut into blocks of about ``block_rows`` vectors and
    queries; each block of its queries visits each block of its vectors, so a hot bucket is spread and no pair is left out. Buckets
    whose codes differ in the lowest SHARED_BITS bits meet in one group, to which a query is sent once. Vectors are shuffled once.
    """
    block_rows = max(1, min(block_rows, BROADCAST_BYTES // (8 * dim)))
    q, v = _pick(queries, query_id, query_vec), _pick(vectors if where is None else vectors.where(where), id, vec)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, largest = v.agg(F.count("*"), F.max(square)).first()
    if bits is None:
        bits = max(0, int(np.floor(np.log2(max(n, 1) / BUCKET_ROWS))))
    tables, shared = tables if bits else 1, min(SHARED_BITS, bits)
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim + 2))
    top = largest or 0.0

    def aligned(m: np.ndarray, query: bool) -> np.ndarray:
        """Rows whose angles order vectors as the metric does."""
        own = (m * m).sum(1)
        half = np.zeros(len(m)) if metric != "l2" else np.full(len(m), 1.0) if query else -0.5 * own
        bound = top + (0.25 * top * top if metric == "l2" else 0.0)
        rest = np.zeros(len(m)) if query or metric == "cosine" else np.sqrt(np.maximum(bound - own - half * half, 0.0))
        return np.column_stack((m, half, rest))

    def coded(df: DataFrame, query: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = 1 << np.arange(bits, dtype=np.int64)
            for batch in batches:
                m = _matrix(batch.column(1))
                for t in range(tables if len(m) else 0):
                    codes = ((aligned(m, query) @ planes[t].T > 0) @ weights).astype(np.int64)
                    for flip in [0, *weights[shared:].tolist()] if query else [0]:
                        code = (codes ^ flip) + (t << bits)
                        near = np.full(len(m), query and flip == 0)
                        columns = [batch.column(0), batch.column(1), pa.array(code), pa.array(near), pa.array(code >> shared)]
                        yield pa.RecordBatch.from_arrays(columns, names=["id", "vec", "code", "near", "part"])

        kind = df.schema["vec"].dataType.simpleString()
        return df.mapInArrow(run, f"id BIGINT, vec {kind}, code BIGINT, near BOOLEAN, part BIGINT")

    vc, qc = coded(v, False), coded(q, True)

    def parts(df: DataFrame, name: str, rows: int) -> DataFrame:
        return df.groupBy("part").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    sizes = parts(vc, "vectors", block_rows).join(parts(qc, "queries", QUERY_BLOCKS * block_rows), "part")
    if tables << (bits - shared) <= BROADCAST_GROUPS:
        sizes = F.broadcast(sizes)

    def blocked(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.join(sizes, "part").withColumn(own[0], F.pmod(F.xxhash64("id"), F.col(own).cast("long")).cast("int"))
        return rows.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("vectors", "queries")

    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(_, q: pa.Table, v: pa.Table) -> pa.Table:
        q_ids, q_codes, near, asked = q.column("id").to_numpy(), q.column("code").to_numpy(), q.column("near").to_numpy(), _matrix(q.column("vec"))
        ids, codes, held = v.column("id").to_numpy(), v.column("code").to_numpy(), _matrix(v.column("vec"))
        batches: list[pa.RecordBatch] = []
        for code in np.unique(codes):
            apart = q_codes ^ code
            own = np.flatnonzero((apart == 0) | (near & ((apart & (apart - 1)) == 0)))
            mine = np.flatnonzero(codes == code)
            best = _Running(q_ids[own], asked[own], k, metric)
            best.add(ids[mine], held[mine])
            batches += best.batches()
        found = pa.Table.from_batches(batches, schema=schema)
        asking, score, answer = (found.column(c).to_numpy() for c in ("query_id", "score", "id"))
        order = np.lexsort((answer, -score, asking))
        again = np.zeros(len(order), bool)  # rows that come twice take one place
        again[1:] = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in (asking, score, answer)])
        order = order[~again]
        first = np.searchsorted(asking[order], asking[order])
        found = found.take(pa.array(order[np.arange(len(order)) - first < k]))
        del q, v, asked, held
        pa.default_memory_pool().release_unused()
        return found

    left, right = (x.groupBy("part", "v", "q") for x in (blocked(qc, "queries", "vectors"), blocked(vc, "vectors", "queries")))
    # the k best of each query are kept in a table, as who lacks answers, and the exact search for them, ask for them again
    merged = left.cogroup(right).applyInArrow(run, _CANDIDATES).repartition("query_id").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
    path = scratch_path(v.sparkSession, "lsh")
    merged.withColumn("place", place).where(F.col("place") <= k).drop("place").write.parquet(path)
    found = v.sparkSession.read.schema(_CANDIDATES).parquet(path)
    enough = found.groupBy("query_id").agg(F.count("*").alias("have")).where(F.col("have") >= min(k, n)).select(F.col("query_id").alias("id"))
    lacking = q.join(enough, "id", "left_anti")
    exact = _block_pairs(lacking, v, k, metric, block_rows)
    return _ranked(found.join(lacking.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(exact), k, metric)
