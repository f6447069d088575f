"""Operator 5: exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read
from .registry import query

#: Codes of the index, and of the queries, that meet in one task. They bound memory; every pair of blocks meets.
INDEX_BLOCK, QUERY_BLOCK = 65_536, 4_096


def usable(vector: Column) -> Column:
    """The vector has components, and all of them are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def sign_codes(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code, bits): one bit per component, set where it is not negative. Null, empty and non-finite vectors give no code."""

    def run(batches):
        for batch in batches:
            codes = [np.packbits(np.asarray(v) >= 0).tobytes() for v in batch.column(1).to_pylist()]
            bits = [len(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(codes, pa.binary()), pa.array(bits, pa.int32())], ["id", "code", "bits"])

    rows = vectors.where(usable(F.col(vector)) & F.col(id_column).isNotNull())
    return rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, code binary, bits int")


class Segments:
    """Multi-index tables of one block of codes: for each segment of bits the codes by the segment's value."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        wanted = max(1, round(bits / max(4, min(16, np.log2(max(len(codes), 2))))))
        self.cuts = [(int(x[0]), int(x[-1]) + 1) for x in np.array_split(np.arange(bits), wanted) if len(x)]
        if max(b - a for a, b in self.cuts) > 20:
            self.cuts = [(a, min(a + 16, bits)) for a in range(0, bits, 16)]
        self.flags = np.unpackbits(codes, axis=1)[:, :bits]
        self.tables = []
        for a, b in self.cuts:
            value = self._value(self.flags, a, b)
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << (b - a)) + 1)), order))
        self.masks: dict[tuple[int, int], np.ndarray] = {}
        pad = -codes.shape[1] % 8
        self.wide = np.pad(codes, ((0, 0), (0, pad))).view(np.uint64)

    @staticmethod
    def _value(flags: np.ndarray, a: int, b: int) -> np.ndarray:
        return flags[:, a:b].astype(np.int64) @ (1 << np.arange(b - a - 1, -1, -1))

    def _mask(self, width: int, radius: int) -> np.ndarray:
        if (width, radius) not in self.masks:
            self.masks[width, radius] = np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)
        return self.masks[width, radius]

    def nearest(self, code: np.ndarray, k: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (row numbers) and distances that hold the k nearest ids for sure; ``weight`` is the number of ids per code.

        Radius r is searched in one segment after another. Once segments up to t are through at radius r, a code not yet seen
        differs in at least r + 1 bits in each of these and r in each other one, so all codes within m * r + t are seen. The
        search ends when the k-th verified distance is not above that, or all codes are seen.
        """
        m = len(self.cuts)
        flags = np.unpackbits(code)[: self.bits][None]
        own = [int(self._value(flags, a, b)[0]) for a, b in self.cuts]
        wide = np.pad(code, (0, -len(code) % 8)).view(np.uint64)
        seen = np.zeros(len(self.codes), bool)
        rows, distances = [], []
        have = np.zeros(self.bits + 1, np.int64)
        for r in range(max(b - a for a, b in self.cuts) + 1):
            for t, (a, b) in enumerate(self.cuts):
                if r <= b - a:
                    offsets, order = self.tables[t]
                    probe = own[t] ^ self._mask(b - a, r)
                    first, size = offsets[probe], offsets[probe + 1] - offsets[probe]
                    some = size > 0
                    first, size = first[some], size[some]
                    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    new = order[at]
                    new = new[~seen[new]]
                    if len(new):
                        seen[new] = True
                        d = np.bitwise_count(self.wide[new] ^ wide).sum(axis=1).astype(np.int64)
                        rows.append(new)
                        distances.append(d)
                        have += np.bincount(d, weight[new], self.bits + 1).astype(np.int64)
                total = np.cumsum(have)
                if total[-1] >= k and int(np.searchsorted(total, k)) <= m * r + t:
                    return np.concatenate(rows), np.concatenate(distances)
        return (np.concatenate(rows), np.concatenate(distances)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def top_k(codes: DataFrame, queries: DataFrame, k: int, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, distance): the k other ids nearest by Hamming distance, equal distances by id; exact.

    ``codes`` and ``queries`` are (id, code, bits). Codes are compared only with codes of as many bits. Fewer than k others give
    fewer rows; an id repeated with one code counts once. Ids with one code are searched once: of each code the k + 1 smallest ids
    are kept, found before the shuffle, so a hot code is no hot group. Each block of codes builds its segment tables and answers
    each block of query codes; at most k + 1 rows per query code and block leave a task.
    """
    near = Window.partitionBy("code", "bits").orderBy("id")
    kept = codes.distinct().withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    index = kept.groupBy("code", "bits").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = queries.select("code", "bits").distinct()
    blocks = max(1, -(-index.count() // index_block))
    query_blocks = max(1, -(-asked.count() // query_block))
    left = index.withColumn("i", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("q", F.pmod(F.xxhash64("code"), F.lit(query_blocks)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("code", pa.binary()), ("bits", pa.int32()), ("distance", pa.int64()), ("id", pa.int64())])

    def search(index: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if not index.num_rows or not asked.num_rows:
            return schema.empty_table()
        bits = index.column("bits")[0].as_py()
        codes = np.frombuffer(b"".join(index.column("code").to_pylist()), np.uint8).reshape(index.num_rows, -1)
        ids = index.column("ids").to_pylist()
        weight = np.array([len(x) for x in ids])
        tables = Segments(codes, bits)
        for code in asked.column("code").to_pylist():
            rows, distance = tables.nearest(np.frombuffer(code, np.uint8), k + 1, weight)
            order = np.argsort(distance, kind="stable")
            limit = distance[order][np.searchsorted(np.cumsum(weight[rows[order]]), k + 1)] if weight[rows].sum() > k else bits
            close = [(int(d), i) for r, d in zip(rows.tolist(), distance.tolist()) if d <= limit for i in ids[r]]
            for d, i in sorted(close)[: k + 1]:
                for column, value in zip(out, (code, bits, d, i)):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    found = left.groupBy("bits", "i", "q").cogroup(right.groupBy("bits", "i", "q")).applyInArrow(search, "code binary, bits int, distance long, id long")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("code", "bits").orderBy("distance", "id"))).where(F.col("n") <= k + 1)
    asking = queries.select(F.col("id").alias("query_id"), "code", "bits").distinct()
    pairs = asking.join(best.drop("n"), ["code", "bits"]).where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("long")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


K = 10


@query("op5_hamming_topk", f"""
WITH v AS (SELECT DISTINCT vec_id, [x >= 0 FOR x IN embedding] AS code FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id,
  CAST(list_sum([CASE WHEN q.code[i] <> v.code[i] THEN 1 ELSE 0 END FOR i IN range(1, len(v.code) + 1)]) AS BIGINT) AS distance
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.code) = len(v.code)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= {K}
""")
def op5_hamming_topk(spark, sf_dir):
    codes = sign_codes(read(spark, sf_dir, "embeddings"))
    return top_k(codes, codes.where("id % 20 = 0"), K).withColumnRenamed("id", "vec_id")
