"""Operator 9: near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

from itertools import combinations
from math import acos, comb, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, stored
from .graph import components
from .hamming import usable
from .registry import query

COSINE = 0.98
#: The rotation is learned from at most so many distinct vectors, the first by a hash.
FIT_VECTORS, FIT_ROUNDS = 20_000, 30
#: A pair at the threshold has to meet in some table with this probability; pairs above it meet more often.
RECALL = 0.995
#: Chance that the Hamming filter before the comparison of vectors drops a pair at the threshold.
FILTER_LOSS = 1e-5
#: Rows of one bucket in a task, stored and probing; larger buckets are dealt to several tasks. Pairs looked at together.
BUCKET, PAIRS = 256, 200_000


def learn_rotation(sample: np.ndarray, seed: int = 9) -> np.ndarray:
    """Orthogonal matrix under which unit vectors lie close to their sign codes (alternating codes and Procrustes)."""
    d = sample.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(FIT_ROUNDS if len(sample) > d else 0):
        u, _, vt = np.linalg.svd(sample.T @ np.where(sample @ rotation >= 0, 1.0, -1.0))
        rotation = u @ vt
    return rotation


def tail(n: int, p: float, r: int) -> float:
    """Chance of more than r of n bits differing."""
    return 1.0 - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(r, n) + 1))


def layout(bits: int, vectors: int, cosine: float) -> tuple[list[tuple[int, int]], int, int]:
    """Segments of about log2(vectors) bits, the radius searched in each, and the largest Hamming distance compared.

    A bit of two vectors at the threshold differs with probability angle / pi. The radius is the smallest with which such a pair
    meets in some segment with probability RECALL.
    """
    p = acos(cosine) / pi
    m = max(1, min(bits, round(bits / max(8.0, min(20.0, log2(max(vectors, 2)))))))
    cuts = [(int(x[0]), int(x[-1]) + 1) for x in np.array_split(np.arange(bits), m)]
    radius = 0
    while radius < bits and np.prod([tail(b - a, p, radius) for a, b in cuts]) > 1 - RECALL:
        radius += 1
    furthest = next(r for r in range(bits + 1) if tail(bits, p, r) <= FILTER_LOSS)
    return cuts, radius, furthest


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Vectors with one label and a cosine of at least ``cosine`` in double precision are linked. Null, empty, zero and non-finite
    vectors, and rows with a null label or vec_id, link with nothing; vectors of different lengths neither. ``n_links`` counts other
    rows, so repeated rows count each other; ``component_id`` is the smallest vec_id reachable, the row's own without links.

    Equal vectors of a label are one class, so copies are never paired; their links follow from class sizes. Codes are signs after
    a learned rotation. Each class is stored under each segment of its code and looked up under all values within the radius. The
    first segment in which a pair can meet owns it, so no pair is counted twice and none need be emitted: a task gives sums per
    class and a spanning forest of its links. A first pass over codes alone finds the buckets that hold a close pair; only their
    rows get vectors. Large buckets are dealt in blocks. Every link reported is verified; about 1 - RECALL of the links exactly at
    the threshold may be missed, fewer above it.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    ok = usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = [F.when(ok, F.col("label")).alias("label"), F.when(ok, F.xxhash64("v")).alias("h"), F.when(ok, F.xxhash64(F.lit(9), "v")).alias("g")]
    marked = stored(rows.select("vec_id", "v", *key), "vectors")
    good = marked.where("h IS NOT NULL")
    classes = stored(good.groupBy("label", "h", "g").agg(F.min("vec_id").alias("class"), F.count("*").alias("n"), F.any_value("v").alias("v")), "vector-classes")
    shapes = {r["d"]: r["m"] for r in classes.groupBy(F.size("v").alias("d"), "label").count().groupBy("d").agg(F.max("count").alias("m")).collect()}
    sample = [np.array(r["v"]) for r in classes.orderBy(F.xxhash64("class"), "class").limit(FIT_VECTORS).select("v").collect()]
    plans = {}
    for d, largest in shapes.items():
        own = np.array([v / np.linalg.norm(v) for v in sample if len(v) == d]).reshape(-1, d)
        plans[d] = (learn_rotation(own), *layout(d, largest, cosine))
    shared = spark.sparkContext.broadcast(plans)

    def encode(batches):
        plans = shared.value
        for batch in batches:
            out = ([], [], [])
            for v in batch.column(1).to_pylist():
                x = np.array(v)
                rotation, cuts, _, _ = plans[len(v)]
                flags = (x / np.linalg.norm(x)) @ rotation >= 0
                packed = np.packbits(flags)
                out[0].append(np.pad(packed, (0, -len(packed) % 8)).tobytes())
                out[1].append([int(flags[a:b] @ (1 << np.arange(b - a))) for a, b in cuts])
                out[2].append(len(v))
            arrays = [pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *arrays], ["class", "label", "n", "code", "parts", "d"])

    kind = classes.schema["label"].dataType.simpleString()
    codes = stored(
        classes.select("class", "v", "label", "n").mapInArrow(encode, f"class long, label {kind}, n long, code binary, parts array<long>, d int"), "vector-codes"
    )
    # Bit patterns to flip in a segment, by dimension and segment: a table fixed by the layout.
    flips = [
        (d, t, sum(1 << i for i in c))
        for d, (_, cuts, radius, _) in plans.items() for t, (a, b) in enumerate(cuts)
        for r in range(radius + 1) for c in combinations(range(b - a), r)
    ]
    flip = spark.createDataFrame(flips or [(0, 0, 0)], "d int, t int, x long")
    own = codes.select("class", "label", "d", F.posexplode("parts").alias("t", "value"))
    spot = ["label", "d", "t", "value"]
    filled = own.groupBy(*spot).agg(F.count("*").alias("stored"))
    probes = own.join(F.broadcast(flip), ["d", "t"]).select("class", "label", "d", "t", F.col("value").bitwiseXOR(F.col("x")).alias("value"))
    # A bucket with one stored class has something to compare only for another class.
    met = probes.join(filled, spot).groupBy(*spot).agg(F.first("stored").alias("stored"), F.count("*").alias("probing")).where("stored > 1 OR probing > 1")
    met = met.select(*spot, F.ceil(F.col("stored") / BUCKET).cast("int").alias("bs"), F.ceil(F.col("probing") / BUCKET).cast("int").alias("bp"))
    spread = F.pmod(F.xxhash64("class"), F.lit(1 << 20))

    def dealt(stored_rows, probing_rows, met):
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        a = stored_rows.join(met, spot).select(*spot, "class", F.lit(0).alias("role"), F.pmod(spread, "bs").cast("int").alias("i"), every("bp").alias("j"))
        b = probing_rows.join(met, spot).select(*spot, "class", F.lit(1).alias("role"), every("bs").alias("i"), F.pmod(spread, "bp").cast("int").alias("j"))
        return a.union(b)

    order = [*spot, "i", "j", "role"]
    entries = dealt(own, probes, met).join(codes.select("class", "code"), "class")
    close = _by_bucket(entries, order, shared, cosine, kind, with_vectors=False)
    close = stored(close, "vector-close")
    full = close.join(codes.select("class", "code", "n"), "class").join(classes.select("class", "v"), "class")
    found = stored(_by_bucket(full, order, shared, cosine, kind, with_vectors=True), "vector-links")
    links = found.where("other IS NULL").groupBy("class").agg(F.sum("n").alias("linked"))
    parts = components(found.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")))
    by_class = (
        classes.select("label", "h", "g", "class", "n").join(links, "class", "left").join(parts.withColumnRenamed("id", "class"), "class", "left")
        .select("label", "h", "g", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component"))
    )
    joined = marked.select("vec_id", "label", "h", "g").join(by_class, ["label", "h", "g"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _by_bucket(entries: DataFrame, order: list[str], shared, cosine: float, kind: str, with_vectors: bool) -> DataFrame:
    """Compare, bucket by bucket, probing rows (role 1) with stored rows (role 0). Without vectors: the entries that have a partner
    within the Hamming limit. With vectors: (class, other null, n) sums of linked rows, and (class, other) spanning links."""
    group = order[:-1]

    def buckets(batches):
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            keys = list(zip(*(table.column(c).to_pylist() for c in group)))
            cut = next((i for i in range(len(keys) - 1, -1, -1) if keys[i] != keys[-1]), -1) + 1
            if cut:
                yield table.slice(0, cut), keys[:cut]
            waiting = table.slice(cut)
        if waiting is not None and waiting.num_rows:
            yield waiting, list(zip(*(waiting.column(c).to_pylist() for c in group)))

    def pairs(table, keys):
        """Row numbers (probing, stored) of pairs that this bucket owns and whose codes are close, some at a time."""
        plans = shared.value
        starts = np.array([i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]])
        run = np.searchsorted(starts, np.arange(len(keys)), side="right") - 1
        role = table.column("role").to_numpy()
        first = starts[run]
        size = np.bincount(run, role == 0, len(starts)).astype(np.int64)[run]
        probing = np.flatnonzero((role == 1) & (size > 0))
        name, d, t = table.column("class").to_numpy(), table.column("d").to_numpy(), table.column("t").to_numpy()
        raw = table.column("code").to_pylist()
        for dim in np.unique(d[probing]).tolist():
            _, cuts, radius, furthest = plans[dim]
            mine = probing[d[probing] == dim]
            code = np.zeros((len(keys), len(raw[mine[0]]) // 8), np.uint64)
            at = np.flatnonzero(d == dim)
            code[at] = np.frombuffer(b"".join([raw[i] for i in at]), np.uint64).reshape(len(at), -1)
            masks = []
            for a, b in cuts:
                flags = np.zeros(code.shape[1] * 64, np.uint8)
                flags[a:b] = 1
                masks.append(np.packbits(flags).view(np.uint64))
            ends = np.cumsum(size[mine])
            lo = 0
            while lo < len(mine):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
                some = mine[lo:hi]
                n = size[some]
                left = np.repeat(some, n)
                right = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                differ = code[left] ^ code[right]
                keep = (name[left] != name[right]) & (np.bitwise_count(differ).sum(axis=1) <= furthest)
                left, right, differ = left[keep], right[keep], differ[keep]
                owned = np.ones(len(left), bool)
                for s in range(len(cuts) - 1):
                    owned &= (t[left] <= s) | (np.bitwise_count(differ & masks[s]).sum(axis=1) > radius)
                if owned.any():
                    yield left[owned], right[owned]
                lo = hi

    def flag(batches):
        for table, keys in buckets(batches):
            use = np.zeros(table.num_rows, bool)
            for left, right in pairs(table, keys):
                use[left] = use[right] = True
            if use.any():
                yield from table.select([*order, "class"]).filter(pa.array(use)).to_batches()

    def link(batches):
        for table, keys in buckets(batches):
            name, n = table.column("class").to_numpy(), table.column("n").to_numpy()
            lists = table.column("v").to_pylist()
            sums, root, forest = np.zeros(len(name)), {}, []

            def find(x, root=root):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            units: dict[int, np.ndarray] = {}
            for dim in {len(v) for v in lists}:
                at = [i for i, v in enumerate(lists) if len(v) == dim]
                x = np.array([lists[i] for i in at])
                whole = np.zeros((len(lists), dim))
                whole[at] = x / np.linalg.norm(x, axis=1, keepdims=True)
                units[dim] = whole
            for left, right in pairs(table, keys):
                unit = units[len(lists[left[0]])]
                linked = np.einsum("ij,ij->i", unit[left], unit[right]) >= cosine
                left, right = left[linked], right[linked]
                sums += np.bincount(left, n[right], len(name))
                for a, b in zip(name[left].tolist(), name[right].tolist()):
                    x, y = find(a), find(b)
                    if x != y:
                        root[x] = y
                        forest.append((a, b))
            at = np.flatnonzero(sums)
            columns = [
                np.concatenate((name[at], np.array([a for a, _ in forest], np.int64))), [None] * len(at) + [b for _, b in forest],
                np.concatenate((sums[at].astype(np.int64), np.zeros(len(forest), np.int64))),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["class", "other", "n"])

    sorted_rows = entries.repartition(*group).sortWithinPartitions(*order)
    if with_vectors:
        return sorted_rows.select(*order, "class", "code", "n", "v").mapInArrow(link, "class long, other long, n long")
    return sorted_rows.select(*order, "class", "code").mapInArrow(flag, f"label {kind}, d int, t int, value long, i int, j int, role int, class long")


@query("op9_embedding_dedup", f"""
WITH RECURSIVE v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
  AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
smallest AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN counts ON a = v.vec_id LEFT JOIN smallest ON id = v.vec_id
""")
def op9_embedding_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "embeddings"))
