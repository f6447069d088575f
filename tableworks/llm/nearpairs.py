"""From buckets of colliding items to verified links, without forming all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, counted, pick, released, shingles, stored
from .graph import components

#: Members compared with one centre in one task.
MEMBERS = 256
#: A family of bucket mates up to this size, in items and words, is compared in one task; larger ones are cut.
FAMILY, FAMILY_WORDS = 3_072, 3_000_000
#: Items of each side, and their words, that are compared in one task where a family is cut.
BLOCK, BLOCK_WORDS = 1_024, 1_500_000


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weighted: bool) -> float:
    """Probability Jaccard of two weighted shingle sets (sorted hashes, weights), or Jaccard of the bare sets.

    The probability Jaccard sums, over common shingles d, 1 / sum over all e of max(w1(e) / w1(d), w2(e) / w2(d)). In the order of
    w2 / w1, the first ratio is the larger one up to d and the second after it, so two running sums give all terms.
    """
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if not weighted:
        return len(i) / (len(a[0]) + len(b[0]) - len(i))
    x, y = a[1][i], b[1][j]
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    upto = a[1].sum() - x.sum() + np.cumsum(x)
    after = b[1].sum() - np.cumsum(y)
    return float((1.0 / (upto / x + after / y)).sum())


def verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], threshold: float, weighted: bool) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts (``texts`` gives id and text for a table of ids) have a similarity of at least ``threshold`` on runs of five words.

    Pairs are dealt by ``a`` in portions of at most MEMBERS, so a centre with many members is spread; each portion gets its
    centre's text once and streams through its members. Only texts that are asked for are shuffled.
    """
    portions = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("portions"))
    members = pairs.join(portions, "a").select("a", F.pmod(F.xxhash64("b"), "portions").cast("int").alias("s"), F.lit(1).alias("role"), F.col("b").alias("id"))
    centres = portions.select("a", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("s"), F.lit(0).alias("role"), F.col("a").alias("id"))
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    rows = members.union(centres).join(pick(texts(ids), ids, "id"), "id")

    def compare(batches):
        centre, own = None, None
        for batch in batches:
            found = []
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sets = _sets(part.column(4).to_pylist())
                for k, (a, s, role, b) in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)))):
                    item = sets[k]
                    if role == 0:
                        centre, own = (a, s), item
                    elif centre == (a, s) and similarity(own, item, weighted) >= threshold:
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in range(2)], ["a", "b"])

    ordered = rows.select("a", "s", "role", "id", "text").repartition("a", "s").sortWithinPartitions("a", "s", "role")
    return ordered.mapInArrow(released(compare), "a long, b long")


def _sets(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    words = Words([(t or "").lower().encode() for t in texts])
    hashes, owner, weights = counted(*shingles(words.hash, words.starts))
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(hashes[a:b], weights[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _bounds(left: list, right: list, weighted: bool) -> np.ndarray:
    """For every pair a value that its similarity does not exceed; it is the similarity itself where all weights are one.

    With C1 and C2 the two weights of the n common shingles, and W1 and W2 those of all, the larger weights of common shingles sum
    to at most C1 + C2 - n, and the probability Jaccard is at most that over W1 + W2 - C1 (or - C2). Three matrix products.
    """
    names, inverse, uses = np.unique(np.concatenate([x[0] for x in [*left, *right]]), return_inverse=True, return_counts=True)
    column = np.cumsum(uses > 1) - 1
    shape = (len(left), len(right))
    n, c1, c2 = np.zeros(shape, np.float32), np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    size = np.array([len(x[0]) for x in [*left, *right]])
    row = np.repeat(np.arange(len(size)), size)
    weight = np.concatenate([x[1] for x in [*left, *right]]) if weighted else np.ones(len(row))
    use = uses[inverse] > 1
    row, at, value = row[use], column[inverse[use]], weight[use]
    order = np.argsort(at, kind="stable")
    row, at, value = row[order], at[order], value[order]
    for lo in range(0, int((uses > 1).sum()), 2_048):
        part = slice(*np.searchsorted(at, (lo, lo + 2_048)))
        has, heavy = np.zeros((len(size), 2_048), np.float32), np.zeros((len(size), 2_048), np.float32)
        has[row[part], at[part] - lo] = 1
        n += has[: len(left)] @ has[len(left) :].T
        if weighted:
            heavy[row[part], at[part] - lo] = value[part]
            c1 += heavy[: len(left)] @ has[len(left) :].T
            c2 += has[: len(left)] @ heavy[len(left) :].T
    if not weighted:
        c1 = c2 = n
    sizes = [np.array([x[1].sum() if weighted else len(x[0]) for x in side], np.float32) for side in (left, right)]
    rest = np.add.outer(*sizes)  # float32 throughout: a family's matrices are what a task holds
    rest -= np.minimum(c1, c2)
    np.maximum(rest, 1e-9, out=rest)
    top = c1 + c2
    top -= n
    top /= rest
    return top


def _forest(left_ids: list[int], left: list, right_ids: list[int], right: list, threshold: float, weighted: bool) -> list[tuple[int, int]]:
    """Links between the two sides (which may overlap) that connect whatever any pair of them connects."""
    ids = np.unique(np.array([*left_ids, *right_ids], np.int64))
    label = np.arange(len(ids))
    of_left, of_right = np.searchsorted(ids, left_ids), np.searchsorted(ids, right_ids)
    value = _bounds(left, right, weighted)
    bound = value >= threshold - 1e-5
    # Where all weights are one the bound is the similarity; it is worked out again only next to the threshold.
    even_left, even_right = (np.array([not weighted or bool((x[1] == 1).all()) for x in side]) for side in (left, right))
    sure = (value >= threshold + 1e-5) & even_left[:, None] & even_right
    del value
    found = []
    for i in range(len(left)):
        for j in np.flatnonzero(bound[i] & (label[of_right] != label[of_left[i]])).tolist():
            a, b = label[of_left[i]], label[of_right[j]]
            if a != b and (sure[i, j] or similarity(left[i], right[j], weighted) >= threshold):
                label[label == b] = a
                found.append((left_ids[i], right_ids[j]))
    return found


def _grouped(rows: DataFrame, group: list[str], run) -> DataFrame:
    """``run`` on each group's (roles, ids, sets), as sorted rows stream by; gives links (a, b)."""

    def stream(batches):
        key, roles, ids, sets = None, [], [], []
        for batch in batches:
            links = []
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                *keys, role, name, text = (part.column(c).to_pylist() for c in range(part.num_columns))
                for k, r, i, x in zip(zip(*keys), role, name, _sets(text)):
                    if k != key:
                        links += run(roles, ids, sets)
                        key, roles, ids, sets = k, [], [], []
                    roles.append(r)
                    ids.append(i)
                    sets.append(x)
            yield table(links)
        yield table(run(roles, ids, sets))

    def table(links):
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in range(2)], ["a", "b"])

    dealt = rows.select(*group, "role", "id", "text").repartition(*group).sortWithinPartitions(*group, "role", "id")
    return dealt.mapInArrow(released(stream), "a long, b long")


def connect(members: DataFrame, words: DataFrame, texts: Callable[[DataFrame], DataFrame], threshold: float, weighted: bool) -> DataFrame:
    """(id, component) of all items that a chain of bucket mates with a similarity of ``threshold`` or more joins to another one.

    ``members`` is (key, id), ``words`` (id, n) the number of words of an item, and ``texts`` gives (id, text) for a table of ids.
    Items that buckets join, directly or by a chain, are a family. A family of bounded size meets in one task, which compares what
    is not connected yet; its texts are fetched once. Of a larger family each bucket is first compared with two centres (its
    smallest id, and one by a hash), dealt in portions; then, in buckets that still hold several components, all members outside the
    largest one are compared with all members, in blocks. So the result is that of comparing all pairs of every bucket, no pair is
    formed as a row but those with a centre, and a group of copies costs about two comparisons per member.
    """
    sizes = members.groupBy("key").agg(F.min("id").alias("c"), F.count("*").alias("n")).where("n > 1")
    shared = stored(members.join(sizes, "key").select("key", "id", "c"), "buckets")
    families = components(shared.where("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b"))).withColumnRenamed("component", "family")
    placed = families.join(words, "id")
    load = placed.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    fits = (F.col("m") <= FAMILY) & (F.col("w") <= FAMILY_WORDS)
    placed = stored(placed.join(load, "family").select("id", "family", "n", fits.alias("fits")), "families")
    small = placed.where("fits").select("id", "family")
    rows = small.join(pick(texts(small.select("id")), small.select("id"), "id"), "id").withColumn("role", F.lit(0))
    links = _grouped(rows, ["family"], lambda roles, ids, sets: _forest(ids, sets, ids, sets, threshold, weighted) if ids else [])
    links = stored(links, "links")
    large = placed.where("NOT fits").select("id", "n")
    if not large.limit(1).count():
        return components(links)
    shared = stored(shared.join(large, "id"), "buckets")
    order = F.xxhash64("id", F.pmod("key", F.lit(2)))
    other = shared.groupBy("key").agg(F.min_by("id", order).alias("o"))
    both = shared.join(other, "key").select("id", F.explode(F.array("c", "o")).alias("a")).where("id <> a")
    pairs = stored(both.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), "pairs")
    starred = stored(links.union(verified(pairs, texts, threshold, weighted)), "links")
    parts = components(starred)
    state = stored(shared.join(parts, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component")), "state")
    groups = state.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    largest = F.max(F.struct("m", "component", "w"))
    still = groups.groupBy("key").agg(largest.alias("top"), F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("w").alias("w")).where("parts > 1")

    def blocks(items, words):
        return F.greatest(F.ceil(items / BLOCK), F.ceil(words / BLOCK_WORDS)).cast("int")

    still = still.select(
        "key", F.col("top.component").alias("largest"), blocks(F.col("m"), F.col("w")).alias("ba"),
        blocks(F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w")).alias("bo"),
    )
    held = stored(state.join(still, "key").withColumn("out", F.col("component") != F.col("largest")), "open")
    if not held.limit(1).count():
        return parts
    spread = F.xxhash64("id")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    outside = held.where("out").select("key", "id", F.lit(0).alias("role"), F.pmod(spread, "bo").cast("int").alias("i"), every("ba").alias("j"))
    inside = held.select("key", "id", F.lit(1).alias("role"), every("bo").alias("i"), F.pmod(spread, "ba").cast("int").alias("j"))
    rows = outside.union(inside)
    ids = stored(held.select("id").distinct(), "ids")
    rows = rows.join(pick(texts(ids), ids, "id"), "id")

    def two_sides(roles, ids, sets):
        left, right = [k for k, r in enumerate(roles) if r == 0], [k for k, r in enumerate(roles) if r == 1]
        if not left or not right:
            return []
        return _forest([ids[k] for k in left], [sets[k] for k in left], [ids[k] for k in right], [sets[k] for k in right], threshold, weighted)

    return components(starred.union(stored(_grouped(rows, ["key", "i", "j"], two_sides), "links")))
