"""Operator 10: language-model scoring by prediction by partial matching, and a word unigram baseline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix, read, release, released, short_batches, stored
from .registry import query

#: Bytes of context; the byte that stands for "before the text" and for its end, which no UTF-8 text holds.
ORDER, EDGE = 5, 0xFF
SYMBOLS = 257
#: Bytes of text packed together, and bytes worked on at a time. They bound memory; results do not depend on them.
BLOCK, SLICE = 32 << 20, 1 << 19
#: Keys that are sorted or counted at a time.
RANGE = 1 << 18
GRAM, WORD = 0, 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIXED = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _slices(raw: bytes | memoryview) -> Iterator[tuple[bytes, bytes, bool]]:
    """A text in parts that end where a word ends, each with the ORDER bytes before it, and whether it is the last."""
    lo = 0
    while True:
        hi = min(len(raw), lo + SLICE)
        while hi < len(raw) and raw[hi] not in b" \t\n\x0b\x0c\r":
            hi += 1
        before = (bytes([EDGE]) * ORDER + raw[max(0, lo - ORDER) : lo])[-ORDER:]
        yield raw[lo:hi], before, hi == len(raw)
        if hi == len(raw):
            return
        lo = hi


def _batches(texts: list[bytes]) -> Iterator[list[tuple[int, bytes, bytes, bool]]]:
    """Slices of many texts, as many at a time as make up SLICE bytes."""
    some, size = [], 0
    for i, raw in enumerate(texts):
        for part, before, last in _slices(raw):
            some.append((i, part, before, last))
            size += len(part) + ORDER + 1
            if size >= SLICE:
                yield some
                some, size = [], 0
    if some:
        yield some


def _keys(some: list[tuple[int, bytes, bytes, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams (ORDER bytes and the next, the end being EDGE) and hashes of words of slices, each with its text's number."""
    joined = np.frombuffer(b"".join(before + part + (bytes([EDGE]) if last else b"") for _, part, before, last in some), np.uint8)
    sizes = np.array([len(part) + last for _, part, _, last in some], np.int64)
    text = np.array([i for i, *_ in some], np.int64)
    wide = joined.astype(np.int64)
    gram = np.zeros(max(len(wide) - ORDER, 0), np.int64)
    for k in range(ORDER + 1):
        gram = (gram << 8) | wide[k : len(wide) - ORDER + k]
    starts = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    inside = np.ones(len(wide), bool)
    for k in range(ORDER):
        inside[starts + k] = False
    gram = gram[inside[ORDER:]]
    owner = np.repeat(text, sizes)
    solid = ~_SPACE[joined] & inside & (joined != EDGE)
    edge = np.diff(np.concatenate(([0], solid.astype(np.int8), [0])))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return gram, owner, np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = end - first
    at = np.arange(len(joined)) - np.repeat(np.concatenate(([0], first)), np.diff(np.concatenate(([0], first, [len(joined)]))))
    powers = np.cumprod(np.full(int(at.max()) + 1, 0xD6E8FEB86659FD93, np.uint64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(solid, _MIXED[joined] * powers[at], np.uint64(0)), dtype=np.uint64)))
    hashes = (mix(total[end] - total[first] + length.astype(np.uint64)) >> np.uint64(2)).view(np.int64)
    slot = np.searchsorted(starts, first, side="right") - 1
    return gram, owner, hashes, text[slot]


def _distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (below 2 ** 62) and how often each occurs in texts learned from."""
    both = np.sort((keys << 1) | train)
    keys = both >> 1
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(both & 1, first).astype(np.int32) if len(first) else np.zeros(0, np.int32)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of several such results. One range of keys is merged after another, so that what is sorted at a time is small."""
    widest = max((keys for keys, _ in parts), key=len)
    size = sum(len(keys) for keys, _ in parts)
    step = max(1, RANGE * len(widest) // max(1, size))
    cuts = [np.concatenate(([0], np.searchsorted(keys, widest[step::step]), [len(keys)])) for keys, _ in parts]
    out_keys, out_n, end = np.empty(size, np.int64), np.empty(size, np.int32), 0
    for i in range(len(cuts[0]) - 1):
        keys, n = (np.concatenate([part[side][cut[i] : cut[i + 1]] for part, cut in zip(parts, cuts)]) for side in (0, 1))
        if not len(keys):
            continue
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        out_keys[end : end + len(first)], out_n[end : end + len(first)] = keys[first], np.add.reduceat(n, first)
        end += len(first)
    out_keys.resize(end, refcheck=False)
    out_n.resize(end, refcheck=False)
    return out_keys, out_n


class _Lookup:
    """Values by key, both read in place: their positions in order of a hash, so that a few reads find a key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, int(np.ceil(np.log2(max(len(keys), 1)))))
        self.shift, self.keys, self.values = np.uint64(64 - bits), keys, values
        self.first, slot = np.zeros((1 << bits) + 1, np.int32), np.empty(len(keys), np.int32)
        for lo in range(0, len(keys), RANGE):
            slot[lo : lo + RANGE] = self._slot(keys[lo : lo + RANGE])
            np.add.at(self.first, slot[lo : lo + RANGE] + 1, 1)
        np.cumsum(self.first, out=self.first)
        self.order = np.argsort(slot, kind="stable").astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.first[self._slot(keys)]
        place = self.order[at]
        wrong = np.flatnonzero(self.keys[place] != keys)
        while len(wrong):
            at[wrong] += 1
            place[wrong] = self.order[at[wrong]]
            wrong = wrong[self.keys[place[wrong]] != keys[wrong]]
        return self.values[place]


_PACKED = pa.schema([
    ("block", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())),
    ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary()),
])
_PACKED_DDL = "block long, kind int, key long, n long, ids array<long>, held array<boolean>, sizes array<long>, data binary"


def _pack(batches):
    """Blocks of texts (compressed), and the distinct grams and words of each with their counts in texts learned from."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, held, texts, size = [], [], [], 0

    def rows(block):
        found = {GRAM: [], WORD: []}
        train = ~np.array(held)
        for some in _batches(texts):
            gram, of_gram, word, of_word = _keys(some)
            for kind, keys, of in ((GRAM, gram, of_gram), (WORD, word, of_word)):
                found[kind].append(_distinct(keys, train[of]))
                if len(found[kind]) == 8:
                    found[kind] = [_merge(found[kind])]
        empty = {"ids": None, "held": None, "sizes": None, "data": None}
        for kind in list(found):
            keys, n = _merge(found.pop(kind))
            for lo in range(0, len(keys), 100_000):
                part = slice(lo, lo + 100_000)
                count = len(keys[part])
                columns = [np.full(count, block), np.full(count, kind, np.int32), keys[part], n[part].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.nulls(count, _PACKED.field(c).type) for c in empty)], schema=_PACKED)
        blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        yield pa.RecordBatch.from_pylist(
            [{"block": block, "kind": None, "key": None, "n": None, "ids": ids, "held": held, "sizes": [len(t) for t in texts], "data": blob}], _PACKED
        )

    for batch in batches:
        for i, h, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
            raw = (t or "").encode().lower()
            ids.append(i)
            held.append(h)
            texts.append(raw)
            size += len(raw) + 64
            if size >= BLOCK:
                yield from rows(number)
                number += 1
                ids, held, texts, size = [], [], [], 0
    if texts:
        yield from rows(number)


def _mask(order: int) -> int:
    return (1 << (8 * (order + 1))) - 1


def gram_model(grams: DataFrame) -> DataFrame:
    """(key, value): log10 probability of the last byte of each gram after the bytes before it.

    ``grams`` has (key, n): distinct grams and their counts in what is learned from, 0 where a gram only has to be scored. Escape
    method D with exclusion: a context of T symbols, d of them different, gives a symbol seen c times (2c - 1) / 2T and the escape
    d / 2T. After an escape, symbols seen in the longer context are left out of T and d; below order 0 all symbols not yet
    seen are equally likely. A context never seen is skipped. As seen symbols of a context are also seen in its suffix, what is
    left out is one sum per context, so the trie is one table (context and symbol, count) per order, joined by suffix.
    """
    levels = {ORDER: stored(grams.groupBy("key").agg(F.sum("n").alias("c")), "ppm-grams")}
    for j in range(ORDER - 1, -1, -1):
        shorter = levels[j + 1].groupBy(F.col("key").bitwiseAND(F.lit(_mask(j))).alias("key"))
        levels[j] = stored(shorter.agg(F.sum("c").alias("c")), f"ppm-{j}")
    base = levels[0].agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t"), F.count(F.when(F.col("c") > 0, 1)).alias("d")).first()
    t, d = base["t"] or 0, base["d"]
    fresh = -float(np.log10(SYMBOLS - d)) if d < SYMBOLS else 0.0
    seen = F.col("c") > 0
    p = F.when(seen, F.log10((2 * F.col("c") - 1) / (2 * t))).otherwise(float(np.log10(d / (2 * t))) + fresh if t else fresh)
    table = levels[0].select("key", "c", F.lit(t).cast("long").alias("t"), F.lit(d).cast("long").alias("d"), F.lit(fresh).alias("r"), p.alias("p"))
    for j in range(1, ORDER + 1):
        suffix = F.col("key").bitwiseAND(F.lit(_mask(j - 1)))
        below = table.select(*[F.col(x).alias("key" if x == "key" else f"{x}_below") for x in ("key", "c", "t", "d", "r", "p")])
        pairs = stored(levels[j].withColumn("full", F.col("key")).withColumn("key", suffix).join(below, "key").drop("key").withColumnRenamed("full", "key"), f"ppm-pairs-{j}")
        paired = pairs.withColumn("context", F.shiftright("key", 8))
        context = paired.where(seen).groupBy("context").agg(F.sum("c").alias("t"), F.count("*").alias("d"), F.sum("c_below").alias("e"))
        left = F.col("t_below") - F.col("e")
        kinds = F.col("d_below") - F.col("d")
        r = F.when(F.col("c_below") > 0, F.log10((2 * F.col("c_below") - 1) / (2 * left))).otherwise(
            F.when(kinds > 0, F.log10(kinds / (2 * left))).otherwise(0.0) + F.col("r_below")
        )
        p = F.when(F.col("d") == 0, F.col("p_below")).when(seen, F.log10((2 * F.col("c") - 1) / (2 * F.col("t")))).otherwise(
            F.log10(F.col("d") / (2 * F.col("t"))) + F.col("r")
        )
        table = (
            paired.join(context, "context", "left").fillna(0, ["t", "d", "e"])
            .withColumn("r", F.when(~seen & (F.col("d") > 0), r)).withColumn("p", p).select("key", "c", "t", "d", "r", "p")
        )
        # r is asked for at the next order only where this symbol was not seen here; else the count is used.
        level, used = stored(table.withColumn("r", F.coalesce("r", F.lit(0.0))), f"ppm-level-{j}"), [pairs, levels[j]]
        dropped(*used, *([before] if j > 1 else [levels[0]]))
        table = before = level
    return table.select("key", F.col("p").alias("value"))


def score(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``documents`` has doc_id, text and held_out; rows with held_out false are learned from. ``score`` is the log10 probability of
    the lower-cased (A-Z) bytes of the whole text and its end after up to five bytes of context; ``base_score`` that of its words
    and end by a smoothed unigram model. A null text is an empty one: one token, its end. A null doc_id is kept; a null held_out
    counts as false. Repeated rows are scored, and counted, one by one. An empty table gives none; with nothing to learn from,
    symbols are equally likely. Further columns are ignored.

    Texts are packed into blocks in place. What a block needs of the corpus is its distinct grams and words: their counts are
    summed over all blocks and go back by block, so neither vocabulary nor trie is ever held whole in one place, and the texts are
    shuffled once, compressed. Words are told apart by 62-bit hashes.
    """
    held = F.coalesce("held_out", F.lit(False)).alias("held")
    with short_batches(documents.sparkSession):
        packed = stored(documents.select(F.col("doc_id").cast("long").alias("id"), held, "text").mapInArrow(released(_pack), _PACKED_DDL), "ppm-blocks")
    # One exchange by key serves the sums and the answers.
    asked = packed.select(F.col("block").alias("of"), "kind", "key", "n")
    words = asked.where(f"kind = {WORD}").drop("kind").repartition("key")
    counts = words.groupBy("key").agg(F.sum("n").alias("value"))
    blobs = packed.where("kind IS NULL").select("block", "ids", "held", "sizes", "data")
    ends = blobs.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)).alias("n")).first()["n"]
    total = counts.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("n"), F.count(F.when(F.col("value") > 0, 1)).alias("v")).first()
    grams = asked.where(f"kind = {GRAM}").drop("kind")
    model = gram_model(grams)

    def by_block(pairs: DataFrame, kind: int) -> DataFrame:
        lists = pairs.groupBy("of").agg(F.collect_list("key").alias("keys"), F.collect_list("value").alias("values"))
        return lists.withColumn("kind", F.lit(kind))

    answers = by_block(words.join(counts.withColumn("value", F.col("value").cast("double")), "key"), WORD)
    answers = answers.unionByName(by_block(grams.select("of", "key").join(model, "key"), GRAM))
    tokens, kinds = int(total["n"]) + int(ends), int(total["v"]) + (1 if ends else 0)
    floor = np.log10(tokens + 0.1 * (kinds + 1))
    result = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        tables, kinds_there = {}, right.column("kind").to_pylist()
        for k in (GRAM, WORD):
            own = [i for i, kind in enumerate(kinds_there) if kind == k]  # one row at most; its lists are read in place
            keys, values = (
                right.column(x)[own[0]].values.to_numpy() if own else np.zeros(0, kind) for x, kind in (("keys", np.int64), ("values", np.float64))
            )
            tables[k] = _Lookup(keys, values)
            del keys, values
        out = []
        for row in left.to_pylist():
            data = memoryview(zstandard.ZstdDecompressor().decompress(row["data"]) if row["data"] else b"")
            cut = np.concatenate(([0], np.cumsum(row["sizes"])))
            texts = [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            n = len(texts)
            sums, base, count, known = np.zeros(n), np.zeros(n), np.ones(n, np.int64), np.full(n, int(ends > 0))
            base += np.log10(ends + 0.1) - floor
            for some in _batches(texts):
                gram, of_gram, word, of_word = _keys(some)
                sums += np.bincount(of_gram, tables[GRAM](gram), n)
                if len(word):
                    c = tables[WORD](word)
                    base += np.bincount(of_word, np.log10(c + 0.1) - floor, n)
                    count += np.bincount(of_word, minlength=n)
                    known += np.bincount(of_word, c > 0, n).astype(np.int64)
            columns = [row["ids"], row["held"], count, known, np.full(n, tokens), base, sums]
            out.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, result)], schema=result))
        del tables, right, left
        release()
        return pa.concat_tables(out) if out else result.empty_table()

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blobs.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(finish, ddl)


@query("op10_lm_scoring")
def op10_lm_scoring(spark, sf_dir):
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))
    return score(read(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out")))
