"""Operator 8: duplicate passages by paragraph MinHash banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, SHINGLE, Words, mix, read, released, short_batches, stored
from .nearpairs import connect
from .registry import query

THRESHOLD = 0.8
#: Paragraphs below so many words are left alone, and passages have at least as many.
LEAST_WORDS = 40
#: Bits of the filter of shared anchors: so many for each of them, within these powers of two. A full filter costs work, not results.
FILTER_BITS, FILTER_RANGE = 16, (16, 29)
#: Two paragraphs at the threshold miss every band with at most this probability.
MISS = 5e-4
HASHES = 64
SLICE = 1 << 20


def banding(threshold: float = THRESHOLD, miss: float = MISS, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which, of ``hashes`` values, a pair at the threshold is missed with at most ``miss``."""
    fit = [(hashes // r, r) for r in range(1, hashes + 1) if (1 - threshold**r) ** (hashes // r) <= miss]
    return fit[-1] if fit else (hashes, 1)


class Runs:
    """Words of many texts with their spans in code points and the hash of every run of words."""

    odd = 0x9FB21C651E98DF25

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.words = w = Words(raw)
        self.n = n = len(w.hash)
        # Code points before each byte, so that spans count characters.
        joined = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        points = np.concatenate(([0], np.cumsum((joined & 0xC0) != 0x80)))
        origin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))[:-1]
        self.start = points[origin[w.text] + w.start] - points[origin[w.text]]
        self.end = points[origin[w.text] + w.end] - points[origin[w.text]]
        up = np.cumprod(np.full(n, self.odd, np.uint64))
        self.down = np.cumprod(np.full(n, pow(self.odd, -1, 1 << 64), np.uint64))
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hash * up, dtype=np.uint64)))

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64))

    def check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A second hash of the same words, of 32 bits: runs are taken as equal only if both agree."""
        if not hasattr(self, "again"):
            turned = mix(self.words.hash ^ np.uint64(0x9E3779B97F4A7C15))
            self.up2 = np.cumprod(np.full(self.n, 0xD6E8FEB86659FD93, np.uint64))
            self.down2 = np.cumprod(np.full(self.n, pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64))
            self.again = np.concatenate((np.zeros(1, np.uint64), np.cumsum(turned * self.up2, dtype=np.uint64)))
        return (mix((self.again[b] - self.again[a]) * self.down2[a]) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def starts(self, size: int) -> np.ndarray:
        """Where a run of ``size`` words of one text starts."""
        text = self.words.text
        return np.flatnonzero(text[: max(self.n - size + 1, 0)] == text[size - 1 :])

    def lowest(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash): where runs of ``least`` words start, and the smallest hash of the runs of half the length inside each.
        It follows from the run's words alone, so texts that share a run share its anchor."""
        size = (least + 1) // 2
        whole = self.starts(least)
        at = np.arange(max(self.n - size + 1, 0))
        h = self.hash(at, at + size)
        low = h[whole]
        for k in range(1, least - size + 1):
            np.minimum(low, h[whole + k], out=low)
        return whole, low


#: Kinds of units.
PARAGRAPH, ANCHOR, WHOLE, WINDOW = range(4)
UNIT = "doc_id long, h long, kind int, start int, end int, words int, hash long, check int, alive boolean, keys array<long>"


def _units(texts: list[str], marks: list, bands: int, rows: int, least: int) -> Iterator[tuple]:
    """Arrays (kind, text, start, end, words, hash, check, alive, band keys or None): paragraphs, anchors (hash alone) and whole texts."""
    runs = Runs(texts)
    w, n, odd = runs.words, runs.n, runs.odd
    if not n:
        return
    new_line = np.concatenate(([True], w.line[1:] != w.line[:-1]))
    heads = np.flatnonzero(new_line)
    tails = np.concatenate((heads[1:], [n]))
    long = tails - heads >= least
    a, b = heads[long], tails[long]
    if len(a):
        padded = np.concatenate((w.hash, np.zeros(SHINGLE, np.uint64)))
        shingle = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            shingle = shingle * np.uint64(odd) + padded[k : k + n]
        shingle = mix(shingle)
        size = b - a - SHINGLE + 1
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own, cut = shingle[at], np.cumsum(size) - size
        keys = np.zeros((len(a), bands), np.uint64)
        for band in range(bands):
            keys[:, band] = band + 1
            for r in range(rows):
                salt = np.uint64((band * rows + r + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))
                turned = (own ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
                low = np.minimum.reduceat(turned ^ (turned >> np.uint64(31)), cut)
                keys[:, band] = mix(keys[:, band] * np.uint64(odd) + low)
        yield PARAGRAPH, w.text[a], runs.start[a], runs.end[b - 1], b - a, runs.hash(a, b), runs.check(a, b), None, keys.view(np.int64)
    first, last = w.starts[:-1], w.starts[1:]
    whole = np.flatnonzero(last - first >= least)
    if len(whole):
        a, b = first[whole], last[whole]
        yield WHOLE, whole, runs.start[a], runs.end[b - 1], b - a, runs.hash(a, b), runs.check(a, b), None, None
    at, anchor = runs.lowest(least)
    if len(at):
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (w.text[at[1:]] != w.text[at[:-1]])))
        none = np.zeros(new.sum(), np.int64)
        yield ANCHOR, w.text[at[new]], none, none, none, anchor[new], none, None, None


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (bits[(hashes >> np.uint64(6)) & np.uint64(len(bits) - 1)] >> (hashes & np.uint64(63))) & np.uint64(1) == 1


def _windows(texts: list[str], marks: list, seen: np.ndarray, least: int) -> Iterator[tuple]:
    """All runs of ``least`` words whose anchor is in the filter; ``alive`` are those that touch none of the text's marks."""
    runs = Runs(texts)
    at, anchor = runs.lowest(least)
    at = at[_has(seen, anchor)]
    if len(at):
        text, start, end = runs.words.text[at], runs.start[at], runs.end[at + least - 1]
        gone = sorted((k << 32 | m["start"], k << 32 | m["end"]) for k, found in enumerate(marks) for m in found or ())
        place = text.astype(np.int64) << 32
        before = np.searchsorted(np.array([g[0] for g in gone], np.int64), place | end, "left")
        upto = np.concatenate(([-1], np.maximum.accumulate([g[1] for g in gone]))) if gone else np.array([-1])
        alive = upto[before] <= (place | start)
        yield WINDOW, text, start, end, np.full(len(at), least), runs.hash(at, at + least), runs.check(at, at + least), alive, None


def _cut(units, bands: int):
    """``units`` of (texts, marks) over slices of the batches, which have doc_id, h, text and marks."""

    def run(batches):
        names = [x.split()[0] for x in UNIT.split(", ")]
        for batch in batches:
            ids, hs, texts, marks = (batch.column(c).to_pylist() for c in range(4))
            lo = 0
            while lo < len(ids):
                hi, size = lo, 0
                while hi < len(ids) and (hi == lo or size < SLICE):
                    size += len(texts[hi])
                    hi += 1
                for kind, text, start, end, words, hashes, check, alive, keys in units(texts[lo:hi], marks[lo:hi]):
                    for part in range(0, len(text), 50_000):
                        s = slice(part, part + 50_000)
                        own = text[s] + lo
                        n = len(own)
                        lists = pa.nulls(n, pa.list_(pa.int64())) if keys is None else pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, pa.array(keys[s].ravel()))
                        flags = pa.nulls(n, pa.bool_()) if alive is None else pa.array(alive[s])
                        numbers = [np.full(n, kind), start[s], end[s], words[s]]
                        columns = [np.array(ids, np.int64)[own], np.array(hs, np.int64)[own], *(x.astype(np.int32) for x in numbers), hashes[s].view(np.int64), check[s].astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), flags, lists], names)
                lo = hi

    return run


def _filter(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes (column ``hash``), 64 in each number; the length is a power of two."""
    low, high = FILTER_RANGE
    power = min(max((hashes.count() * FILTER_BITS).bit_length(), low), high)
    out = np.zeros(1 << (power - 6), np.int64)
    place = F.shiftrightunsigned("hash", 6).bitwiseAND(F.lit(len(out) - 1))
    bits = hashes.groupBy(place.alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(hash & 63 AS INT)))").alias("bits")).toArrow()
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return out.view(np.uint64)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals that overlap or touch, and for each interval, in the order given, the number of its union."""
    order = np.lexsort((end, start))
    s, e = start[order], end[order]
    far = np.maximum.accumulate(e) if len(e) else e
    new = np.concatenate((np.ones(min(len(s), 1), bool), s[1:] > far[:-1]))
    own = np.empty(len(s), np.int64)
    own[order] = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    return s[head], far[np.append(head[1:], len(s)) - 1] if len(s) else far, own


def without(start: np.ndarray, end: np.ndarray, off: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals less the disjoint, sorted intervals from ``off`` to ``on``: what is left, and of which interval each piece is."""
    lo, hi = np.searchsorted(on, start, "right"), np.searchsorted(off, end, "left")
    n = np.maximum(hi - lo, 0) + 1
    own = np.repeat(np.arange(len(start)), n)
    j = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    left, right = np.append(on, 0), np.append(off, 0)
    a = np.where(j == 0, start[own], left[np.minimum(lo[own] + j - 1, len(on))])
    b = np.where(j == n[own] - 1, end[own], right[np.minimum(lo[own] + j, len(off))])
    some = a < b
    return a[some], b[some], own[some]


REMOVABLE, PROTECTED, STAYS = range(3)
SPAN = "doc_id long, h long, start int, end int, kind int, cluster_id long, keeper_doc_id long"


def _settle(batches):
    """Rows of SPAN, sorted by document, to the spans removed (removable less protected, one row per keeper) and those that stay."""
    names = ["doc_id", "h", "start", "end", "cluster_id", "keeper_doc_id", "removed"]

    def done(table):
        doc, h, start, end, kind, cluster, keeper = (table.column(c).to_numpy() for c in range(7))
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
        number = np.cumsum(new) - 1
        ids, hs = doc[new], h[new]
        base = number.astype(np.int64) << 32
        a, b = base | start, base | end
        kept = kind == PROTECTED
        off, on, _ = merged(a[kept], b[kept])
        out = []

        def put(a, b, cluster, keeper, removed):
            at = a >> 32
            columns = [ids[at], hs[at], (a & 0xFFFFFFFF).astype(np.int32), (b - (at << 32)).astype(np.int32), cluster, ids[at] if keeper is None else keeper, np.full(len(a), removed)]
            out.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names))

        gone = np.flatnonzero(kind == REMOVABLE)
        pair, code = np.unique(np.stack((number[gone], keeper[gone])), axis=1, return_inverse=True)
        code = code.ravel().astype(np.int64) << 32
        s, e, own = merged(code | start[gone], code | end[gone])
        group = s >> 32
        least = np.full(len(s), 2**63 - 1)
        np.minimum.at(least, own, cluster[gone])
        shift = (pair[0][group] << 32) - (group << 32)
        s, e, piece = without(s + shift, e + shift, off, on)
        put(s, e, least[piece], pair[1][group][piece], True)
        cut_a, cut_b, _ = merged(s, e)
        stay = kind != REMOVABLE
        s, e, own = merged(a[stay], b[stay])
        least = np.full(len(s), 2**63 - 1)
        np.minimum.at(least, own, cluster[stay])
        s, e, piece = without(s, e, cut_a, cut_b)
        put(s, e, least[piece], None, False)
        return out

    held: list = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 50_000:
            table = pa.Table.from_batches(held).combine_chunks()
            doc, h = table.column(0).to_numpy(), table.column(1).to_numpy()
            cut = int(np.flatnonzero((doc != doc[-1]) | (h != h[-1]))[-1]) + 1 if (doc[0], h[0]) != (doc[-1], h[-1]) else 0
            if cut:
                yield from done(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), table.num_rows - cut
    if size:
        yield from done(pa.Table.from_batches(held).combine_chunks())


def _few(df: DataFrame, bound: int) -> bool:
    return df.limit(bound + 1).count() <= bound


def repeated(documents: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, end, cluster_id, keeper_doc_id, removed, text_hash): passages that occur in several documents.

    In three steps, each on what the ones before leave:

    1. Of equal texts of ``least`` words or more, that of the smallest doc_id stays; the others go whole.
    2. A paragraph is a line of ``least`` words or more. Equal paragraphs are one class; classes that collide in a MinHash band (banding
       tuned by ``banding``) are compared by exact Jaccard of their five-word runs and linked at ``threshold``. In each component
       the paragraphs of the document with the smallest doc_id stay; those of other documents go.
    3. A run of ``least`` words that several documents have, wherever it starts and whatever lines it crosses, stays in one of them: the
       one with the smallest doc_id among those where no paragraph that went touches it. There its words are protected.
       The other documents lose those of its words that are in no protected run of theirs.

    So text is never lost: whatever goes is still there whole in its keeper, but for the run's parts that a near-copy which stays replaces.
    Pieces of one document and keeper that overlap or touch are one row; ``removed`` is false for what stays. ``start`` and
    ``end`` count characters of the text, which ``text_hash`` (xxhash64) tells apart where a doc_id has several.

    Runs are found in two passes: anchors (winnowed runs of half the length, one at least in every run of ``least`` words) are
    counted by hash; then only the runs whose anchor several documents have are compared, by a filter of bounded size. Runs are equal if
    96 bits of hashes agree.

    Words are compared without ASCII case and punctuation. Repetition within one document is not reported. Null, empty and short
    texts, and rows without doc_id, give no rows; rows with one doc_id and text are one document, with other texts another one;
    further columns are ignored. Only texts of candidate paragraphs are read again, cut to the paragraph before they are shuffled.
    """
    spark = documents.sparkSession
    with short_batches(spark):
        return _repeated(documents, threshold, least)


def _repeated(documents: DataFrame, threshold: float, least: int) -> DataFrame:
    bands, rows = banding(threshold)
    place = ["doc_id", "h"]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = texts.select("doc_id", F.xxhash64("text").alias("h"), "text")

    # Equal texts: all but one go whole, and are looked at no more.
    digests = stored(texts.select(*place, F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.min(F.struct(*place)).alias("first"), F.max("doc_id").alias("z")).where("first.doc_id <> z")
    copies = digests.join(first.drop("z"), "digest").where("doc_id <> first.doc_id").select(*place, F.col("first.doc_id").alias("of"), F.col("first.h").alias("of_h"))
    copies = stored(copies.distinct(), "copies")
    ids = copies.select(*place)
    texts = texts.join(F.broadcast(ids), place, "left_anti") if _few(ids, BROADCAST_IDS) else stored(texts.join(ids, place, "left_anti"), "texts")

    def cut(units, texts: DataFrame) -> DataFrame:
        return texts.mapInArrow(released(_cut(units, bands)), UNIT)

    no_marks = F.lit(None).cast("array<struct<start:int,end:int>>").alias("marks")
    units = stored(cut(lambda t, m: _units(t, m, bands, rows, least), texts.select(*place, "text", no_marks)), "passages")

    def in_several(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
        found = rows.groupBy(*by).agg(F.min(F.struct(*place)).alias("a"), F.max(F.struct(*place)).alias("z"), *more)
        return found.where("a.doc_id <> z.doc_id").drop("a", "z")

    # Paragraphs: classes of equal ones, and links between them.
    paragraphs = units.where(F.col("kind") == PARAGRAPH)
    spot = F.struct("doc_id", "h", "start", "end")
    classes = paragraphs.groupBy("hash").agg(F.min(spot).alias("at"), F.any_value("keys").alias("keys"), F.any_value("words").alias("words"))
    classes = stored(classes, "paragraphs")

    def paragraph_texts(ids: DataFrame) -> DataFrame:
        spots = stored(classes.join(ids.withColumnRenamed("id", "hash"), "hash").select("hash", "at.*"), "spots")
        few = F.broadcast(spots) if _few(spots, BROADCAST_IDS // 4) else spots
        return texts.join(few, place).select(F.col("hash").alias("id"), F.expr("substring(text, start + 1, end - start)").alias("text"))

    members = classes.select(F.explode("keys").alias("key"), F.col("hash").alias("id"))
    words = classes.select(F.col("hash").alias("id"), F.col("words").cast("long").alias("n"))
    parts = connect(members, words, paragraph_texts, threshold, weighted=False).withColumnRenamed("id", "hash")
    named = paragraphs.join(parts, "hash", "left").select(*place, "start", "end", F.coalesce("component", "hash").alias("cluster_id"))
    keeper = F.min("doc_id").alias("keeper_doc_id")
    kept = named.groupBy("cluster_id").agg(keeper, F.max("doc_id").alias("z")).where("keeper_doc_id <> z").drop("z")
    kind = F.when(F.col("doc_id") == F.col("keeper_doc_id"), STAYS).otherwise(REMOVABLE).alias("kind")
    columns = [*place, "start", "end", kind, "cluster_id", "keeper_doc_id"]
    named = stored(named.join(kept, "cluster_id").select(*columns), "clusters")

    # Runs that several documents have.
    anchors = stored(in_several(units.where(F.col("kind") == ANCHOR), ["hash"]), "anchors")
    seen = documents.sparkSession.sparkContext.broadcast(_filter(anchors))
    gone = named.where(F.col("kind") == REMOVABLE)
    marks = gone.groupBy(*place).agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    marked = texts.join(F.broadcast(marks) if _few(gone, BROADCAST_IDS // 4) else marks, place, "left").select(*place, "text", "marks")
    windows = cut(lambda t, m: _windows(t, m, seen.value, least), marked).select(*place, "start", "end", "hash", "check", "alive")
    alive = F.min(F.when(F.col("alive"), F.struct(*place))).alias("keeper")  # cut twice: kept, the windows would be the largest table on disk
    shared = in_several(windows, ["hash", "check"], alive).where("keeper IS NOT NULL")
    kind = F.when((F.col("doc_id") == F.col("keeper.doc_id")) & (F.col("h") == F.col("keeper.h")), PROTECTED).otherwise(REMOVABLE).alias("kind")
    runs = windows.where("alive").join(shared, ["hash", "check"]).where("doc_id <> keeper.doc_id OR h = keeper.h")
    runs = runs.select(*place, "start", "end", kind, F.col("hash").alias("cluster_id"), F.col("keeper.doc_id").alias("keeper_doc_id"))

    spans = named.union(runs).repartition(*place).sortWithinPartitions(*place)
    settled = spans.mapInArrow(released(_settle), "doc_id long, h long, start int, end int, cluster_id long, keeper_doc_id long, removed boolean")

    # Copies of whole texts, and the texts that stay for them.
    whole = units.where(F.col("kind") == WHOLE).select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), "start", "end", F.col("hash").alias("cluster_id"))
    whole = copies.join(whole, ["of", "of_h"])
    copied = whole.select(*place, "start", "end", "cluster_id", F.col("of").alias("keeper_doc_id"), F.lit(True).alias("removed"))
    result = settled.union(copied)
    return stored(result.select("doc_id", "start", "end", "cluster_id", "keeper_doc_id", "removed", F.col("h").alias("text_hash")), "repeated")


def cut_out(text: Column, spans: Column) -> Column:
    """The text without the spans; where a whole line goes, so does one of the line ends around it."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, marks in zip(texts, lists):
            if text is None or marks is None:
                out.append(text)
                continue
            left, at = "", 0
            for start, end in sorted((m["start"], m["end"]) for m in marks):
                if end <= at:
                    continue
                left += text[at : max(start, at)]
                at = end
                if (not left or left.endswith("\n")) and text[at : at + 1] == "\n":
                    at += 1
            out.append(left + text[at:])
        return pd.Series(out)

    return cut(text, spans)


def deduplicated(documents: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_WORDS) -> DataFrame:
    """``documents`` without removed passages, columns as they are; ``n_chars``, where there is one, follows the new text. A
    document of which nothing but blanks is left goes; documents that were blank before stay, and so do rows without doc_id or text.
    Texts are shuffled only if the table of removed spans is too large to be broadcast."""
    spans = stored(repeated(documents, threshold, least).where("removed").select("doc_id", "text_hash", "start", "end"), "removed")
    marks = spans.groupBy(F.col("doc_id").alias("of"), "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    few = F.broadcast(marks) if _few(spans, BROADCAST_IDS // 2) else marks
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    joined = rows.join(few, (F.col("row.doc_id") == F.col("of")) & (F.xxhash64("row.text") == F.col("text_hash")), "left")
    joined = joined.withColumn("new", cut_out(F.col("row.text"), F.col("marks")))
    changed = joined.where("marks IS NULL OR length(trim(BOTH ' \n\t\r' FROM new)) > 0")
    size = F.when(F.col("marks").isNull(), F.col("row.n_chars")).otherwise(F.length("new")).cast(documents.schema["n_chars"].dataType) if "n_chars" in documents.columns else None
    fresh = {"text": F.col("new"), "n_chars": size}
    return changed.select([fresh[c].alias(c) if c in fresh and fresh[c] is not None else F.col(f"row.`{c}`").alias(c) for c in documents.columns])


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    return repeated(read(spark, sf_dir, "documents"))
