"""Operator 2: language identification by segmentation-marginalised unigrams."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, read, shorten_batches, stored
from .pieces import MARKER, MODEL
from .registry import query

UNDETERMINED = "und"
#: Longest piece in bytes; a character without a piece has this probability in every language.
LONGEST, UNKNOWN = 12, 1e-7
#: Words longer than this (bytes), and those whose probability comes near the smallest number, are summed in logarithms, one by one.
LONG_WORD, TINY = 96, 1e-250
#: Longer runs of letters are learned from in pieces of so many letters, as scripts without blanks have them.
RUN = 24
#: At most about so many documents are learned from, chosen by a hash of their text.
TRAIN_DOCUMENTS = 20_000
ROUNDS, ALPHA = 2, 0.05
#: Words a worker keeps, and their letters in all.
CACHE, CACHE_LETTERS = 500_000, 1 << 23
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def vocabulary(path: str = MODEL) -> list[bytes]:
    """Pieces made of letters, a blank for the marker at their start, of a public vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).replace(MARKER, " ").lower() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return sorted(x for x in (p.encode() for p in found if re.fullmatch(r" ?[^\W\d_]*", p) and p) if len(x) <= LONGEST)


class Lattice:
    """All occurrences of pieces in many words at once."""

    SLOTS = 1 << 20

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.mult = np.uint64(0x9E3779B97F4A7C15 | 1)
        keys = self._hash_all(pieces)
        self.slot = np.full(self.SLOTS, -1, np.int32)
        self.keys = keys
        self.chain = np.full(len(pieces), -1, np.int32)
        for i, k in enumerate((keys & np.uint64(self.SLOTS - 1)).tolist()):
            self.chain[i], self.slot[k] = self.slot[k], i
        self.depth = 1
        lengths = np.zeros(len(pieces), np.int32)
        for i in range(len(pieces)):
            lengths[i] = 1 if self.chain[i] < 0 else lengths[self.chain[i]] + 1
        self.depth = int(lengths.max(initial=1))

    def _hash_all(self, pieces: list[bytes]) -> np.ndarray:
        out = []
        for p in pieces:
            h = 0
            for c in p:
                h = (h * int(self.mult) + c + 1) & (2**64 - 1)
            out.append(h)
        return mix(np.array(out, np.uint64))

    def edges(self, items: list[bytes]):
        """(word, start, end, piece) of every occurrence, piece -1 for a character that has no piece of its own; word lengths."""
        sizes = np.fromiter(map(len, items), np.int64, len(items))
        raw = np.frombuffer(b"".join(items), np.uint8)
        word = np.repeat(np.arange(len(items)), sizes)
        at = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = sizes[word] - at
        lead = (raw & 0xC0) != 0x80
        width = np.where(raw < 0x80, 1, np.where(raw < 0xE0, 2, np.where(raw < 0xF0, 3, 4)))
        found, alone = [], np.zeros(len(raw), bool)
        h = np.zeros(len(raw), np.uint64)
        padded = np.concatenate((raw, np.zeros(LONGEST, np.uint8)))
        for n in range(1, LONGEST + 1):
            h = h * self.mult + padded[n - 1 : n - 1 + len(raw)] + np.uint64(1)
            live = np.flatnonzero(lead & (left >= n))
            if not len(live):
                break
            key = mix(h[live])
            hit = self.slot[(key & np.uint64(self.SLOTS - 1)).astype(np.int64)]
            for _ in range(self.depth):
                other = (hit >= 0) & (self.keys[np.maximum(hit, 0)] != key)
                if not other.any():
                    break
                hit = np.where(other, self.chain[np.maximum(hit, 0)], hit)
            ok = (hit >= 0) & (self.keys[np.maximum(hit, 0)] == key)
            where = live[ok]
            alone[where[width[where] == n]] = True
            found.append((word[where], at[where], at[where] + n, hit[ok]))
        bare = np.flatnonzero(lead & ~alone)
        found.append((word[bare], at[bare], at[bare] + width[bare], np.full(len(bare), -1, np.int32)))
        return (*(np.concatenate(x) for x in zip(*found)), sizes)

    def forward(self, edges, probs: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]: probability of the first bytes, summed over all segmentations."""
        word, start, end, piece, sizes = edges
        alpha = np.zeros((len(sizes), int(sizes.max()) + 1, probs.shape[1]))
        alpha[:, 0] = 1.0
        order = np.argsort(start, kind="stable")
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        cut = np.searchsorted(start, np.arange(start[-1] + 2))
        for s in range(int(start[-1]) + 1):
            part = slice(cut[s], cut[s + 1])
            # Of one word no two occurrences with one start have the same end, bar a bare character and a longer piece: never equal.
            alpha[word[part], end[part]] += alpha[word[part], s] * probs[piece[part]]
        return alpha

    def backward(self, edges, probs: np.ndarray) -> np.ndarray:
        word, start, end, piece, sizes = edges
        beta = np.zeros((len(sizes), int(sizes.max()) + 1, probs.shape[1]))
        beta[np.arange(len(sizes)), sizes] = 1.0
        order = np.argsort(-end, kind="stable")
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        cut = np.searchsorted(-end, -np.arange(end[0], -1, -1), side="left")
        bounds = np.append(cut, len(end))
        for k in range(len(cut)):
            part = slice(bounds[k], bounds[k + 1])
            np.add.at(beta, (word[part], start[part]), beta[word[part], end[part]] * probs[piece[part]])
        return beta

    def log_probability(self, items: list[bytes], probs: np.ndarray) -> np.ndarray:
        """log P(word) for every language; ``probs`` has one more row than pieces, the last for a bare character."""
        out = np.zeros((len(items), probs.shape[1]))
        short = [i for i, w in enumerate(items) if len(w) <= LONG_WORD]
        for lo in range(0, len(short), 20_000):
            block = short[lo : lo + 20_000]
            block.sort(key=lambda i: len(items[i]))
            for part in np.array_split(block, max(1, len(block) // 2_500)):
                some = [items[i] for i in part]
                edges = self.edges(some)
                alpha = self.forward(edges, probs)
                found = alpha[np.arange(len(some)), edges[4]]
                tiny = (found < TINY).any(axis=1)
                out[part] = np.log(np.where(tiny[:, None], 1.0, found))
                for k in np.flatnonzero(tiny).tolist():
                    out[part[k]] = self._long(some[k], probs)
        for i, w in enumerate(items):
            if len(w) > LONG_WORD:
                out[i] = self._long(w, probs)
        return out

    def _long(self, item: bytes, probs: np.ndarray) -> np.ndarray:
        _, start, end, piece, _ = self.edges([item])
        alpha = np.full((len(item) + 1, probs.shape[1]), -np.inf)
        alpha[0] = 0.0
        logs = np.log(probs)
        for k in np.argsort(start, kind="stable").tolist():
            alpha[end[k]] = np.logaddexp(alpha[end[k]], alpha[start[k]] + logs[piece[k]])
        return alpha[-1]


class Model:
    """Languages, pieces and piece probabilities; scores words and keeps what it has scored."""

    def __init__(self, langs: list[str], pieces: list[bytes], probs: np.ndarray):
        self.langs, self.pieces, self.probs = langs, pieces, probs
        self.lattice, self.index, self.rows, self.used, self.letters = None, {}, None, 0, 0

    def __getstate__(self):
        return {"langs": self.langs, "pieces": self.pieces, "probs": self.probs, "lattice": None, "index": {}, "rows": None, "used": 0, "letters": 0}

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of whole texts by language, and their numbers of words."""
        if self.lattice is None:
            self.lattice = Lattice(self.pieces)
            self.rows = np.zeros((1024, len(self.langs)))
        lists = [words(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(w for x in lists for w in x if w not in self.index))
        if self.index and (len(self.index) + len(fresh) > CACHE or self.letters > CACHE_LETTERS):
            self.index, self.used, self.letters = {}, 0, 0
            fresh = list(dict.fromkeys(w for x in lists for w in x))
        self.letters += sum(map(len, fresh))
        if fresh:
            found = self.lattice.log_probability([b" " + w.encode() for w in fresh], self.probs)
            need = self.used + len(fresh)
            if need > len(self.rows):
                self.rows = np.concatenate((self.rows[: self.used], np.zeros((max(need, 2 * self.used) - self.used, len(self.langs)))))
            self.rows[self.used : need] = found
            self.index.update(zip(fresh, range(self.used, need)))
            self.used = need
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        out = np.zeros((len(texts), len(self.langs)))
        index = self.index
        for i, x in enumerate(lists):
            if x:
                out[i] = self.rows[np.fromiter(map(index.__getitem__, x), np.int64, len(x))].sum(axis=0)
        return out, counts


def fit(documents: DataFrame, path: str = MODEL, bound: int = TRAIN_DOCUMENTS, rounds: int = ROUNDS) -> Model:
    """Learn piece probabilities of each language from (text, lang) by expectation-maximisation over all segmentations.

    Starts from equal probabilities. Learns from about ``bound`` documents at most, chosen by a hash of the text; rows with a null
    lang, a null text or no letter teach nothing. Runs of more than RUN letters teach in parts of that size. Words are counted by language in Spark; each round sums expected piece counts in
    tasks and gathers pieces x languages numbers, which the vocabulary bounds. The languages are the distinct langs learned from.
    """
    spark = documents.sparkSession
    shorten_batches(spark)
    rows = documents.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    total = rows.count()
    if total > bound:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * bound / total))

    def count(frames):
        for frame in frames:
            found: dict[str, Counter] = {}
            for text, lang in zip(frame["text"], frame["lang"]):
                found.setdefault(lang, Counter()).update(words(text))
            yield pd.DataFrame([(a, w, n) for a, c in found.items() for w, n in c.items()], columns=["lang", "word", "n"])

    counts = rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "langid-words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    pieces = vocabulary(path)
    probs = np.full((len(pieces) + 1, max(len(langs), 1)), 1.0 / len(pieces))
    probs[-1] = UNKNOWN
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast((langs, pieces, probs))

        def expect(frames):
            langs, pieces, probs = shared.value
            lattice, sums = Lattice(pieces), np.zeros((len(langs), len(pieces) + 1))
            for frame in frames:
                for lang, part in frame.groupby("lang"):
                    a = langs.index(lang)
                    runs = [
                        (((" " if k == 0 else "") + w[k : k + RUN]).encode(), n) for w, n in zip(part["word"], part["n"]) for k in range(0, len(w), RUN)
                    ]
                    for lo in range(0, len(runs), 2_500):
                        items = [r for r, _ in runs[lo : lo + 2_500]]
                        own, edges = probs[:, a : a + 1], lattice.edges(items)
                        alpha, beta = lattice.forward(edges, own)[:, :, 0], lattice.backward(edges, own)[:, :, 0]
                        word, start, end, piece, sizes = edges
                        weight = np.array([n for _, n in runs[lo : lo + 2_500]], float) / alpha[np.arange(len(items)), sizes]
                        use = alpha[word, start] * own[piece, 0] * beta[word, end] * weight[word]
                        sums[a] += np.bincount(np.where(piece < 0, len(pieces), piece), use, len(pieces) + 1)
            a, i = np.nonzero(sums)
            yield pd.DataFrame({"a": a, "piece": i, "n": sums[a, i]})

        found = counts.mapInPandas(expect, "a int, piece int, n double").groupBy("a", "piece").agg(F.sum("n").alias("n")).collect()
        sums = np.zeros((len(pieces) + 1, len(langs)))
        for r in found:
            sums[r["piece"], r["a"]] = r["n"]
        probs = (sums + ALPHA) / (sums + ALPHA).sum(axis=0)
        probs[-1] = UNKNOWN
    return Model(langs, pieces, probs)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` in a struct ``row``, with lang_pred and score (share of the best language's likelihood).

    A text is the sequence of its runs of letters, lower-cased; each language's likelihood sums over all segmentations of each
    run into pieces. Null texts, texts without a letter, and every text if no language was learned: ``und``, score 0. Ties go to the
    first language by name. Rows are kept as they are; nothing is shuffled; the model (vocabulary x languages) is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        langs, shares = [], []
        for lo in range(0, len(texts), 512):
            part = texts.iloc[lo : lo + 512].tolist()
            if not own.langs:
                langs += [UNDETERMINED] * len(part)
                shares += [0.0] * len(part)
                continue
            scores, counts = own.scores(part)
            top = scores.argmax(axis=1)
            share = 1.0 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
            langs += [own.langs[t] if n else UNDETERMINED for t, n in zip(top, counts)]
            shares += np.where(counts > 0, share, 0.0).tolist()
        return pd.DataFrame({"lang_pred": langs, "score": shares})

    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return rows.withColumn("p", best("row.text")).select("row", "p.lang_pred", "p.score")


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    documents = read(spark, sf_dir, "documents").withColumn("held_out", held)
    model = fit(documents.where("NOT held_out"))
    return predict(documents.select("doc_id", "held_out", "text"), model).select("row.doc_id", "row.held_out", "lang_pred", "score")
