"""Operator 4: quality classifier, a generalised additive model with pairwise interactions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, read, shorten_batches
from .registry import query

#: At most so many labelled rows are fitted on, the first by a hash of their id. The fit holds rows x features small numbers.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, SHRINK = 150, 60, 0.15, 3, 1.0
THRESHOLD = 0.7

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "distinct_words", "distinct_pairs", "upper", "digit", "mark", "symbol", "wide", "blank",
    "log_lines", "line_words", "distinct_lines", "marked_words", "stops",
]
#: Classes of bytes: 0 lower, 1 upper, 2 digit, 3 common marks, 4 other ASCII symbols, 5 beyond ASCII, 6 blank, 7 line end and control.
_KIND = np.full(256, 4, np.uint8)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 0, 1, 2
_KIND[[ord(c) for c in ".,;:'\"()-?!"]] = 3
_KIND[128:], _KIND[:32], _KIND[32] = 5, 7, 6


def features(text: str | None) -> list[float]:
    """Figures of a whole text; those of a null text are those of an empty one."""
    raw = (text or "").encode()
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8)
    size = max(len(raw), 1)
    words = raw.split()
    n = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x]
    solid = size - kinds[6] - kinds[7]
    letters = max(kinds[0] + kinds[1], 1)
    lower = raw.lower().split()
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), solid / n, len(set(lower)) / n, len(set(zip(lower, lower[1:]))) / n,
        kinds[1] / letters, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size,
        float(np.log1p(len(lines))), len(words) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1),
        sum(not x[-1:].isalnum() and x[-1] < 128 for x in words) / n, raw.count(b". ") / n,
    ]


@dataclass
class Gam:
    """Score of a row: intercept + one table entry per feature + one per pair, all found by bin numbers."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[f], x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _tree(gain: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Leaf values over bins of a tree that splits greedily into LEAVES leaves."""
    cuts, g, h = [0, len(gain)], np.concatenate(([0], np.cumsum(gain))), np.concatenate(([0], np.cumsum(weight)))

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + SHRINK)

    for _ in range(LEAVES - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                more = worth(a, m) + worth(m, b) - worth(a, b)
                k = int(more.argmax())
                best = max(best, (float(more[k]), int(m[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gain))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + SHRINK)
    return out


def _quadrants(gain: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values over a grid of the tree that cuts both features once, and its gain."""
    g = np.zeros((gain.shape[0] + 1, gain.shape[1] + 1))
    h = g.copy()
    g[1:, 1:], h[1:, 1:] = gain.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    i, j = np.meshgrid(np.arange(1, gain.shape[0]), np.arange(1, gain.shape[1]), indexing="ij")

    def parts(t):
        return [t[i, j], t[i, -1] - t[i, j], t[-1, j] - t[i, j], t[-1, -1] - t[i, -1] - t[-1, j] + t[i, j]]

    if not i.size:
        return np.zeros(gain.shape), 0.0
    gs, hs = parts(g), parts(h)
    worth = sum(a * a / (b + SHRINK) for a, b in zip(gs, hs)) - g[-1, -1] ** 2 / (h[-1, -1] + SHRINK)
    k = np.unravel_index(int(worth.argmax()), worth.shape)
    a, b = int(i[k]), int(j[k])
    v = [x[k] / (y[k] + SHRINK) for x, y in zip(gs, hs)]
    out = np.empty(gain.shape)
    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = v
    return out, float(worth[k])


def fit_tables(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting: every round fits one shallow tree per feature to the gradient and adds it to that feature's table; then the
    same for the pairs that explain most of what is left."""
    def edges(n):
        return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]

    cuts, coarse = edges(BINS), edges(PAIR_BINS)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Gam(cuts, coarse, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts])
    if not len(x) or y.min() == y.max():
        return model
    fine = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    total = np.full(len(x), model.intercept)
    for _ in range(ROUNDS):
        for f, bins in enumerate(fine):
            p = 1.0 / (1.0 + np.exp(-total))
            size = len(cuts[f]) + 1
            step = RATE * _tree(np.bincount(bins, y - p, size), np.bincount(bins, p * (1 - p), size))
            model.tables[f] += step
            total += step[bins]
    rough = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]

    def grid(f, g):
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        cell = rough[f] * shape[1] + rough[g]
        p = 1.0 / (1.0 + np.exp(-total))
        return cell, np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_quadrants(*grid(f, g)[1:])[1], f, g) for f in range(len(cuts)) for g in range(f)), reverse=True)
    model.pairs = [(f, g) for _, f, g in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1)) for f, g in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (f, g) in enumerate(model.pairs):
            cell, gain, weight = grid(f, g)
            step = RATE * _quadrants(gain, weight)[0]
            model.pair_tables[k] += step
            total += step.ravel()[cell]
    return model


def fit(documents: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Gam:
    """Fit on labelled documents: ``labels`` (doc_id, quality 0 or 1), ``documents`` (doc_id, text).

    At most ``bound`` labels are used, the first by a hash of doc_id; that many rows of features are gathered, never texts. Labels
    that are null, other than 0 or 1, or contradict each other for one doc_id are left out; repeated rows count once. With no
    label, or only one kind, the score is one constant.
    """
    shorten_batches(documents.sparkSession)
    clean = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z").select("doc_id", "y")
    )
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)

    @F.pandas_udf("array<double>")
    def figures(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    texts = pick(documents.select("doc_id", "text"), chosen.select("doc_id"), "doc_id").select("doc_id", figures("text").alias("x"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("x").alias("x"), F.first("y").alias("y")).toPandas()
    rows = rows.sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_tables(x, rows["y"].to_numpy(float))


def scorer(model: Gam, text: Column) -> Column:
    """Column: probability of label 1 by the features of a whole text; a null text counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.array([features(t) for t in texts], float)))

    return score(text)


def classify(documents: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """(row, score, predicted): every row with its whole input as ``row``, the score and 1 where it reaches the threshold.
    Empty and null texts are scored like any other; repeated rows stay; nothing is shuffled."""
    shorten_batches(documents.sparkSession)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    scored = rows.withColumn("score", scorer(model, F.col("row.text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op4_quality")
def op4_quality(spark, sf_dir):
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    documents = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held)
    labels = read(spark, sf_dir, "labels").withColumn("held_out", held).where("NOT held_out")
    scored = classify(documents, fit(documents, labels))
    return scored.select("row.doc_id", "row.held_out", "score", "predicted")
