"""Linear epsilon-insensitive regression: distributed sums of reweighted normal equations, solved round by round.

Each hinge is replaced by the parabola that touches it at the current residual, and the resulting weighted ridge problem is solved
exactly. All problems share a pass over the rows; what it brings back is one row of sums per problem, rows never leave the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .margin import GATHERED, Report

#: Numbers that the sums of one pass may hold in a task.
HELD = 20_000_000
#: Products of a task that are made at once.
AT_ONCE = 2_000_000


@dataclass(frozen=True)
class Tube:
    """One weight of the loss and half width of the free band to fit for."""

    C: float
    epsilon: float
    max_iter: int
    tol: float


def sparse_rows(rows: DataFrame) -> DataFrame:
    """(features, y) to (at, x, y): the places and values of each vector, a last place with 1 for the intercept."""
    v = F.unwrap_udt("features")
    width = F.coalesce(v["size"], F.size(v["values"]))
    at = F.when(v["indices"].isNotNull(), v["indices"]).when(width == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), width - 1))
    return rows.select(F.concat(at, F.array(width)).alias("at"), F.concat(v["values"], F.array(F.lit(1.0))).alias("x"), "y")


def _parabolas(residual: np.ndarray, y: np.ndarray, tube: Tube, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight and target of each row, and its loss."""
    over, under = residual - tube.epsilon, -residual - tube.epsilon
    wide, wide2 = np.maximum(np.abs(over), floor), np.maximum(np.abs(under), floor)
    a, b = 1 / (4 * wide), 1 / (4 * wide2)
    target = (a * (y - tube.epsilon + wide) + b * (y + tube.epsilon - wide2)) / (a + b)
    return 2 * tube.C * (a + b), target, np.maximum(0.0, np.maximum(over, under))


def _sums(rows: DataFrame, tasks: int, width: int, floor: float, points: list[tuple[Tube, np.ndarray] | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each point (problem, weights with the intercept last) the loss and the weighted sums of products of columns, and of columns
    and target; with weight 1 and the label itself as the target for a point that is None."""

    def add(batches):
        total = [[0.0, np.zeros(width * width), np.zeros(width)] for _ in points]
        for batch in batches:
            lengths, y_all = np.diff(batch.column(0).offsets.to_numpy()), batch.column(2).to_numpy(zero_copy_only=False)
            if not np.isfinite(y_all).all():
                raise ValueError("labels must not be null, NaN or infinite")
            at_all, x_all, ends = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths)))
            longest = int(lengths.max(initial=1))
            dense = longest * longest * 4 > width * width
            step = max(1, AT_ONCE // (width if dense else longest * longest))
            for i in range(0, len(lengths), step):
                size, y = lengths[i : i + step], y_all[i : i + step]
                at, x = at_all[ends[i] : ends[min(i + step, len(lengths))]], x_all[ends[i] : ends[min(i + step, len(lengths))]]
                n, row = len(size), np.repeat(np.arange(len(size)), size)
                if dense:
                    full = np.zeros((n, width))
                    full[row, at] = x
                else:  # all pairs of places of a row
                    first = np.concatenate(([0], np.cumsum(size)))[:-1]
                    many = size[row]
                    left = np.repeat(np.arange(len(at)), many)
                    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[row], many)
                    pair, product, of = at[left].astype(np.int64) * width + at[right], x[left] * x[right], row[left]
                for own, point in zip(total, points):
                    if point is None:
                        w, t, loss = np.ones(n), y, np.zeros(n)
                    else:
                        tube, weights = point
                        w, t, loss = _parabolas(y - np.bincount(row, x * weights[at], n), y, tube, floor)
                    own[0] += float(loss.sum())
                    own[1] += (full.T @ (full * w[:, None])).ravel() if dense else np.bincount(pair, product * w[of], width * width)
                    own[2] += np.bincount(at, x * (w * t)[row], width)
        lists = [np.concatenate(([t[0]], t[1], t[2])) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(points)), pa.int32()), pa.array(lists, pa.list_(pa.float64()))], ["p", "v"])

    parts = rows.mapInArrow(add, "p int, v array<double>")
    if tasks * len(points) * (1 + width + width * width) > GATHERED:
        parts = parts.groupBy("p").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    found: list = [0.0] * len(points)
    table = parts.toArrow()
    for k, v in zip(table["p"].to_pylist(), table["v"]):
        found[k] = found[k] + v.values.to_numpy()
    return [(v[0], v[1 : 1 + width * width].reshape(width, width), v[1 + width * width :]) for v in found]


def _solve(products: np.ndarray, targets: np.ndarray, ridge: float) -> np.ndarray:
    """Weights with the intercept last, which bears no penalty."""
    n, sums = products[-1, -1], products[-1, :-1]
    inner = products[:-1, :-1] - np.outer(sums, sums) / n
    weights = np.linalg.solve(inner + ridge * np.eye(len(sums)), targets[:-1] - sums * (targets[-1] / n))
    return np.append(weights, (targets[-1] - sums @ weights) / n)


class _Fit:
    """One problem: the weights it wants sums for next, until it is done."""

    def __init__(self, tube: Tube, weights: np.ndarray):
        self.tube, self.weights, self.rounds, self.previous, self.fall, self.converged = tube, weights, 0, math.inf, math.inf, False

    def told(self, loss: float, products: np.ndarray, targets: np.ndarray) -> bool:
        """Take the sums at the weights; True while others are wanted."""
        self.rounds += 1
        inner = self.weights[:-1]
        objective = 0.5 * float(inner @ inner) + self.tube.C * float(loss)
        self.fall = (self.previous - objective) / max(1.0, abs(objective))
        self.converged = self.fall <= self.tube.tol
        if self.converged:
            return False
        self.previous, self.weights = objective, _solve(products, targets, 1.0)
        return self.rounds < self.tube.max_iter


def fit_tubes(rows: DataFrame, width: int, floor: float, tubes: list[Tube]) -> list[tuple[np.ndarray, Report]]:
    """Weights (the intercept last) and a report for each problem over rows of ``sparse_rows``. Minimises half the squared norm of the
    weights, never of the intercept, plus C times the summed loss."""
    width, tasks = width + 1, rows.rdd.getNumPartitions()
    ((_, products, targets),) = _sums(rows, tasks, width, floor, [None])
    every = [_Fit(tube, _solve(products, targets, 1.0 / tube.C)) for tube in tubes]
    live, together = [f for f in every if f.tube.max_iter > 0], max(1, HELD // (width * width))
    while live:
        left = []
        for i in range(0, len(live), together):
            group = live[i : i + together]
            found = _sums(rows, tasks, width, floor, [(f.tube, f.weights) for f in group])
            left += [f for f, sums in zip(group, found) if f.told(*sums)]
        live = left
    return [(f.weights, Report(f.rounds, f.fall, f.converged)) for f in every]
