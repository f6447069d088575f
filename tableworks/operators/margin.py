"""Linear margin classifiers: distributed sums of loss, gradient and curvature, and Newton steps on them.

All classes of one against the rest share a pass over the rows. What a pass brings back is one row of sums per class, added up in tasks
and by Spark; rows never leave the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of all tasks that are added up by the driver; more are first added up by Spark.
GATHERED = 2_000_000
#: Up to so many features the curvature is summed in full; above, steps use gradients alone.
EXACT_WIDTH = 1024
#: Widths of the parabola that rounds the corner of the plain hinge, one after the other; the first holds every row at the start.
CORNERS = (4.0, 1.0, 0.25, 0.06, 0.02)
#: The largest change of a weight in one step.
REACH = 10.0


@dataclass
class Report:
    """How a fit ended: rounds, the largest violation of the optimality conditions relative to the start, whether it is within the tolerance."""

    rounds: int
    residual: float
    converged: bool


def _losses(margin: np.ndarray, corner: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature in the margin: the squared hinge, or the hinge with a rounded corner."""
    gap = np.maximum(0.0, 1.0 - margin)
    if corner is None:
        return gap * gap, -2.0 * gap, 2.0 * (gap > 0)
    near = (gap > 0) & (gap < corner)
    return np.where(near, gap * gap / (2 * corner), np.maximum(gap - corner / 2, 0.0)), -np.minimum(gap / corner, 1.0), near / corner


@dataclass(frozen=True)
class Problem:
    """One penalty, loss and weight of the loss to fit for."""

    C: float = 1.0
    penalty: str = "l2"
    loss: str = "squared_hinge"
    max_iter: int = 100
    tol: float = 1e-4

    @property
    def corners(self) -> tuple:
        return (None,) if self.loss == "squared_hinge" else CORNERS


def _sums(rows: DataFrame, tasks: int, points: list[tuple[int, np.ndarray, float | None]], curved: bool) -> list[tuple[float, np.ndarray, np.ndarray | None]]:
    """For each point (class, weights, corner; the last weight is the intercept): summed loss, gradient and, if wanted, curvature."""
    width = len(points[0][1])

    def add(batches):
        total = [[0.0, np.zeros(width), np.zeros((width, width)) if curved else None] for _ in points]
        for batch in batches:
            n = batch.num_rows
            x = np.concatenate((batch.column(0).flatten().to_numpy().reshape(n, width - 1), np.ones((n, 1))), axis=1)
            kind = batch.column(1).to_numpy()
            for own, (c, w, corner) in zip(total, points):
                sign = np.where(kind == c, 1.0, -1.0)
                loss, slope, curve = _losses(sign * (x @ w), corner)
                own[0] += float(loss.sum())
                own[1] += x.T @ (slope * sign)
                if curved:
                    some = curve > 0
                    own[2] += (x[some] * curve[some, None]).T @ x[some]
        lists = [np.concatenate(([t[0]], t[1], t[2].ravel() if curved else [])) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(points)), pa.int32()), pa.array(lists, pa.list_(pa.float64()))], ["p", "v"])

    parts = rows.select(vector_to_array("features").alias("x"), "class").mapInArrow(add, "p int, v array<double>")
    if tasks * len(points) * (1 + width + (width * width if curved else 0)) > GATHERED:
        parts = parts.groupBy("p").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    found: list = [0.0] * len(points)
    table = parts.toArrow()
    for k, v in zip(table["p"].to_pylist(), table["v"]):
        found[k] = found[k] + v.values.to_numpy()
    return [(v[0], v[1 : 1 + width], v[1 + width :].reshape(width, width) if curved else None) for v in found]


def _violation(w: np.ndarray, slope: np.ndarray, penalty: str) -> float:
    """The largest violation of optimality; ``slope`` is that of C times the loss."""
    inner = w[:-1]
    if penalty == "l2":
        gap = inner + slope[:-1]
    else:
        at_zero = np.maximum(np.abs(slope[:-1]) - 1.0, 0.0)
        gap = np.where(inner == 0, at_zero, slope[:-1] + np.sign(inner))
    return float(max(np.abs(gap).max(initial=0.0), abs(slope[-1])))


def _objective(w: np.ndarray, loss: float, C: float, penalty: str) -> float:
    return C * loss + (0.5 * float(w[:-1] @ w[:-1]) if penalty == "l2" else float(np.abs(w[:-1]).sum()))


def _newton(w: np.ndarray, slope: np.ndarray, curve: np.ndarray, penalty: str) -> np.ndarray:
    """The step to the minimum of the quadratic model plus the penalty; for l1 by coordinate descent."""
    width = len(w)
    curve = curve + 1e-9 * np.eye(width) * max(1.0, float(np.trace(curve)) / width)
    if penalty == "l2":
        ridge = np.append(np.ones(width - 1), 0.0)
        return -np.linalg.solve(curve + np.diag(ridge), slope + ridge * w)
    step, bent = np.zeros(width), np.zeros(width)
    for _ in range(300):
        moved = 0.0
        for j in range(width):
            h, g = curve[j, j], slope[j] + bent[j]
            if j == width - 1:
                new = step[j] - g / h
            else:
                at = w[j] + step[j] - g / h
                new = np.sign(at) * max(abs(at) - 1.0 / h, 0.0) - w[j]
            if new != step[j]:
                bent += curve[:, j] * (new - step[j])
                moved = max(moved, abs(new - step[j]))
                step[j] = new
        if moved < 1e-12:
            break
    return step


def _descent(w: np.ndarray, slope: np.ndarray, penalty: str, size: float) -> np.ndarray:
    """A proximal gradient step."""
    at = w - size * (slope + (np.append(w[:-1], 0.0) if penalty == "l2" else 0.0))
    if penalty == "l1":
        at[:-1] = np.sign(at[:-1]) * np.maximum(np.abs(at[:-1]) - size, 0.0)
    return at - w


class _Descent:
    """One class of one problem: the point it wants sums for next, until it is done."""

    def __init__(self, kind: int, problem: Problem, width: int, curved: bool):
        self.kind, self.problem, self.curved = kind, problem, curved
        self.weights, self.rounds, self.stage, self.size = np.zeros(width + 1), 0, 0, 1.0
        self.start, self.residual = None, np.inf
        self.tried, self.step, self.length = self.weights, None, 1.0

    def point(self) -> tuple[int, np.ndarray, float | None]:
        return self.kind, self.tried, self.problem.corners[self.stage]

    def told(self, sums: tuple) -> bool:
        """Take the sums at the wanted point; True while another point is wanted."""
        penalty, C = self.problem.penalty, self.problem.C
        if self.step is not None:
            before, after = _objective(self.weights, self.state[0], C, penalty), _objective(self.tried, sums[0], C, penalty)
            if not after < before - 1e-12 * abs(before):
                if self.length < 1e-6:  # no fall left that numbers can show
                    return self._next_stage()
                self.length /= 2 if self.curved else 8
                self.tried = self.weights + self.length * self.step
                return True
            self.size *= 2.0 if self.length == 1.0 else self.length
            self.rounds += 1
        self.weights, self.state = self.tried, sums
        slope = C * sums[1]
        self.residual = _violation(self.weights, slope, penalty)
        self.start = max(self.residual, 1e-300) if self.start is None else self.start
        if self.residual <= self.problem.tol * self.start:
            return self._next_stage()
        if self.rounds >= self.problem.max_iter:
            return False
        step = _newton(self.weights, slope, C * sums[2], penalty) if self.curved else _descent(self.weights, slope, penalty, self.size)
        self.step = step * min(1.0, REACH / max(float(np.abs(step).max()), 1e-300))
        self.length, self.tried = 1.0, self.weights + self.step
        return True

    def _next_stage(self) -> bool:
        self.stage += 1
        self.step, self.tried, self.size = None, self.weights, 1.0
        return self.stage < len(self.problem.corners)


def fit_margins(rows: DataFrame, classes: list[int], width: int, problems: list[Problem]) -> list[tuple[dict[int, np.ndarray], Report]]:
    """Weights per class and a report for each problem. Minimises the penalty (half the squared norm, or the absolute sum; never of the
    intercept) plus C times the summed loss by (proximal) Newton steps, halved until the objective falls. All problems and classes
    move on together: a pass over the rows serves each one's next point."""
    curved, tasks = width <= EXACT_WIDTH, rows.rdd.getNumPartitions()
    every = [[_Descent(c, p, width, curved) for c in classes] for p in problems]
    live = [d for group in every for d in group]
    while live:
        found = _sums(rows, tasks, [d.point() for d in live], curved)
        live = [d for d, sums in zip(live, found) if d.told(sums)]
    out = []
    for problem, group in zip(problems, every):
        share = max(d.residual / d.start for d in group)
        report = Report(max(d.rounds for d in group), share, share <= max(problem.tol, 1e-6))
        out.append(({d.kind: d.weights for d in group}, report))
    return out
