"""Linear classifiers by Newton steps, all folds in one pass.

Losses of linear models need little from the rows: one pass sums, for every fit, the loss, its gradient and its curvature (a
small matrix) at the present weights. The driver solves the small systems; a step that does not lower the loss is halved. Fits
on all rows, on the rows outside each fold, and on the inner folds of a calibration move side by side in the same passes, a
dozen or two in all, each to its minimum.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.operators import metrics as mt
from screenloom.operators.passes import Held, held, total

TOLERANCE = 1e-8  # of the decrease of the loss that a full step promises, in parts of the loss
_STEPS = 100
_ROWS = 8192
Losses = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]  # of margins and labels


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def logistic_loss(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of each row; ``y`` may lie between 0 and 1."""
    p = sigmoid(margin)
    return np.logaddexp(0, margin) - y * margin, p - y, p * (1 - p)


def squared_hinge(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sign = np.where(y > 0, 1.0, -1.0)
    short = np.maximum(0.0, 1 - sign * margin)
    return short**2, -2 * sign * short, 2.0 * (short > 0)


@dataclass
class Linear:
    """Probability by a sigmoid of the margin; the last weight is the intercept."""

    weights: np.ndarray

    def score(self, values: np.ndarray) -> np.ndarray:
        return sigmoid(values @ self.weights[:-1] + self.weights[-1]) if len(values) else np.zeros(0)

    def to_json(self) -> str:
        return json.dumps(self.weights.tolist())

    @classmethod
    def from_json(cls, text: str) -> Linear:
        return cls(np.array(json.loads(text)))


@dataclass
class Calibrated:
    """Margins of several fits, each through a sigmoid of its own (slope, offset); probabilities are averaged."""

    weights: np.ndarray
    sigmoids: np.ndarray

    def score(self, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return np.zeros(0)
        margins = values @ self.weights[:, :-1].T + self.weights[:, -1]
        return sigmoid(margins * self.sigmoids[:, 0] + self.sigmoids[:, 1]).mean(axis=1)

    def to_json(self) -> str:
        return json.dumps([self.weights.tolist(), self.sigmoids.tolist()])

    @classmethod
    def from_json(cls, text: str) -> Calibrated:
        return cls(*(np.array(part) for part in json.loads(text)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Features with a column of ones, labels, folds and inner folds."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            part = batch.slice(at, _ROWS)
            x = part.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            columns = [part.column(c).to_numpy() for c in ("label", "fold", "inner")]
            yield np.hstack([x, np.ones((len(part), 1))]), *columns


def newton(sums: Callable[[np.ndarray, np.ndarray], np.ndarray], begin: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """The minimum of each fit's loss plus ``ridge * w^2 / 2``. ``sums(weights, active)`` gives for each fit the loss, the
    gradient and the curvature in one row."""
    fits, size = begin.shape
    here, step = begin.copy(), np.zeros_like(begin)
    least, active = np.full(fits, np.inf), np.arange(fits)
    base = begin.copy()
    for _ in range(_STEPS):
        found = sums(here, active)
        for m in active.tolist():
            w = here[m]
            loss = found[m, 0] + (ridge * w**2).sum() / 2
            if loss > least[m] + 1e-12 * abs(least[m]):
                step[m] /= 2
                here[m] = base[m] + step[m]
                if np.abs(step[m]).max() < 1e-12 * max(1.0, np.abs(base[m]).max()):
                    here[m] = base[m]
                    active = active[active != m]
                continue
            gradient = found[m, 1 : size + 1] + ridge * w
            curve = found[m, size + 1 :].reshape(size, size) + np.diag(ridge)
            step[m] = -np.linalg.lstsq(curve, gradient, rcond=None)[0]
            base[m], least[m] = w, loss
            if -(gradient @ step[m]) <= TOLERANCE * max(1.0, abs(loss)):
                active = active[active != m]
                continue
            here[m] = base[m] + step[m]
        if not len(active):
            break
    return base


def _newton_on(table: Held, outside: Callable, fits: int, size: int, loss: Losses, weight: float, ridge: np.ndarray) -> np.ndarray:
    """Weights of all fits over the rows that ``outside(fit, fold, inner)`` takes in."""

    def sums(weights: np.ndarray, active: np.ndarray) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            found = np.zeros((fits, 1 + size + size * size))
            for x, y, fold, inner in _parts(batches):
                for m in active.tolist():
                    use = outside(m, fold, inner)
                    rows = x[use]
                    value, slope, curve = loss(rows @ weights[m], y[use])
                    found[m, 0] += weight * value.sum()
                    found[m, 1 : size + 1] += weight * (slope @ rows)
                    found[m, size + 1 :] += weight * ((rows * curve[:, None]).T @ rows).ravel()
            return found

        return total(table, work, (fits, 1 + size + size * size))

    return newton(sums, np.zeros((fits, size)), ridge)


def _table(rows: DataFrame, folds: int, inner: int, seed: int) -> tuple[Held, int]:
    """Rows kept for the passes, with an inner fold where asked for, and the number of weights."""
    width = rows.select(F.size("features").alias("n")).first()
    dealt = mt.stratified_folds(rows.withColumnRenamed("fold", "_outer"), "id", "label", inner, seed) if inner else rows
    given = dealt.select(
        F.col("label").cast("double").alias("label"),
        (F.col("_outer" if inner else "fold").cast("int") if folds else F.lit(-1)).alias("fold"),
        (F.col("fold").cast("int") if inner else F.lit(-1)).alias("inner"),
        "features",
    )
    return held(given, "rows"), (width["n"] if width else 0) + 1


def fit_logistic(rows: DataFrame, c: float = 0.5, folds: int = 0) -> list[Linear]:
    """Logistic regression on all rows, then on the rows outside each fold: the sum of losses times ``c`` plus half the squared
    weights; the intercept is free. ``rows``: id, label (0 or 1), features (array of doubles) and, with folds, fold."""
    table, size = _table(rows, folds, 0, 0)
    ridge = np.append(np.ones(size - 1), 0.0)
    weights = _newton_on(table, _outside_fold, folds + 1, size, logistic_loss, c, ridge)
    table.release()
    return [Linear(w) for w in weights]


def _outside_fold(m: int, fold: np.ndarray, inner: np.ndarray) -> np.ndarray:
    return fold != m - 1 if m else np.ones(len(fold), bool)


def fit_calibrated_svc(rows: DataFrame, c: float = 0.3, folds: int = 0, inner: int = 5, seed: int = 42) -> list[Calibrated]:
    """Linear support vectors with probabilities, on all rows and on the rows outside each fold.

    Each of them is ``inner`` fits on the rows outside an inner fold (squared hinge times ``c`` plus half the squared weights,
    intercept included), with a sigmoid fitted to the margins of that inner fold; its targets are pulled in as if each label had
    one row more of either kind. The inner folds of all fits are the same split.
    """
    table, size = _table(rows, folds, inner, seed + 1)
    fits = (folds + 1) * inner

    def training(m: int, fold: np.ndarray, part: np.ndarray) -> np.ndarray:
        return _outside_fold(m // inner, fold, part) & (part != m % inner)

    weights = _newton_on(table, training, fits, size, squared_hinge, c, np.ones(size))

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        found = np.zeros((fits, 2))
        for _, y, fold, part in _parts(batches):
            for m in range(fits):
                use = _outside_fold(m // inner, fold, part) & (part == m % inner)
                found[m] += (y[use] <= 0).sum(), (y[use] > 0).sum()
        return found

    number = total(table, counts, (fits, 2))
    target = np.stack([1 / (number[:, 0] + 2), (number[:, 1] + 1) / (number[:, 1] + 2)], axis=1)

    def sums(curves: np.ndarray, active: np.ndarray) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            found = np.zeros((fits, 7))
            for x, y, fold, part in _parts(batches):
                for m in active.tolist():
                    use = _outside_fold(m // inner, fold, part) & (part == m % inner)
                    margin = np.stack([x[use] @ weights[m], np.ones(use.sum())], axis=1)
                    value, slope, curve = logistic_loss(margin @ curves[m], np.where(y[use] > 0, target[m, 1], target[m, 0]))
                    found[m] += [value.sum(), *(slope @ margin), *((margin * curve[:, None]).T @ margin).ravel()]
            return found

        return total(table, work, (fits, 7))

    curves = newton(sums, np.tile([1.0, 0.0], (fits, 1)), np.zeros(2))
    table.release()
    groups = range(0, fits, inner)
    return [Calibrated(weights[k : k + inner], curves[k : k + inner]) for k in groups]
