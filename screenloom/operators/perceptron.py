"""A perceptron with rectified layers and an L2 term, trained by Adam on mini-batches.

A step deals the rows into ``batches`` parts by a hash of their id and the epoch and takes one of them: tasks run Arrow batches
forward and backward through the layers, in single precision and added up in double, and the sums of gradients and losses are added up as a tree. Parameters, a few
thousand numbers, go out with the tasks. Fits on all rows and on the rows outside each fold take the same steps side by side,
so cross-validation costs no further job. A fit ends when its loss has not fallen for ``patience`` epochs; the parameters after its
best epoch count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.operators.passes import packed, total, unpacked

_BLOCK = 2048  # rows packed together
_ROWS = 1024  # rows run through the layers at once: what the layers put out stays in the cache of a core
_TYPES = {"id": "<i8", "label": "<f8", "fold": "<i4", "features": "<f8"}


@dataclass(frozen=True)
class Settings:
    """Layers, the L2 term and the share of Adam's moments; the number of steps is for large batches."""

    hidden: tuple[int, ...] = (128, 64)
    l2: float = 0.01
    rate: float = 0.005
    epochs: int = 200
    batches: int = 2
    first: float = 0.9
    second: float = 0.999
    tolerance: float = 1e-4
    patience: int = 10
    seed: int = 42


class Layers:
    """Weights and offsets of all layers in one array."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.shapes = [(a, b) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        self.size = sum(a * b + b for a, b in self.shapes)

    def begin(self, seed: int) -> np.ndarray:
        """Even numbers within a bound that follows the number of inputs and outputs of a layer."""
        rng, parts = np.random.default_rng(seed), []
        for a, b in self.shapes:
            bound = np.sqrt((6.0 if b != 1 else 2.0) / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return np.concatenate(parts)

    def split(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        at, found = 0, []
        for a, b in self.shapes:
            found.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return found

    def penalty(self, flat: np.ndarray) -> np.ndarray:
        """The parameters under the L2 term: weights, no offsets."""
        kept = np.zeros_like(flat)
        for (weights, _), (source, _) in zip(self.split(kept), self.split(flat), strict=True):
            weights[:] = source
        return kept

    def margins(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        parts = self.split(flat)
        for weights, offset in parts[:-1]:
            x = np.maximum(x @ weights + offset, 0.0)
        return (x @ parts[-1][0] + parts[-1][1])[:, 0]

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """The sum of the gradients of the logistic loss over rows, and the sum of the loss. Layers run in the precision of ``flat``
        and ``x``, the loss in double."""
        parts, outputs = self.split(flat), [x]
        for weights, offset in parts[:-1]:
            out = outputs[-1] @ weights
            out += offset
            outputs.append(np.maximum(out, 0, out=out))
        margin = (outputs[-1] @ parts[-1][0] + parts[-1][1])[:, 0].astype(float)
        loss = float((np.logaddexp(0, margin) - y * margin).sum())
        back = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y)[:, None].astype(flat.dtype)
        result = np.empty_like(flat)
        for k, (weights, offset) in reversed(list(enumerate(self.split(result)))):
            np.matmul(outputs[k].T, back, out=weights)
            offset[:] = back.sum(axis=0)
            if k:
                back = back * parts[k][0][:, 0] if back.shape[1] == 1 else back @ parts[k][0].T
                back *= outputs[k] > 0
        return result, loss


@dataclass
class Perceptron:
    sizes: list[int]
    flat: np.ndarray

    def score(self, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(Layers(self.sizes).margins(self.flat, values), -500, 500)))

    def to_json(self) -> str:
        return json.dumps({"sizes": self.sizes, "flat": self.flat.tolist()})

    @classmethod
    def from_json(cls, text: str) -> Perceptron:
        known = json.loads(text)
        return cls(known["sizes"], np.array(known["flat"]))


class Adam:
    def __init__(self, size: int, s: Settings):
        self.s, self.step, self.mean, self.square = s, 0, np.zeros(size), np.zeros(size)

    def move(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        s = self.s
        self.step += 1
        self.mean = s.first * self.mean + (1 - s.first) * gradient
        self.square = s.second * self.square + (1 - s.second) * gradient**2
        rate = s.rate * np.sqrt(1 - s.second**self.step) / (1 - s.first**self.step)
        return flat - rate * self.mean / (np.sqrt(self.square) + 1e-8)


def batch_of(ids: np.ndarray, epoch: int, batches: int, seed: int) -> np.ndarray:
    """The part each row falls into in an epoch."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((epoch + 1) * 0xD1B54A32D192ED03 + seed & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(batches)).astype(np.int64)


def fit(rows: DataFrame, settings: Settings | None = None, folds: int = 0) -> list[Perceptron]:
    """The perceptron fitted on all rows, then for each fold the one fitted on the rows outside it.

    ``rows``: id (a long of its own for each row), label (0 or 1), features (array of doubles, one width) and, with folds, fold
    (0 to folds - 1). Without rows a fit keeps its first parameters.
    """
    s = settings or Settings()
    fits = folds + 1
    fold = F.col("fold").cast("int") if folds else F.lit(-1)
    given = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("double").alias("label"), fold.alias("fold"), "features")
    width = given.select(F.size("features").alias("n")).first()
    layers = Layers([width["n"] if width else 0, *s.hidden, 1])
    flat = np.tile(layers.begin(s.seed), (fits, 1))
    if width is None:
        return [Perceptron(layers.sizes, f) for f in flat]
    table = packed(given, "rows", _arrays, list(_TYPES), _BLOCK)
    movers = [Adam(layers.size, s) for _ in range(fits)]
    best, best_loss, idle = flat.copy(), np.full(fits, np.inf), np.zeros(fits, int)
    for epoch in range(s.epochs):
        losses, counts = np.zeros(fits), np.zeros(fits)
        active = np.flatnonzero(idle < s.patience)
        for batch in range(s.batches):
            sums = total(table, _work(layers, flat, active, epoch, batch, s), (fits, layers.size + 2))
            for m in active:
                n = max(sums[m, -1], 1.0)
                gradient = sums[m, :-2] / n + s.l2 / n * layers.penalty(flat[m])
                losses[m] += sums[m, -2] + s.l2 / 2 * (layers.penalty(flat[m]) ** 2).sum()
                counts[m] += sums[m, -1]
                flat[m] = movers[m].move(flat[m], gradient)
        for m in active:
            loss = losses[m] / max(counts[m], 1.0)
            if loss < best_loss[m] - s.tolerance:
                idle[m] = 0
            else:
                idle[m] += 1
            if loss < best_loss[m]:
                best_loss[m], best[m] = loss, flat[m]
        if (idle >= s.patience).all():
            break
    table.release()
    return [Perceptron(layers.sizes, f) for f in best]


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    found = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "fold")}
    found["features"] = batch.column("features").flatten().to_numpy(zero_copy_only=False)
    return {c: found[c].astype(t) for c, t in _TYPES.items()}


def _work(layers: Layers, flat: np.ndarray, active: np.ndarray, epoch: int, batch: int, s: Settings):
    fits, single = len(flat), flat.astype(np.float32)

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((fits, layers.size + 2))
        for ids, labels, fold, features in unpacked(batches, _TYPES):
            here = np.flatnonzero(batch_of(ids, epoch, s.batches, s.seed) == batch)
            x, y, fold = features.reshape(len(ids), -1)[here].astype(np.float32), labels[here], fold[here]
            for m in active:
                use = np.flatnonzero(fold != m - 1) if m else np.arange(len(here))
                for at in range(0, len(use), _ROWS):
                    some = use[at : at + _ROWS]
                    gradient, loss = layers.gradient(single[m], x[some], y[some])
                    sums[m, :-2] += gradient
                    sums[m, -2] += loss
                sums[m, -1] += len(use)
        return sums

    return work
