"""Regularised boosting: second-order trees on histograms, several fits in one pass.

Features are cut into quantile bins once. A tree grows level by level: one pass over the rows sums gradients and hessians of
the logistic loss for every (node, feature, bin), and the best cut of each node is read off the sums. A cut's worth and a
leaf's value carry an L1 and an L2 term. Each tree sees a share of the rows, chosen by a hash of the row's id, and a share
of the features. A last tree level needs no pass of its own, as a cut's sums are those of its two sides. Below the root only
the lighter side of each cut is summed; the other one is what remains of their parent.

Fits on all rows and on the rows outside each fold grow side by side: the pass is the same, with sums for each of them. So
cross-validation costs no further job. Rows are kept as blocks of bytes with their margins, to which each tree is added once; every
``REFRESH`` trees they are written down.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.operators.passes import Held, packed, total, unpacked
from screenloom.session import stage

REFRESH = 10
_BLOCK = 4096  # rows packed together
_TYPES = {"id": "<i8", "label": "<f8", "fold": "<i4", "bins": "u1", "margins": "<f8"}
_SAME = 1e-9  # gains this close are equal: what remains of a parent is not exact to the last bit


@dataclass(frozen=True)
class Settings:
    """The hyper-parameters."""

    trees: int = 200
    depth: int = 4
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 2.0
    l1: float = 0.5
    least_hessian: float = 1.0
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: the feature and the last bin of the left side (feature -1: no cut), and the value of each."""

    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node each row has reached after ``levels`` levels."""
        node, begin, flat = np.zeros(len(bins), np.int64), np.arange(len(bins)) * bins.shape[1], bins.reshape(-1)
        for _ in range(levels):
            feature = self.feature[node]
            below = 2 * node + 1 + (flat[begin + np.maximum(feature, 0)] > self.last[node])
            node = np.where(feature >= 0, below, node)
        return node

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.places(bins, int(np.log2(len(self.feature) + 1)) - 1)]


@dataclass
class Ensemble:
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """The bin of each value: how many cuts lie below it. What is no number falls into the first."""
        return np.stack([np.searchsorted(c, np.nan_to_num(values[:, k], nan=-np.inf)) for k, c in enumerate(self.cuts)], axis=1)

    def score(self, values: np.ndarray) -> np.ndarray:
        bins = self.bins(values) if len(values) else np.zeros((0, len(self.cuts)), np.int64)
        margin = np.zeros(len(values))
        for tree in self.trees:
            margin += tree.margins(bins)
        return 1 / (1 + np.exp(-margin))


    def to_json(self) -> str:
        trees = [[t.feature.tolist(), t.last.tolist(), t.value.tolist()] for t in self.trees]
        return json.dumps({"cuts": [c.tolist() for c in self.cuts], "trees": trees})

    @classmethod
    def from_json(cls, text: str) -> Ensemble:
        known = json.loads(text)
        trees = [Tree(np.array(f), np.array(last), np.array(v)) for f, last, v in known["trees"]]
        return cls([np.array(c, float) for c in known["cuts"]], trees)


# ---- cuts -------------------------------------------------------------------------------------------------------


def shrunk(gradient: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0.0)


def leaf(gradient: np.ndarray, hessian: np.ndarray, s: Settings) -> np.ndarray:
    return -s.rate * shrunk(gradient, s.l1) / (hessian + s.l2)


def best_cuts(gradient: np.ndarray, hessian: np.ndarray, columns: np.ndarray, s: Settings) -> list[tuple | None]:
    """For each node of sums (node, feature, bin) the cut (feature, last bin, sums of the left, sums of the right) that gains
    most, the first of equal ones; None where none gains."""
    found = []
    worth = lambda g, h: shrunk(g, s.l1) ** 2 / (h + s.l2)
    for g, h in zip(gradient, hessian, strict=True):
        whole_g, whole_h = g[columns[0]].sum(), h[columns[0]].sum()
        left_g, left_h = np.cumsum(g[columns], axis=1)[:, :-1], np.cumsum(h[columns], axis=1)[:, :-1]
        right_g, right_h = whole_g - left_g, whole_h - left_h
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = worth(left_g, left_h) + worth(right_g, right_h) - worth(whole_g, whole_h)
        gain[(left_h < s.least_hessian) | (right_h < s.least_hessian)] = -np.inf
        if not gain.size or not gain.max() > 1e-9:
            found.append(None)
            continue
        at = int((gain.ravel() >= gain.max() - _SAME).argmax())
        k, b = np.unravel_index(at, gain.shape)
        found.append((int(columns[k]), int(b), (left_g[k, b], left_h[k, b]), (right_g[k, b], right_h[k, b])))
    return found


def sampled(ids: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Whether each row takes part in a tree, by a hash of its id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree + 1) * 0xD1B54A32D192ED03 + seed & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(int(share * 2**64), 2**64 - 1))


def tree_columns(tree: int, width: int, s: Settings) -> np.ndarray:
    """The features of a tree, ascending."""
    chosen = np.random.default_rng([s.seed, tree]).permutation(width)[: max(1, round(s.column_share * width))]
    return np.sort(chosen)


# ---- on Spark ---------------------------------------------------------------------------------------------------


def quantile_cuts(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Up to ``bins - 1`` values of each feature, ascending."""
    width = rows.select(F.size("features").alias("n")).first()
    if width is None:
        return []
    shares = [k / bins for k in range(1, bins)]
    columns = [F.percentile_approx(F.nanvl(F.col("features")[k], F.lit(None)), shares, 20 * bins).alias(f"x{k}") for k in range(width["n"])]
    found = rows.agg(*columns).first()
    return [np.unique(np.array(v or [], float)) for v in found]


def _blocks(batches: Iterator[pa.RecordBatch], width: int, fits: int) -> Iterator[tuple]:
    """ids, labels, fold, bins (row, feature) and margins (fit, row) of each block."""
    for ids, labels, fold, bins, margins in unpacked(batches, _TYPES):
        yield ids, labels, fold, bins.reshape(-1, width), margins.reshape(fits, -1)


def fit(rows: DataFrame, settings: Settings | None = None, folds: int = 0) -> list[Ensemble]:
    """The ensemble fitted on all rows, then for each fold the one fitted on the rows outside it.

    ``rows``: id (a long of its own for each row), label (0 or 1), features (array of doubles, one width) and, with folds, fold
    (0 to folds - 1). Without rows, or with one label only, the margins stay at what the sums give: no cut gains anything.
    """
    s = settings or Settings()
    if s.bins > 256:
        raise ValueError("a bin is one byte")
    fits = folds + 1
    fold = F.col("fold").cast("int") if folds else F.lit(-1)
    given = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("double").alias("label"), fold.alias("fold"), "features")
    cuts = quantile_cuts(given, s.bins)
    ensembles = [Ensemble(cuts) for _ in range(fits)]
    width = len(cuts)
    if not width:
        return ensembles

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        found = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "fold")}
        values = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        found |= {"bins": ensembles[0].bins(values), "margins": np.zeros(fits * len(batch))}
        return {c: found[c].astype(t) for c, t in _TYPES.items()}

    table = packed(given, "binned", arrays, list(_TYPES), _BLOCK)
    for number in range(s.trees):
        growing = _grown(table, number, width, fits, s)
        for ensemble, tree in zip(ensembles, growing, strict=True):
            ensemble.trees.append(tree)
        if number + 1 < s.trees:
            table = _with_margins(table, growing, width, fits, (number + 1) % REFRESH == 0)
    table.release()
    return ensembles


def _grown(table: Held, number: int, width: int, fits: int, s: Settings) -> list[Tree]:
    """The next tree of each fit, a pass over the rows a level."""
    columns = tree_columns(number, width, s)
    growing = [Tree.empty(s.depth) for _ in range(fits)]
    slots, sums = [np.zeros(1, np.int64)] * fits, [None] * fits  # the place of each node among the summed ones, or -1
    for level in range(s.depth):
        nodes = 2**level
        shape = (fits, 2, max(1, nodes // 2), width, s.bins)
        found = total(table, _level(growing, slots, level, number, columns, shape, s), shape)
        for m, tree in enumerate(growing):
            sums[m] = _both_sides(sums[m], found[m], slots[m]) if level else found[m]
            slots[m] = np.full(2 * nodes, -1)
            for k, cut in enumerate(best_cuts(sums[m][0], sums[m][1], columns, s)):
                node = nodes - 1 + k
                if not level:
                    tree.value[0] = leaf(sums[m][0, 0, columns[0]].sum(), sums[m][1, 0, columns[0]].sum(), s)
                if cut is not None and (not level or tree.feature[(node - 1) // 2] >= 0):
                    tree.feature[node], tree.last[node] = cut[0], cut[1]
                    for side, (g, h) in enumerate(cut[2:]):
                        tree.value[2 * node + 1 + side] = leaf(g, h, s)
                    slots[m][2 * k + int(cut[3][1] < cut[2][1])] = k
    return growing


def _both_sides(parents: np.ndarray, summed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The sums (2, node, feature, bin) of a level from those of its parents and of one side of each cut; zero below no cut."""
    every = np.zeros((2, len(slots), *summed.shape[2:]))
    for node in np.flatnonzero(slots >= 0):
        every[:, node] = summed[:, slots[node]]
        every[:, node ^ 1] = parents[:, node // 2] - summed[:, slots[node]]
    return every


def _level(growing: list[Tree], slots: list[np.ndarray], level: int, number: int, columns: np.ndarray, shape: tuple, s: Settings):
    fits, _, sides, width, _ = shape

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((fits, 2, sides * width * s.bins))
        for ids, labels, fold, bins, margins in _blocks(batches, width, fits):
            part = sampled(ids, number, s.row_share, s.seed)
            base = columns * s.bins + bins[:, columns]
            for m in range(fits):
                node = growing[m].places(bins, level) - (2**level - 1)
                slot = np.where(node >= 0, slots[m][np.maximum(node, 0)], -1)
                use = np.flatnonzero(part & (fold != m - 1) & (slot >= 0) if m else part & (slot >= 0))
                p = 1 / (1 + np.exp(-margins[m, use]))
                place = (base[use] + (slot[use] * (width * s.bins))[:, None]).ravel()
                for k, weight in enumerate((p - labels[use], p * (1 - p))):
                    sums[m, k] += np.bincount(place, np.repeat(weight, len(columns)), minlength=sums.shape[2])
        return sums.reshape(shape)

    return work


def _with_margins(table: Held, trees: list[Tree], width: int, fits: int, written: bool) -> Held:
    """The blocks with a tree of each fit added to their margins, kept in memory and, if so wanted, written down."""
    names = list(_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                *_, bins, margins = next(_blocks(iter([one]), width, fits))
                after = np.stack([margins[m] + trees[m].margins(bins) for m in range(fits)])
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in names[:-1]), pa.array([after.tobytes()], pa.binary())], names=names)

    rows = table.rows.mapInArrow(run, ", ".join(f"{c} binary" for c in names))
    if written:
        rows = stage(rows, "margins")
    rows.persist().count()
    table.release()
    return Held(rows, rows.rdd.getNumPartitions() if written else table.parts)
