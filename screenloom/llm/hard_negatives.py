"""Hard-negative mining: rotated one-bit codes with intervals that cannot miss, then integer scores.

Vectors are scaled to integers, rotated by a seeded orthogonal matrix and coded by the signs of their coordinates; further
layers code the signs of what the layers before left over. With each row are stored its codes, their alignments (the
least-squares weights that rebuild the vector from its codes), the norm of the rebuilt vector and that of the residual.

An anchor's rotated vector is cut into bit planes. Popcounts of planes and codes give its product with the rebuilt vector.
The rest of the true product is bounded without chance: the residual is orthogonal to the rebuilt vector, so by
Cauchy-Schwarz it adds at most the residual's norm times the norm of the part of the anchor across the rebuilt vector, and the
rounding of the planes at most its own norm times the rebuilt vector's. A row whose interval cannot reach the wanted places or
the wanted band is discarded; all others are scored in 64-bit integers. Results are therefore exact.

Anchors and rows are dealt by hashes into a grid of cells of bounded size, one anchor block against one row block each. Labels
play no part in the dealing, so a label with a large share of all rows meets in no single task. Cells return at most the wanted
number of rows per anchor or (anchor, positive), and ranks are cut again before the last shuffle.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom.session import stage

LAYERS = 3  # one-bit codes per vector
PLANES = 6  # bits per coordinate of an anchor
ROWS = 8192  # vectors of a cell
ANCHORS = 2048  # anchors of a cell
_TILE = 1 << 19  # (anchor, row) pairs looked at together
_NORM = 2.0**56  # squared integer norms below this leave room for 100 times any score in a long
_INDEX = "vec_id long, label int, ints binary, codes binary, fits binary"


@functools.lru_cache(maxsize=4)
def rotation(width: int) -> np.ndarray:
    """A seeded orthogonal matrix; its rows map ``width`` coordinates to a multiple of 64."""
    size = max(64, -(-width // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(20).normal(size=(size, size)))
    return (q * np.sign(np.diag(r)))[:width]


def _packed(bits: np.ndarray) -> np.ndarray:
    """The last axis, a multiple of 64 booleans, as 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def encode(ints: np.ndarray, layers: int = LAYERS) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, layers, words) and fits (rows, layers + 2): alignments, rebuilt norm, residual norm."""
    turned = ints.astype(float) @ rotation(ints.shape[1])
    n, size = turned.shape
    left, signs = turned, np.empty((n, layers, size))
    for layer in range(layers):
        signs[:, layer] = np.where(left >= 0, 1.0, -1.0) / math.sqrt(size)
        left = left - (left * signs[:, layer]).sum(axis=1, keepdims=True) * signs[:, layer]
    gram = signs @ signs.transpose(0, 2, 1)
    align = np.linalg.pinv(gram, hermitian=True) @ (signs @ turned[:, :, None])
    rebuilt = (align * signs).sum(axis=1)
    norms = [np.linalg.norm(rebuilt, axis=1), np.linalg.norm(turned - rebuilt, axis=1)]
    return _packed(signs > 0), np.column_stack([align[:, :, 0], *norms])


@dataclass
class Vectors:
    ids: np.ndarray
    labels: np.ndarray
    ints: np.ndarray
    codes: np.ndarray
    fits: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, layers: int) -> Vectors:
        n = table.num_rows
        blob = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind).reshape(n, -1)
        ids, labels = (table[c].to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        return cls(ids, labels, blob("ints", "<i8"), blob("codes", "<u8").reshape(n, layers, -1), blob("fits", "<f8"))

    def take(self, at: np.ndarray) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.ints[at], self.codes[at], self.fits[at])


def intervals(anchors: np.ndarray, rows: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above the products of integer ``anchors`` (a row each) and all ``rows``, from codes alone."""
    turned = anchors.astype(float) @ rotation(anchors.shape[1])
    size = turned.shape[1]
    low = turned.min(axis=1, keepdims=True)
    step = (turned.max(axis=1, keepdims=True) - low) / (2**PLANES - 1)
    step[step == 0] = 1.0
    grid = np.rint((turned - low) / step)
    rounded = low + step * grid
    off = np.linalg.norm(turned - rounded, axis=1)[:, None]
    norm = np.linalg.norm(turned, axis=1)[:, None]
    planes = [_packed((grid.astype(np.int64) >> bit) & 1 > 0) for bit in range(PLANES)]
    layers = rows.codes.shape[1]
    middle = np.zeros((len(anchors), len(rows.ids)))
    for layer in range(layers):
        code = rows.codes[:, layer]
        count = np.zeros(middle.shape, np.int32)
        for bit, plane in enumerate(planes):
            for word in range(code.shape[1]):
                count += np.bitwise_count(plane[:, None, word] & code[None, :, word]).astype(np.int32) << bit
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)[None, :]
        product = (2 * (low * ones + step * count) - rounded.sum(axis=1, keepdims=True)) / math.sqrt(size)
        middle += rows.fits[None, :, layer] * product
    rebuilt, residual = rows.fits[None, :, layers], rows.fits[None, :, layers + 1]
    along = np.maximum(np.abs(middle) - off * rebuilt, 0) / np.where(rebuilt > 0, rebuilt, 1.0)
    half = off * rebuilt + np.sqrt(np.maximum(norm**2 - along**2, 0)) * residual
    half += 1e-9 * norm * (rebuilt + residual) + 1e-6  # rounding of doubles
    return middle - half, middle + half


def scores(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer products of the pairs (``anchors[a]``, ``rows[r]``)."""
    found = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1 << 15):
        part = slice(at, at + (1 << 15))
        found[part] = (anchors[a[part]] * rows[r[part]]).sum(axis=1)
    return found


def _least_place(bounds: np.ndarray, wanted: int) -> np.ndarray:
    """The ``wanted``-th greatest of each row; minus infinity where there are fewer."""
    if bounds.shape[1] < wanted:
        return np.full((len(bounds), 1), -np.inf)
    return np.partition(bounds, bounds.shape[1] - wanted, axis=1)[:, [bounds.shape[1] - wanted]]


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, wanted: int) -> np.ndarray:
    """Places of the first ``wanted`` of each group, by falling score and then by id."""
    order = np.lexsort((ids, -score, group))
    heads = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])[: len(order)])
    rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order[rank < wanted]


def best_of_label(anchors: Vectors, rows: Vectors, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor id, row id, score): the first other rows of each anchor's own label."""
    found = [(np.zeros(0, np.int64),) * 3]
    for label in np.unique(anchors.labels):
        near = rows.take(np.flatnonzero(rows.labels == label))
        mine = np.flatnonzero(anchors.labels == label)
        step = max(1, _TILE // max(1, len(near.ids)))
        for at in range(0, len(mine) if len(near.ids) else 0, step):
            own = anchors.take(mine[at : at + step])
            low, high = intervals(own.ints, near)
            other = own.ids[:, None] != near.ids[None, :]
            low[~other] = -np.inf
            a, r = np.nonzero((high >= _least_place(low, wanted)) & other)
            score = scores(own.ints, near.ints, a, r)
            top = _first(a, score, near.ids[r], wanted)
            found.append((own.ids[a[top]], near.ids[r[top]], score[top]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def best_in_bands(
    anchors: Vectors, positives: list[list[tuple[int, int]]], rows: Vectors, wanted: int, band: tuple[int, int]
) -> tuple[np.ndarray, ...]:
    """(anchor id, positive id, positive score, row id, score): the first rows of other labels whose score lies within
    ``band`` per cent of the positive's."""
    found = [(np.zeros(0, np.int64),) * 5]
    step = max(1, _TILE // max(1, len(rows.ids)))
    for at in range(0, len(anchors.ids) if len(rows.ids) else 0, step):
        part = np.arange(at, min(at + step, len(anchors.ids)))
        own, known = anchors.take(part), [positives[i] for i in part]
        low, high = intervals(own.ints, rows)
        other = own.labels[:, None] != rows.labels[None, :]
        wide = max(map(len, known), default=0)
        reach = np.zeros(other.shape, bool)
        for k in range(wide):
            score = np.array([p[k][1] if k < len(p) else 0 for p in known], float)[:, None]
            there = np.array([k < len(p) for p in known])[:, None] & other
            floor, top = score * (band[0] / 100), score * (band[1] / 100)
            sure = there & (low >= floor + 1e-6) & (high <= top - 1e-6)
            least = _least_place(np.where(sure, low, -np.inf), wanted)
            reach |= there & (high >= np.maximum(floor - 1e-6, least)) & (low <= top + 1e-6)
        a, r = np.nonzero(reach)
        score = scores(own.ints, rows.ints, a, r)
        for k in range(wide):
            goal = np.array([p[k] if k < len(p) else (0, 0) for p in known], np.int64).reshape(-1, 2)[a]
            there = np.array([k < len(p) for p in known])[a]
            inside = np.flatnonzero(there & (band[0] * goal[:, 1] <= 100 * score) & (100 * score <= band[1] * goal[:, 1]))
            top = inside[_first(a[inside], score[inside], rows.ids[r[inside]], wanted)]
            found.append((own.ids[a[top]], goal[top, 0], goal[top, 1], rows.ids[r[top]], score[top]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# ---- on Spark ---------------------------------------------------------------------------------------------------


def build_index(vectors: DataFrame, vec_id: str, label: str, embedding: str, scale: int, layers: int) -> tuple[DataFrame, int]:
    """The coded rows that take part, written once, and their width."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    good = rows.where("vec_id is not null and label is not null and v is not null").where(~bad)
    single = good.groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")
    common = good.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = common["width"] if common else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                lists = part.column("v")
                part = part.filter(pa.compute.equal(pa.compute.list_value_length(lists), width))
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                whole = np.floor(scale * flat)
                fits = (whole**2).sum(axis=1) < _NORM
                part, ints = part.filter(pa.array(fits)), whole[fits].astype("<i8")
                codes, weights = encode(ints, layers) if len(ints) else (ints, ints)
                blobs = [pa.array([x.tobytes() for x in c], pa.binary()) for c in (ints, codes, weights)]
                columns = [part.column("vec_id"), part.column("label"), *blobs]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "ints", "codes", "fits"])

    if not width:
        return vectors.sparkSession.createDataFrame([], _INDEX), 0
    return stage(single.mapInArrow(run, _INDEX), "codes"), width


def _grid(rows: DataFrame, anchors: DataFrame, cell_rows: int, cell_anchors: int, run: Callable, schema: str) -> DataFrame:
    """``run(rows, anchors)`` on every pair of a row block and an anchor block."""
    across = max(1, math.ceil(rows.count() / cell_rows))
    down = max(1, math.ceil(anchors.count() / cell_anchors))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_r", F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int")).withColumn("_a", every(down))
    right = anchors.withColumn("_a", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(down)).cast("int")).withColumn("_r", every(across))
    return left.groupBy("_r", "_a").cogroup(right.groupBy("_r", "_a")).applyInArrow(run, schema)


def _cut(found: DataFrame, keys: list[str], order: list[Column], wanted: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))  # cut in each task before the shuffle, too
    return found.withColumn("rank", rank).where(F.col("rank") <= wanted)


def mine(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    band: tuple[int, int] = (80, 100),
    scale: int = 256,
    vec_id: str = "vec_id",
    label: str = "label",
    embedding: str = "embedding",
    layers: int = LAYERS,
    cell_rows: int = ROWS,
    cell_anchors: int = ANCHORS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(scale * x)``, a score is an integer product. ``anchor`` is a condition on ``vec_id``. An anchor's
    positives are its first ``positives`` other rows of the same label, by falling score and then by id; for each of them come
    the first ``negatives`` rows of other labels whose score lies within ``band`` per cent of the positive's, none if none does.

    Rows with a null id, label, vector or component, with a component that is not finite, of another width than most, or too
    great for scores in a long (squared integer norm of 2^56 or more) take no part. Of rows that share an id the one with the
    greatest label, then vector, counts, so repeated rows change nothing. An empty table gives an empty result; other columns
    are ignored.
    """
    index, width = build_index(vectors, vec_id, label, embedding, scale, layers)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    anchors = index.where(anchor)

    def near(rows: pa.Table, own: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "positive_score"]
        if not rows.num_rows or not own.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        found = best_of_label(Vectors.of(own, layers), Vectors.of(rows, layers), positives)
        return pa.table(dict(zip(names, map(pa.array, found), strict=True)))

    ties = [F.desc("positive_score"), F.asc("positive_id")]
    close = _grid(index, anchors, cell_rows, cell_anchors, near, "anchor_id long, positive_id long, positive_score long")
    close = _cut(close, ["anchor_id"], ties, positives)
    lists = close.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("known"))  # a few each
    asked = stage(anchors.join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "anchors")

    def hard(rows: pa.Table, own: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        if not rows.num_rows or not own.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        known = [[(p["positive_id"], p["positive_score"]) for p in some] for some in own["known"].to_pylist()]
        found = best_in_bands(Vectors.of(own, layers), known, Vectors.of(rows, layers), negatives, band)
        return pa.table(dict(zip(names, map(pa.array, found), strict=True)))

    kinds = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _grid(index, asked, cell_rows, cell_anchors, hard, kinds)
    ties = [F.desc("negative_score"), F.asc("negative_id")]
    ranked = _cut(found, ["anchor_id", "positive_id", "positive_score"], ties, negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
