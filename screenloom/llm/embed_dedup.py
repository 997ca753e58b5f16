"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells.

Centres are fitted on a bounded sample, and every vector is indexed: it lives in the cell of its nearest centre and
visits each cell whose border is near. Take two linked vectors at home in different cells. Between those cells lies a
plane, one vector on either side, and their distances to it add up to at most sqrt(2 - 2 threshold). So at least one of
them is within half of that and visits the other's cell: with ``slack=None`` no link is lost. A smaller ``slack`` visits
fewer cells. In d dimensions the part of the distance that lies across a given border is about 1/sqrt(d) of it, so ``SLACK``
loses next to nothing of vectors spread over many dimensions, but many links of vectors that lie in few: it must be asked for.

Equal vectors are one vertex with a weight. Neighbouring cells form groups of about a block of residents, and a vector visits a
group once, however many of its cells are near. The residents and the visitors of a group are cut into blocks of bounded size,
and each block of residents is compared with every block of the group in tasks of their own; visitors are not compared with
each other. Products are taken in single precision first, with a margin for its error; what may link is decided in double. A
task returns a row per linked vector, with its links counted and one edge of a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.components import components
from screenloom.session import stage

CELL_ROWS = 512  # vectors a cell is meant to hold
MAX_CELLS = 1024  # beyond it cells grow and are cut into blocks
SAMPLE_PER_CELL = 32  # vectors the centres are fitted on, at most, for each cell
BLOCK_ROWS = 4096
_VISITORS = 4  # blocks of residents that a block of visitors is long
SLACK = 0.1
_TILE = 1024


def unit_rows(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors of length one, in double precision; NaN rows for those that link with nothing: null, zero, of another
    width, or with null or non-finite components."""
    rows = np.full((len(lists), width), np.nan)
    for i, v in enumerate(lists):
        value = v.values
        if value is not None and len(value) == width and not value.null_count:
            rows[i] = value.to_numpy(zero_copy_only=False)
    rows[~np.isfinite(rows).all(axis=1)] = np.nan
    top = np.abs(rows).max(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        rows = rows / np.where(top > 0, top, np.nan)  # so that squares neither vanish nor overflow
        rows /= np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return rows


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centres. Begins with evenly spaced sample rows; a cell that runs empty takes the row worst served."""
    cells = max(1, min(cells, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        likeness = sample @ centres.T
        home = likeness.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        empty = np.flatnonzero(size[:, 0] < 1e-12)
        sums[empty] = sample[np.argsort(likeness.max(axis=1), kind="stable")[: len(empty)]]
        size[empty] = 1.0
        after = sums / size
        if np.allclose(after, centres, atol=1e-6):
            break
        centres = after
    return centres


def grouped(centres: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """The group of each cell: cells alike, together of up to ``rows`` vectors where no single one has more."""
    group, number = np.full(len(centres), -1), 0
    while (free := group < 0).any():
        at = int(np.flatnonzero(free)[0])
        middle, held = np.zeros(centres.shape[1]), 0.0
        while at >= 0 and (not held or held + sizes[at] <= rows):
            group[at], free[at] = number, False
            middle, held = middle + centres[at], held + max(sizes[at], 1e-9)
            at = int(np.where(free, centres @ middle, -np.inf).argmax()) if free.any() else -1
        number += 1
    return group


def visits(rows: np.ndarray, centres: np.ndarray, slack: float, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group each vector lives in, and (vector, group) the others that hold a cell whose border towards it is within
    ``slack``."""
    likeness = rows @ centres.T
    home = likeness.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    gap = likeness[np.arange(len(rows)), home][:, None] - likeness
    near = gap <= slack * apart[home] + 1e-12
    seen = near.astype("f4") @ np.eye(group.max() + 1, dtype="f4")[group] > 0
    seen[np.arange(len(rows)), group[home]] = False
    return group[home], seen


class _Forest:
    def __init__(self, size: int):
        self.parent = np.arange(size)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Connect all pairs: labels fall to the least of their links until none changes."""
        x, y = self.parent[x], self.parent[y]
        while True:
            low = np.minimum(x, y)
            np.minimum.at(self.parent, x, low)
            np.minimum.at(self.parent, y, low)
            while (nearer := self.parent[self.parent] < self.parent).any():
                self.parent[nearer] = self.parent[self.parent[nearer]]
            x, y = self.parent[x], self.parent[y]
            if (x == y).all():
                return

    def join_all(self, links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Connect wherever ``links`` holds; for a crowded tile only the least label of each row and column moves."""
        if links.sum() < 4 * sum(links.shape):
            x, y = np.nonzero(links)
            if len(x):
                self.join(rows[x], columns[y])
            return
        none = len(self.parent)
        while True:
            r, c = self.parent[rows], self.parent[columns]
            least_r = np.where(links, c[None, :], none).min(axis=1)
            least_c = np.where(links, r[:, None], none).min(axis=0)
            move_r, move_c = (least_r < none) & (least_r != r), (least_c < none) & (least_c != c)
            if not move_r.any() and not move_c.any():
                return
            self.join(rows[move_r], least_r[move_r])
            self.join(columns[move_c], least_c[move_c])


@dataclass
class _Block:
    """Vectors of one block with their homes and the groups they visit, a bit each."""

    units: np.ndarray
    near: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    homes: np.ndarray
    seen: np.ndarray
    links: np.ndarray

    @classmethod
    def of(cls, frame: pd.DataFrame) -> _Block:
        units = np.frombuffer(b"".join(frame["unit"]), "<f8").reshape(len(frame), -1)
        seen = np.frombuffer(b"".join(frame["seen"]), np.uint8).reshape(len(frame), -1)
        ids, weights, homes = (frame[c].to_numpy(dtype=np.int64) for c in ("id", "weight", "lives"))
        return cls(units, units.astype("f4"), ids, weights, homes, seen, np.zeros(len(frame), np.int64))

    def visits(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return (self.seen[rows, cells >> 3] >> (7 - (cells & 7))) & 1 > 0


def linked(a: _Block, b: _Block, i: int, j: int, threshold: float) -> np.ndarray | None:
    """Which vectors of two tiles link; None if none do. Single precision decides what is clearly apart."""
    margin = (a.units.shape[1] + 8) * 2.0**-23
    close = a.near[i : i + _TILE] @ b.near[j : j + _TILE].T >= np.float32(threshold - margin)
    if not close.any():
        return None
    if close.sum() > 4 * sum(close.shape):
        return a.units[i : i + _TILE] @ b.units[j : j + _TILE].T >= threshold
    x, y = np.nonzero(close)
    close[x, y] = np.einsum("ij,ij->i", a.units[i + x], b.units[j + y]) >= threshold
    return close


def compare(left: pd.DataFrame, right: pd.DataFrame | None, cell: int, threshold: float) -> pd.DataFrame:
    """Links between two blocks of a group of cells, or within one: rows (id, n_links, other) of linked vectors.

    Two visitors are left to the groups they live in. A resident and a visitor whose homes see each other both ways
    are counted in the lesser of the two groups.
    """
    a = _Block.of(left)
    b = a if right is None else _Block.of(right)
    offset = 0 if right is None else len(a.ids)
    forest = _Forest(offset + len(b.ids))
    for i in range(0, len(a.ids), _TILE):
        for j in range(i if right is None else 0, len(b.ids), _TILE):
            links = linked(a, b, i, j, threshold)
            if links is None:
                continue
            once = right is None and i == j
            if once:
                np.fill_diagonal(links, False)
            rows, columns = np.arange(i, i + len(links)), np.arange(j, j + links.shape[1])
            at_a, at_b = a.homes[rows] == cell, b.homes[columns] == cell
            links &= at_a[:, None] | at_b[None, :]
            if not links.any():
                continue
            forest.join_all(links, rows, columns + offset)
            x, y = np.nonzero(links & (at_a[:, None] != at_b[None, :]))
            hx, hy = a.homes[rows[x]], b.homes[columns[y]]
            other = np.where(hx == cell, hy, hx)
            again = (other < cell) & a.visits(rows[x], hy) & b.visits(columns[y], hx)
            links[x[again], y[again]] = False
            a.links[rows] += links @ b.weights[columns]
            if not once:
                b.links[columns] += links.T @ a.weights[rows]
    ids = a.ids if right is None else np.concatenate([a.ids, b.ids])
    total = a.links if right is None else np.concatenate([a.links, b.links])
    root = forest.parent
    while (root[root] != root).any():
        root = root[root]
    joined = root != np.arange(len(root))
    some = (total > 0) | joined
    return pd.DataFrame({"id": ids[some], "n_links": total[some], "other": ids[root[some]]})


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.9,
    slack: float | None = None,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """One row per vec_id: n_links (other vectors linked directly), component_id, kept (it names its component).

    Null, zero and non-finite vectors and those of another width than most link with nothing and are kept. Of rows that
    share an id the one with the greatest components counts; rows without an id are kept as they are, one by one. An
    empty table gives an empty result; other columns are ignored.
    """
    exact = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    slack = exact if slack is None else min(slack, exact)
    spark = vectors.sparkSession
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    single = given.where("vec_id is not null").groupBy("vec_id").agg(F.max("v").alias("v"))
    common = single.where("v is not null").groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = common["width"] if common else 0

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch.column("v"), width)
            good = ~np.isnan(rows).any(axis=1) if width else np.zeros(len(rows), bool)
            units = [r.astype("<f8").tobytes() if g else None for r, g in zip(rows, good, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(units, pa.binary())], names=["vec_id", "unit"])

    units = stage(single.mapInArrow(prepare, "vec_id long, unit binary"), "units")
    distinct = stage(
        units.where("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "vertices"
    )
    count = distinct.count()
    if not count:
        alone = given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        return alone.where("vec_id is not null").distinct().union(alone.where("vec_id is null"))
    cells = max(1, min(MAX_CELLS, math.ceil(count / cell_rows)))
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(cells * SAMPLE_PER_CELL).select("unit").toArrow()
    sampled = np.frombuffer(b"".join(sample["unit"].to_pylist()), "<f8").reshape(sample.num_rows, width)
    centres = spherical_kmeans(sampled, cells)
    living = np.bincount((sampled @ centres.T).argmax(axis=1), minlength=len(centres)) * (count / len(sampled))
    group = grouped(centres, living, block_rows)

    def placed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, len(batch), _TILE):
                part = batch.slice(at, _TILE)
                rows = np.frombuffer(b"".join(part.column("unit").to_pylist()), "<f8").reshape(len(part), width)
                yield part, *visits(rows, centres, slack, group)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, home, seen in placed_rows(batches):
            mask = pa.array([m.tobytes() for m in np.packbits(seen, axis=1)], pa.binary())
            every = seen.copy()
            every[np.arange(len(part)), home] = True
            copies, where = np.nonzero(every)
            at = pa.array(copies)
            columns = [part.column(c).take(at) for c in ("id", "unit", "weight")]
            lives = home[copies]
            yield pa.RecordBatch.from_arrays(
                [pa.array(where.astype(np.int32)), *columns, mask.take(at), pa.array(lives.astype(np.int32)), pa.array(lives == where)],
                names=["cell", "id", "unit", "weight", "seen", "lives", "home"],
            )

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        living, visiting = np.zeros(group.max() + 1, np.int64), np.zeros(group.max() + 1, np.int64)
        for _, home, seen in placed_rows(batches):
            living += np.bincount(home, minlength=len(living))
            visiting += seen.sum(axis=0)
        columns = [pa.array(np.arange(len(living), dtype=np.int32)), pa.array(living), pa.array(visiting)]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "residents", "visitors"])

    blocks = lambda kind, rows: F.ceil(F.sum(kind) / rows).cast("int").alias(kind)
    counted = distinct.select("unit").mapInArrow(tally, "cell int, residents long, visitors long")
    sizes = counted.groupBy("cell").agg(blocks("residents", block_rows), blocks("visitors", _VISITORS * block_rows))
    sizes = sizes.where("residents > 0")  # a row per group
    # The groups are found a second time rather than staged: a vector has a row in every group it visits.
    placed = distinct.mapInArrow(assign, "cell int, id long, unit binary, weight long, seen binary, lives int, home boolean")
    blocked = placed.join(F.broadcast(sizes), "cell")
    hashed = F.xxhash64("id")
    own = F.when(F.col("home"), F.pmod(hashed, "residents")).otherwise(F.col("residents") + F.pmod(hashed, F.greatest("visitors", F.lit(1))))
    last = F.when(F.col("home"), F.col("residents") + F.col("visitors")).otherwise(F.col("residents")) - 1
    paired = blocked.withColumn("_own", own.cast("int")).withColumn("_to", F.explode(F.sequence(F.lit(0), last)))
    paired = paired.withColumn("low", F.least("_own", "_to")).withColumn("high", F.greatest("_own", "_to"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cell, low, high = (int(getattr(k, "item", lambda k=k: k)()) for k in key)
        group = group.sort_values("id", kind="stable")
        if low == high:
            return compare(group, None, cell, threshold)
        left, right = group[group["_own"] == low], group[group["_own"] == high]
        empty = pd.DataFrame({"id": [], "n_links": [], "other": []}, dtype="int64")
        return compare(left, right, cell, threshold) if len(left) and len(right) else empty

    columns = ["cell", "low", "high", "_own", "id", "unit", "weight", "seen", "lives"]
    found = stage(paired.select(*columns).groupBy("cell", "low", "high").applyInPandas(run, "id long, n_links long, other long"), "links")
    links = found.groupBy("id").agg(F.sum("n_links").alias("others"))
    parts = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = distinct.join(links, "id", "left").join(parts.withColumnRenamed("vertex", "id"), "id", "left")
    known = known.select("unit", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    named = units.join(known, "unit", "left")
    result = named.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    missing = given.where("vec_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")
    )
    return result.union(missing)
