"""Exact nearest neighbours.

Points that fit into one block of ``BLOCK_POINTS`` rows, which is counted first, go to every task as one matrix, and queries of
any number stream against it.

More points are dealt into cells: each belongs to the nearest of at most ``MAX_PIVOTS`` pivots, chosen by a hash, and a cell
knows its radius. A query first searches its own cell, which bounds the distance of its k-th neighbour. By the triangle
inequality only cells whose pivot is no farther than that bound plus their radius can hold a nearer point, and of those only
the ones whose border with the own cell is within the bound; it visits these and no others. Neighbouring cells form groups of a
``GROUP_BLOCKS`` blocks of points at most: a query moves once to each group with the cells it visits there and its bound, and only points
within the bound come back. Greater cells are cut into blocks, and the queries of a busy group into parts, so no task gets more
than one block and one part. Of equal points only as many are kept as can be neighbours, so copies make no cell hot. Points move
by shuffles alone; the driver sees pivots and a row per cell.

In its own group a query first meets its own cell, then, with the bound that gives, the others. Products in single precision tell
which points can lie within a bound; only these are measured in full.

Points may belong to folds. One search then finds the nearest of all points and the nearest outside a query's own fold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenloom.functions.hashing import hash32
from screenloom.session import stage

BLOCK_POINTS = 20_000
GROUP_BLOCKS = 5  # blocks that a group of cells may hold
CELL_POINTS = 512  # points a cell is meant to hold
MAX_PIVOTS = 4096  # beyond them cells grow and are cut into blocks
_QUERIES = 512  # compared at once
_TASKS = 2  # of a search, for each core
_PRODUCTS = 1 << 21  # of queries and points, at once
_ROUND = 1e-9  # by which rounding may change a distance, in parts of the numbers compared
_SINGLE = 2.0**-22  # the same in single precision, for each coordinate


def chosen_points(points: DataFrame, max_points: int) -> DataFrame:
    """At most ``max_points`` rows, by a hash of the id."""
    return points.orderBy(hash32("id", seed="points"), "id").limit(max_points)


def nearest_neighbors(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    exclude_same_id: bool = False,
    payload: list[str] | None = None,
    max_points: int | None = None,
    block_points: int | None = None,
    cell_points: int | None = None,
    report: dict | None = None,
) -> DataFrame:
    """(query_id, rank, distance, id, payload ...): the k nearest points for every query, ties by id; with ``max_points`` the
    nearest of the chosen points.

    Both inputs carry (id bigint, vec array<double>), vectors of one width without nulls. Payload columns of the points are
    passed through. Queries that share an id are answered one by one. Without points there are no neighbours. ``report`` takes
    the number of cells, of queries, and of visits beyond the own cell where points are dealt into cells.
    """
    points = points if max_points is None else chosen_points(points, max_points)
    index = indexed(points, k, exclude_same_id, payload, block_points, cell_points)
    return index.search(queries, report).drop("_row", "_same")


def indexed(
    points: DataFrame,
    k: int,
    exclude_same_id: bool = False,
    payload: list[str] | None = None,
    block_points: int | None = None,
    cell_points: int | None = None,
) -> Table | Cells:
    """Points that any number of searches may use. Points that carry a ``fold`` (int) are searched twice at once, see ``Cells``."""
    payload = payload or []
    points = points.select("id", "vec", *(["fold"] if "fold" in points.columns else []), *payload)
    most = block_points or BLOCK_POINTS
    if points.limit(most + 1).count() <= most:
        return Table.build(points, k, exclude_same_id, payload)
    return Cells.build(points, k, exclude_same_id, payload, block_points or GROUP_BLOCKS * BLOCK_POINTS, cell_points or CELL_POINTS)


def _best(found: list[DataFrame], k: int, payload: list[str]) -> DataFrame:
    """The k nearest of each query, of at most k from every block, in its own fold and outside."""
    entries = F.slice(F.array_sort(F.collect_list(F.struct("distance", "id", *payload))), 1, k)
    every = reduce(DataFrame.unionByName, found).groupBy("_row", "query_id", "_same").agg(entries.alias("_best"))
    ranked = every.select("_row", "query_id", "_same", F.posexplode("_best").alias("_place", "_near"))
    rank = (F.col("_place") + 1).cast("int").alias("rank")
    return ranked.select("_row", "query_id", "_same", rank, *[F.col("_near")[c].alias(c) for c in ("distance", "id", *payload)])


def _numbered(queries: DataFrame) -> DataFrame:
    return queries.withColumn("_row", F.monotonically_increasing_id())


def _schema(points: DataFrame, payload: list[str]) -> str:
    extra = {f.name: f.dataType.simpleString() for f in points.schema if f.name in payload}
    return "_row bigint, query_id bigint, _same boolean, rank int, distance double, id bigint" + "".join(f", {c} {t}" for c, t in extra.items())


# ---- inside a task ----------------------------------------------------------------------------------------------


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, 0))


def _rows(table: pa.Table, column: str = "vec") -> np.ndarray:
    """A column of arrays of one width as a matrix."""
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(table), -1) if len(table) else np.zeros((0, 0))


def _place(*keys: np.ndarray) -> np.ndarray:
    """The place of each row among those that follow each other with the same keys."""
    n = len(keys[0])
    heads = np.ones(n, bool)
    heads[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
    begin = np.flatnonzero(heads)
    return np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))


@dataclass
class _Asked:
    """Queries: their vectors, ids and, with folds, their fold."""

    vec: np.ndarray
    ids: np.ndarray
    fold: np.ndarray | None = None

    def __getitem__(self, some) -> _Asked:
        return _Asked(self.vec[some], self.ids[some], None if self.fold is None else self.fold[some])


class _Block:
    """Points that a task holds, in the order of their cells and, in a cell, of their ids."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray, fold: np.ndarray | None = None):
        self.matrix, self.ids, self.fold = matrix, ids, fold
        self.squares = (matrix * matrix).sum(1)
        self.single: np.ndarray | None = None

    def nearest(
        self, q: _Asked, k: int, exclude_same_id: bool, here: slice, bound: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, distance, same fold) of the k nearest points of the stretch ``here`` in a query's own fold and of the k
        nearest outside, those that are farther than its ``bound`` or than the last of those outside left out or not."""
        if bound is None:
            return self._select(q, *self._nearby(q, k, exclude_same_id, here, None), k)
        rows, cols = self._within(q, here, bound)
        if exclude_same_id:
            apart = q.ids[rows] != self.ids[cols]
            rows, cols = rows[apart], cols[apart]
        crowded = np.bincount(rows, minlength=len(q.vec)) > 16 * k
        if crowded.any():  # loose bounds: the stretch itself gives better ones
            many, few = np.flatnonzero(crowded), ~crowded[rows]
            r, c = self._nearby(q[many], k, exclude_same_id, here, bound[many])
            rows, cols = np.concatenate([rows[few], many[r]]), np.concatenate([cols[few], c])
        return self._select(q, rows, cols, k)

    def _nearby(self, q: _Asked, k: int, exclude_same_id: bool, here: slice, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all points that can be among the k nearest of the stretch."""
        matrix, ids, squares = self.matrix[here], self.ids[here], self.squares[here]
        take, lengths = min(k, len(ids)), (q.vec * q.vec).sum(1)
        # The product form loses digits; keep everything near the k-th value and measure it directly.
        slack = _ROUND * (lengths + squares.max() + 1)
        rough = q.vec @ matrix.T
        rough *= -2
        rough += squares
        rough += lengths[:, None]
        if exclude_same_id:
            rough[q.ids[:, None] == ids[None, :]] = np.inf
        outside = rough if q.fold is None else np.where(q.fold[:, None] == self.fold[here][None, :], np.inf, rough)
        limit = np.partition(outside, take - 1, axis=1)[:, take - 1] + slack
        if bound is not None:
            limit = np.fmin(limit, bound * bound * (1 + _ROUND) + slack)
        if take < k:  # the k-th lies elsewhere
            limit = np.full(len(limit), np.inf) if bound is None else bound * bound * (1 + _ROUND) + slack
        rows, cols = (np.isfinite(rough) & (rough <= limit[:, None])).nonzero()
        return rows, cols + here.start

    def _scaled(self) -> None:
        """The points around their centre, scaled to lengths of at most one, with their squared lengths, in single precision."""
        self.whole = np.isfinite(self.squares)
        self.centre = self.matrix[self.whole].mean(axis=0) if self.whole.any() else np.zeros(self.matrix.shape[1])
        moved = np.where(self.whole[:, None], self.matrix, self.centre) - self.centre
        self.scale = max(np.sqrt((moved * moved).sum(1).max()), 1e-150)
        moved /= self.scale
        lengths = np.where(self.whole, (moved * moved).sum(1), np.inf)
        self.single = np.column_stack([moved, lengths, np.ones(len(moved))]).astype(np.float32)

    def _within(self, q: _Asked, here: slice, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all points of the stretch within the bounds, and of some beyond them."""
        if self.single is None:
            self._scaled()
        with np.errstate(all="ignore"):
            moved = (q.vec - self.centre) / self.scale
            lengths, limit = (moved * moved).sum(1), (bound / self.scale) ** 2
            limit += _SINGLE * (moved.shape[1] + 4) * ((np.sqrt(lengths) + 1) ** 2 + limit)
            asked = np.column_stack([-2 * moved, np.ones(len(moved)), lengths - limit])
            found = (asked.astype(np.float32) @ self.single[here].T) <= 0
        # Numbers beyond single precision are left to the exact measure; what is infinite has no neighbours.
        large = ~(lengths + limit < 1e12)
        if large.any():
            found[large] = np.isfinite(lengths[large])[:, None] & self.whole[here][None, :]
        rows, cols = np.divmod(_true(found.reshape(-1)), found.shape[1])
        return rows, cols + here.start

    def _select(self, q: _Asked, rows: np.ndarray, cols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        exact = np.empty(len(rows))
        for at in range(0, len(rows), 100_000):
            some = slice(at, at + 100_000)
            diff = q.vec[rows[some]] - self.matrix[cols[some]]
            exact[some] = np.sqrt((diff * diff).sum(1))
        same = np.zeros(len(rows), bool) if q.fold is None else q.fold[rows] == self.fold[cols]
        return _first(rows, cols, exact, same, self.ids, k)


def _first(rows: np.ndarray, cols: np.ndarray, exact: np.ndarray, same: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """Of each query the k nearest of its own fold and the k nearest outside, ties by id."""
    order = np.lexsort((ids[cols], exact, same, rows))
    rows, cols, exact, same = rows[order], cols[order], exact[order], same[order]
    keep = _place(rows, same) < k
    return rows[keep], cols[keep], exact[keep], same[keep]


def _true(flags: np.ndarray) -> np.ndarray:
    """Where flags are set, eight at a time as few are."""
    whole = len(flags) // 8 * 8
    some = np.flatnonzero(flags[:whole].view(np.uint64) != 0)
    at = np.flatnonzero(flags[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[at // 8] * 8 + at % 8, whole + np.flatnonzero(flags[whole:])])


def _steps(first: int, last: int, points: int) -> list[slice]:
    """Queries in pieces that make no more than so many products with a number of points."""
    step = max(16, min(_QUERIES, _PRODUCTS // max(points, 1)))
    return [slice(at, min(at + step, last)) for at in range(first, last, step)]


# ---- one block --------------------------------------------------------------------------------------------------


@dataclass
class Table:
    """A block of points at most, which goes to every task."""

    points: DataFrame
    table: pd.DataFrame
    k: int
    exclude_same_id: bool
    payload: list[str]

    @classmethod
    def build(cls, points: DataFrame, k: int, exclude_same_id: bool, payload: list[str]) -> Table:
        table = points.toArrow().to_pandas().sort_values("id", ignore_index=True)
        return cls(points, table, k, exclude_same_id, payload)

    def search(self, queries: DataFrame, report: dict | None = None) -> DataFrame:
        """The k nearest of the points for every query, as ``Cells.search``."""
        k, exclude_same_id, payload, folds = self.k, self.exclude_same_id, self.payload, "fold" in self.points.columns
        kept = ["fold"] if folds else []
        shared = queries.sparkSession.sparkContext.broadcast((_matrix(self.table["vec"]), self.table[["id", *kept, *payload]]))

        def match(batches):
            matrix, known = shared.value
            block = _Block(matrix, known["id"].to_numpy(), known["fold"].to_numpy() if folds else None)
            every = slice(0, len(known))
            for batch in batches:
                for some in _steps(0, len(batch) if len(known) else 0, len(known)):
                    part = batch.iloc[some]
                    q = _Asked(_matrix(part["vec"]), part["id"].to_numpy(), part["fold"].to_numpy() if folds else None)
                    rows, cols, exact, same = block.nearest(q, k, exclude_same_id, every)
                    found = {"_row": part["_row"].to_numpy()[rows], "query_id": q.ids[rows], "_same": same, "rank": (_place(rows, same) + 1).astype("int32")}
                    found |= {"distance": exact, "id": known["id"].to_numpy()[cols]}
                    yield pd.concat([pd.DataFrame(found), known[payload].iloc[cols].reset_index(drop=True)], axis=1)

        asked = queries if "_row" in queries.columns else queries.withColumn("_row", F.lit(0).cast("long"))
        return asked.select("id", "vec", "_row", *kept).mapInPandas(match, _schema(self.points, payload))


# ---- cells ------------------------------------------------------------------------------------------------------


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all rows and pivots, and by how much rounding can have changed the greatest of them."""
    squares = (rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _blur(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A bound on the rounding of ``_distances``: the product form loses digits where vectors are long and close."""
    return np.sqrt(_ROUND * ((rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1).max() + 1e-300))


def _cell_groups(pivots: np.ndarray, counts: np.ndarray, block_points: int) -> np.ndarray:
    """The group of each cell: cells are halved along the coordinate in which their pivots vary most until a group holds no more
    than a block of points, or is one cell."""
    found, left = np.zeros(len(pivots), "int32"), [np.arange(len(pivots))] if len(pivots) else []
    groups = 0
    while left:
        cells = left.pop()
        if len(cells) == 1 or counts[cells].sum() <= block_points:
            found[cells] = groups
            groups += 1
            continue
        order = cells[np.argsort(pivots[cells, pivots[cells].var(axis=0).argmax()], kind="stable")]
        left += [order[: len(order) // 2], order[len(order) // 2 :]]
    return found


def _reached(rows: np.ndarray, own: np.ndarray, bound: np.ndarray, pivots: np.ndarray, radii: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which cells can hold a point within the ``bound`` of each query, whose own cell they know."""
    blur, here, between = _blur(rows, pivots), apart[np.arange(len(rows)), own][:, None], _distances(pivots[own], pivots)
    reach = apart - radii[None, :] <= bound[:, None] + 2 * blur
    with np.errstate(divide="ignore", invalid="ignore"):
        border = (apart**2 - here**2) / (2 * between)
        reach &= ~(border > bound[:, None] + 2 * blur * (1 + (apart + here) / between))
    return reach


def _in_cells(
    some: pa.Table, near: pa.Table, k: int, exclude_same_id: bool, payload: list[str], schema: pa.Schema, known: tuple | None
) -> pa.Table:
    """For each query the k nearest of the points ``near`` in the cells it names, no farther than its bound. Where ``known`` are the
    cells of the group, their pivots and radii, a query names its own cell and meets all of them that it can need."""
    if not len(some) or not len(near):
        return schema.empty_table()
    fold = lambda t: t.column("fold").to_numpy() if "fold" in t.column_names else None
    ids, cells, folds = near.column("id").to_numpy(), near.column("cell").to_numpy(), fold(near)
    sort = np.lexsort((ids, cells))
    ids, cells = ids[sort], cells[sort]
    block = _Block(_rows(near)[sort], ids, None if folds is None else folds[sort])
    asked, bound = _Asked(_rows(some), some.column("id").to_numpy(), fold(some)), some.column("bound").to_numpy()
    listed = some.column("cells").combine_chunks()
    who, named = np.repeat(np.arange(len(some)), listed.value_lengths().to_numpy()), listed.flatten().to_numpy()
    parts = _met_cells(asked, bound, who, named, block, cells, k, exclude_same_id)
    if known is not None:
        rows, _, exact, same = (np.concatenate(p) if parts else np.zeros(0, int) for p in (zip(*parts, strict=True) if parts else [()] * 4))
        last = ~same.astype(bool)
        full = np.bincount(rows[last], minlength=len(some)) >= k
        far = np.zeros(len(some))
        np.maximum.at(far, rows[last], exact[last])
        bound = np.where(full, far, bound)
        mine, pivots, radii = known
        pairs = []
        for at in range(0, len(some), 1024):
            here = slice(at, min(at + 1024, len(some)))
            own = np.searchsorted(mine, named[here])
            reach = _reached(asked.vec[here], own, bound[here], pivots, radii, _distances(asked.vec[here], pivots))
            reach[np.arange(len(own)), own] = False
            r, c = reach.nonzero()
            pairs.append((r + at, mine[c]))
        parts += _met_cells(asked, bound, *(np.concatenate(p) for p in zip(*pairs, strict=True)), block, cells, k, exclude_same_id)
    if not parts:
        return schema.empty_table()
    rows, cols, exact, same = _first(*(np.concatenate(p) for p in zip(*parts, strict=True)), ids, k)
    head = [some.column("_row").to_numpy()[rows], asked.ids[rows], same, (_place(rows, same) + 1).astype("int32"), exact, ids[cols]]
    columns = [pa.array(c, from_pandas=True) for c in head]
    columns += [near.column(c).combine_chunks().take(pa.array(sort[cols])) for c in payload]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _met_cells(
    asked: _Asked, bound: np.ndarray, who: np.ndarray, named: np.ndarray, block: _Block, cells: np.ndarray, k: int, exclude_same_id: bool
) -> list[tuple]:
    """Queries ``who`` meet the points of the cells ``named``, one cell after the other."""
    order = np.lexsort((np.isinf(bound[who]), named))
    who, named = who[order], named[order]
    parts = []
    for cell in np.unique(named):
        low, high = np.searchsorted(cells, [cell, cell + 1])
        if low == high:
            continue
        first, last = np.searchsorted(named, [cell, cell + 1])
        open_ = last - int(np.isinf(bound[who[first:last]]).sum())  # from there on queries have no bound
        for piece in _steps(first, open_, high - low) + _steps(open_, last, high - low):
            q = who[piece]
            limit = None if piece.start >= open_ else bound[q]
            r, *rest = block.nearest(asked[q], k, exclude_same_id, slice(low, high), limit)
            parts.append((q[r], *rest))
    return parts


def _possible(points: DataFrame, k: int) -> DataFrame:
    """Points without those that never can be neighbours: of equal vectors (of a fold) the first k + 1 ids, of an id k rows."""
    alike = ["vec", "fold"] if "fold" in points.columns else ["vec"]
    same = Window.partitionBy(*alike).orderBy("id")
    copies = points.withColumn("_place", F.dense_rank().over(same)).where(F.col("_place") <= k + 1)
    twice = Window.partitionBy(*alike, "id").orderBy(F.monotonically_increasing_id())
    return copies.withColumn("_place", F.row_number().over(twice)).where(F.col("_place") <= k).drop("_place")


@dataclass
class Cells:
    """Points dealt into cells. Where they have folds, a query (with a fold as well) finds, with ``_same``, the k nearest of its own
    fold as far as they can be among its k nearest of all, and the k nearest outside."""

    placed: DataFrame
    k: int
    exclude_same_id: bool
    payload: list[str]
    block_points: int
    pivots: np.ndarray
    counts: np.ndarray  # points of a cell
    sure: np.ndarray  # of them outside of any one fold
    radii: np.ndarray
    group: np.ndarray  # of a cell
    enough: int  # points of which k are neighbours

    @classmethod
    def build(cls, points: DataFrame, k: int, exclude_same_id: bool, payload: list[str], block_points: int, cell_points: int) -> Cells:
        kept = stage(_possible(points, k), "points")
        total = kept.count()
        sample = chosen_points(kept.select("id", "vec"), max(1, min(MAX_PIVOTS, math.ceil(total / cell_points)))).select("vec")
        pivots = np.unique(np.array([r["vec"] for r in sample.collect()], float), axis=0)
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)

        def deal(batches):
            for batch in batches:
                for start in range(0, len(batch), 1024):
                    part = batch.iloc[start : start + 1024].copy()
                    rows = _matrix(part["vec"])
                    cell = _distances(rows, pivots).argmin(axis=1)
                    part["cell"] = cell.astype("int32")
                    part["reach"] = np.sqrt(((rows - pivots[cell]) ** 2).sum(1))
                    yield part

        placed = stage(kept.mapInPandas(deal, f"{fields}, cell int, reach double"), "cells")
        folds = [c for c in kept.columns if c == "fold"]
        sizes = placed.groupBy("cell", *folds).agg(F.count("*").alias("n"), F.max("reach").alias("reach"))
        most = F.max("n") if folds else F.lit(0)
        sums = sizes.groupBy("cell").agg(F.sum("n").alias("n"), most.alias("most"), F.max("reach").alias("reach")).collect()
        counts, held, radii = np.zeros(len(pivots), int), np.zeros(len(pivots), int), np.zeros(len(pivots))
        for r in sums:
            counts[r["cell"]], held[r["cell"]], radii[r["cell"]] = r["n"], r["most"], r["reach"]
        # Of k points and as many more as can share the query's id at least k are neighbours.
        alike = kept.groupBy("id").count().agg(F.max("count")).first()[0] if exclude_same_id else 0
        group = _cell_groups(pivots, counts, block_points)
        return cls(placed, k, exclude_same_id, payload, block_points, pivots, counts, counts - held, radii, group, k + alike)

    def search(self, queries: DataFrame, report: dict | None = None) -> DataFrame:
        """(_row, query_id, _same, rank, distance, id, payload ...) for every query."""
        pivots, counts, sure, radii, group, enough = self.pivots, self.counts, self.sure, self.radii, self.group, self.enough
        columns = ["_row", "id", "vec"] + (["fold"] if "fold" in self.placed.columns else [])
        # Queries that share an id stay apart by their row number, which is fixed once it is written.
        rows = queries if "_row" in queries.columns else stage(_numbered(queries).select(*columns), "queries")

        def at_home(batches):
            for batch in batches:
                for start in range(0, len(batch), 1024):
                    part = batch.iloc[start : start + 1024].copy()
                    apart = _distances(_matrix(part["vec"]), pivots)
                    apart[:, counts == 0] = np.inf
                    cell = apart.argmin(axis=1).astype("int32")
                    yield part.assign(group=group[cell], cells=pd.Series(list(cell[:, None]), part.index, object), bound=np.inf)

        asked = "_row bigint, id bigint, vec array<double>, " + ("fold int, " if "fold" in columns else "") + "group int, cells array<int>, bound double"
        home = stage(rows.mapInPandas(at_home, asked), "asked")
        first = stage(_best([self._met(home, True)], self.k, self.payload), "home")
        full = first.where((F.col("rank") == self.k) & ~F.col("_same")).select("_row", F.col("distance").alias("bound"))
        bounded = home.drop("bound").join(full, "_row", "left")

        def visits(batches):
            for batch in batches:
                for start in range(0, len(batch), 256):
                    part = batch.iloc[start : start + 256]
                    rows, own = _matrix(part["vec"]), np.concatenate(part["cells"].to_numpy()).astype(int)
                    apart, blur = _distances(rows, pivots), _blur(rows, pivots)
                    bound = part["bound"].fillna(np.inf).to_numpy()[:, None].copy()
                    open_ = np.flatnonzero(np.isinf(bound[:, 0]))
                    if len(open_):
                        farthest = np.where(counts > 0, apart[open_] + radii, np.inf) + blur[open_]
                        order = np.argsort(farthest, axis=1)
                        place = (np.cumsum(sure[order], axis=1) < enough).sum(axis=1, keepdims=True)
                        held = np.take_along_axis(farthest, np.take_along_axis(order, np.minimum(place, len(pivots) - 1), 1), 1)
                        held[place == len(pivots)] = np.inf
                        bound[open_] = held
                    reach = _reached(rows, own, bound[:, 0], pivots, radii, apart)
                    reach &= group[None, :] != part["group"].to_numpy()[:, None]  # its own group has been searched
                    reach[:, counts == 0] = False
                    r, c = reach.nonzero()
                    order = np.lexsort((c, group[c], r))
                    r, c = r[order], c[order]
                    heads = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (group[c[1:]] != group[c[:-1]]))) if len(r) else r
                    out = part[columns].iloc[r[heads]].reset_index(drop=True)
                    cells = pd.Series(np.split(c.astype("int32"), heads[1:]) if len(r) else [], dtype=object)
                    yield out.assign(group=group[c[heads]], cells=cells, bound=bound[r[heads], 0])

        further = stage(bounded.mapInPandas(visits, asked), "visits")
        if report is not None:
            report |= {"cells": int((counts > 0).sum()), "queries": home.count(), "visits": further.agg(F.sum(F.size("cells"))).first()[0] or 0}
        return _best([first.drop("rank"), self._met(further, False).drop("rank")], self.k, self.payload)

    def _met(self, asked: DataFrame, at_home: bool) -> DataFrame:
        """The k nearest within the ``cells`` of a group that ``asked`` (_row, id, vec, group, cells, bound) names, no farther
        than ``bound``; at home in the whole group, as far as it can hold one of the k."""
        spark, k, exclude_same_id, payload = asked.sparkSession, self.k, self.exclude_same_id, self.payload
        busy = {r["group"]: r["n"] for r in asked.groupBy("group").agg(F.count("*").alias("n")).collect()}
        blocks = {g: max(1, -(-int(self.counts[self.group == g].sum()) // self.block_points)) for g in busy}
        # Parts of no more than a group, and small enough to keep all cores busy.
        size = max(1, min(self.block_points, sum(busy.values()) // (_TASKS * spark.sparkContext.defaultParallelism)))
        plan = [(g, blocks[g], -(-n // size)) for g, n in busy.items()]
        table = F.broadcast(spark.createDataFrame(plan, "group int, blocks int, parts int"))  # a row per group
        grouped = F.broadcast(spark.createDataFrame(list(enumerate(self.group.tolist())), "cell int, group int"))  # a row per cell
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(table, "group").withColumn("part", F.pmod(F.xxhash64("_row"), F.col("parts")).cast("int"))
        right = self.placed.join(grouped, "cell").join(table, "group")
        right = right.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        left, right = left.withColumn("block", every("blocks")), right.withColumn("part", every("parts"))
        wanted = _schema(self.placed, payload)
        schema = spark.createDataFrame([], wanted).toArrow().schema
        keys, kept = ["group", "block", "part"], ["fold"] if "fold" in self.placed.columns else []

        pivots, radii, group = self.pivots, self.radii, self.group

        def match(key: tuple, some: pa.Table, near: pa.Table) -> pa.Table:
            mine = np.flatnonzero(group == key[0].as_py())
            return _in_cells(some, near, k, exclude_same_id, payload, schema, (mine, pivots[mine], radii[mine]) if at_home else None)

        own = left.select(*keys, "_row", "id", "vec", *kept, "cells", "bound").groupBy(*keys)
        return own.cogroup(right.select(*keys, "cell", "id", "vec", *kept, *payload).groupBy(*keys)).applyInArrow(match, wanted)


# ---- votes ------------------------------------------------------------------------------------------------------


def _votes(near: DataFrame, keys: list[str]) -> DataFrame:
    votes = near.groupBy(*keys).agg(F.avg(F.col("label").cast("double")).alias("score"))
    return votes.withColumn("yhat", (F.col("score") > 0.5).cast("int"))


def classify(test: DataFrame, train: DataFrame, k: int = 11, max_points: int | None = None) -> DataFrame:
    """Vote of the k nearest training rows: (id, score, yhat). ``train`` carries a ``label``."""
    near = nearest_neighbors(test, train, k, payload=["label"], max_points=max_points)
    return _votes(near.withColumnRenamed("query_id", "_id").drop("id").withColumnRenamed("_id", "id"), ["id"])


def classify_folds(rows: DataFrame, k: int = 11) -> tuple[DataFrame, DataFrame]:
    """(id, score, yhat) by the vote of the k nearest of all rows, and (id, fold, score, yhat) by that of the k nearest outside the
    row's own fold, both from one search. ``rows``: id, vec, label, fold."""
    points = rows.select("id", "vec", F.col("fold").cast("int").alias("fold"), "label")
    asked = stage(_numbered(points.drop("label")), "queries")
    near = indexed(points, k, payload=["label"]).search(asked)
    entry = F.struct("distance", "id", "label")
    nearest = lambda found: F.slice(F.array_sort(F.collect_list(found)), 1, k)
    by_row = near.groupBy("_row").agg(nearest(entry).alias("every"), nearest(F.when(~F.col("_same"), entry)).alias("outside"))
    found = stage(asked.select("_row", "id", "fold").join(by_row, "_row"), "near")
    of = lambda column, *keys: _votes(found.select(*keys, F.explode(column).alias("_near")).select(*keys, "_near.label"), [*keys])
    return of("every", "id"), of("outside", "id", "fold")
