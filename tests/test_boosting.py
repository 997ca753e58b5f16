"""Regularised boosting against a plain builder of trees; sums in passes."""

import math

import numpy as np
import pytest

from screenloom.operators import boosting as bs
from screenloom.operators import passes


def made(seed=1, n=500, width=7):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)  # with ties
    x[:, 5] = 3.0
    y = ((x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=n) * 0.3) > 0).astype(int)
    return x, y


def table(spark, x, y, folds=3, parts=4):
    rows = [(i, int(v), list(map(float, r)), i % folds, "x") for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, label int, features array<double>, fold int, margins string").repartition(parts)


def worth(g, h, s):
    t = math.copysign(max(abs(g) - s.l1, 0.0), g)
    return t * t / (h + s.l2), -s.rate * t / (h + s.l2)


def grow(x, g, h, rows, columns, cuts, s, depth):
    """A tree as nested tuples (feature, cut, left, right) or a value, by trying every cut on the rows themselves."""
    base, value = worth(g[rows].sum(), h[rows].sum(), s)
    best = None
    for f in columns if depth else ():
        for cut in cuts[f]:
            left = rows & (x[:, f] <= cut)
            right = rows & ~left
            if min(h[left].sum(), h[right].sum()) < s.least_hessian:
                continue
            gain = worth(g[left].sum(), h[left].sum(), s)[0] + worth(g[right].sum(), h[right].sum(), s)[0] - base
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, cut, left, right)
    if best is None:
        return value
    _, f, cut, left, right = best
    return f, cut, *(grow(x, g, h, side, columns, cuts, s, depth - 1) for side in (left, right))


def nested(tree, cuts, node=0):
    f = int(tree.feature[node])
    if f < 0:
        return float(tree.value[node])
    return f, float(cuts[f][tree.last[node]]), nested(tree, cuts, 2 * node + 1), nested(tree, cuts, 2 * node + 2)


def value_of(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and abs(a - b) < 1e-9


@pytest.mark.parametrize("refresh", [2, 100])
def test_trees_of_a_plain_builder(spark, monkeypatch, refresh):
    """Every tree of every fit: on all rows, and on those outside each fold."""
    monkeypatch.setattr(bs, "REFRESH", refresh)
    s = bs.Settings(trees=4, depth=3, rate=0.3, bins=16)
    x, y = made()
    found = bs.fit(table(spark, x, y), s, folds=3)
    ids, cuts = np.arange(len(x)), found[0].cuts
    assert len(found) == 4 and len(cuts[5]) == 1
    for m, ensemble in enumerate(found):
        margin = np.zeros(len(x))
        for number, tree in enumerate(ensemble.trees):
            p = 1 / (1 + np.exp(-margin))
            rows = bs.sampled(ids, number, s.row_share, s.seed) & ((ids % 3 != m - 1) if m else True)
            plain = grow(x, p - y, p * (1 - p), rows, bs.tree_columns(number, 7, s), cuts, s, s.depth)
            assert same(nested(tree, cuts), plain), (m, number)
            margin += [value_of(plain, row) for row in x]
        assert np.allclose(ensemble.score(x), 1 / (1 + np.exp(-margin)))


def test_learns(spark):
    x, y = made(3, 900)
    found = bs.fit(table(spark, x, y), bs.Settings(trees=30, rate=0.2), folds=3)
    for m in (1, 2, 3):
        out = np.arange(900) % 3 == m - 1
        assert ((found[m].score(x[out]) > 0.5) == y[out]).mean() > 0.8


def test_terms_restrain(spark):
    """More L1 and L2 make smaller leaves; too much of either leaves none."""
    x, y = made()
    rows = table(spark, x, y)
    sizes = [max(np.abs(t.value[t.feature < 0]).max() for t in bs.fit(rows, bs.Settings(trees=2, l1=l1, l2=l2))[0].trees)
             for l1, l2 in ((0, 0), (5, 0), (0, 50))]
    assert sizes[1] < sizes[0] and sizes[2] < sizes[0]
    assert (bs.fit(rows, bs.Settings(trees=2, l1=1e6))[0].score(x) == 0.5).all()


def test_poor_tables(spark):
    none = spark.createDataFrame([], "id long, label int, features array<double>")
    assert len(bs.fit(none, bs.Settings(trees=2))[0].score(np.zeros((0, 0)))) == 0
    same_label = spark.createDataFrame([(i, 1, [float(i), float("nan")]) for i in range(9)], none.schema)
    scores = bs.fit(same_label, bs.Settings(trees=3, l1=0.0))[0].score(np.array([[1.0, 2.0], [np.nan, 0.0]]))
    assert (scores > 0.5).all()
    with pytest.raises(ValueError):
        bs.fit(none, bs.Settings(bins=300))


def test_sampling_is_even():
    ids = np.arange(20_000)
    assert abs(bs.sampled(ids, 3, 0.8, 42).mean() - 0.8) < 0.02
    assert bs.sampled(ids, 3, 1.0, 42).all()
    assert not (bs.sampled(ids, 3, 0.5, 42) == bs.sampled(ids, 4, 0.5, 42)).all()


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_sums_over_partitions(spark, parts):
    """Also where partial sums are added up by tasks first."""
    rows = spark.range(0, 1000, numPartitions=parts)

    def work(batches):
        values = [b.column("id").to_numpy() for b in batches]
        values = np.concatenate(values) if values else np.zeros(0)
        return np.array([[values.sum(), len(values)]])

    assert passes.total(passes.Held(rows, parts), work, (1, 2)).tolist() == [[499_500, 1000]]


def test_one_side_of_a_cut_is_summed(spark, monkeypatch):
    """Below the root a pass sums one side of each cut and reads blocks, not rows."""
    seen, total = [], bs.total
    monkeypatch.setattr(bs, "total", lambda held, work, shape: seen.append((held.rows.count(), shape[2])) or total(held, work, shape))
    x, y = made()
    bs.fit(table(spark, x, y, parts=1), bs.Settings(trees=2, depth=4), folds=3)
    assert seen == [(1, 1), (1, 1), (1, 2), (1, 4)] * 2


def test_first_of_equal_cuts():
    """A bin without rows may hold what rounding leaves of its parent; the cut before it still comes first."""
    g, h = np.zeros((1, 2, 8)), np.zeros((1, 2, 8))
    g[0, :, 1], g[0, :, 6], h[0, :, [1, 6]] = 5.0, -5.0, 10.0
    g[0, 0, 3] = 1e-15
    (cut,) = bs.best_cuts(g, h, np.array([0, 1]), bs.Settings(bins=8))
    assert cut[:2] == (0, 1)
