"""Hard negatives against brute force on integers; intervals against true products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom.llm import hard_negatives as hn


def made(seed=2, n=900, width=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, width))
    rows = base[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * rng.choice([0.05, 0.4, 2.0], (n, 1))
    rows[:60] = rows[60]  # ties
    rows[60:70] = 0
    rows[70:80] = -rows[80:90]
    labels = rng.integers(0, 3, n)
    labels[rng.random(n) < 0.4] = 0  # one label with a large share
    return rows, labels


def brute(ids, ints, labels, anchors, band=(80, 100)):
    expected = []
    scores = ints @ ints.T
    for a in anchors:
        others = sorted((i for i in range(len(ids)) if i != a), key=lambda i: (-scores[a, i], ids[i]))
        for p in [i for i in others if labels[i] == labels[a]][:5]:
            goal = int(scores[a, p])
            inside = [i for i in others if labels[i] != labels[a] and band[0] * goal <= 100 * scores[a, i] <= band[1] * goal][:5]
            expected += [(ids[a], ids[p], k, ids[i], goal, int(scores[a, i])) for k, i in enumerate(inside, 1)]
    return sorted(expected)


@pytest.mark.parametrize(("cells", "layers"), [((8192, 2048), 3), ((100, 7), 1)])
def test_mining(spark, cells, layers):
    rows, labels = made()
    ids = [(i * 31) % 10_007 for i in range(len(rows))]
    bad = [(20_000, [math.nan] * 24, 0), (20_100, None, 0), (20_200, [1.0] * 23 + [None], 0), (20_300, rows[0].tolist(), None)]
    bad += [(20_400, [math.inf] * 24, 0), (20_500, [1.0] * 5, 0), (20_600, [1e30] * 24, 0), (20_700, [], 0), (None, rows[1].tolist(), 0)]
    data = [(i, r.tolist(), int(k)) for i, r, k in zip(ids, rows, labels, strict=True)]
    data = [(*row, "x", 3) for row in [*data, *bad, data[4], data[4]]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, rank string, ints int").repartition(3)
    ints = np.floor(256 * rows).astype(np.int64)
    expected = brute(ids, ints, labels, [k for k, i in enumerate(ids) if i % 10 == 0])
    found = hn.mine(df, F.col("vec_id") % 10 == 0, layers=layers, cell_rows=cells[0], cell_anchors=cells[1])
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 500


def test_intervals_hold_and_discard():
    """The true product always lies inside; more layers make intervals narrower."""
    rows, labels = made(5, 400, 70)
    ints = np.floor(256 * rows).astype(np.int64)
    widths = []
    for layers in (1, 2, 3):
        codes, fits = hn.encode(ints, layers)
        low, high = hn.intervals(ints[:50], hn.Vectors(np.arange(400), labels, ints, codes, fits))
        true = ints[:50] @ ints.T
        assert (low <= true).all() and (true <= high).all()
        widths.append(float(np.median(high - low)))
    assert widths[0] > widths[1] > widths[2]
    own = hn.Vectors(np.arange(400), labels, ints, codes, fits)
    low, high = hn.intervals(ints[:50], own)
    reached = (high >= np.sort(low, axis=1)[:, [-5]]).mean()
    assert reached < 0.5  # most rows are never scored


def test_rotation_is_orthogonal():
    turn = hn.rotation(70)
    assert turn.shape == (70, 128) and np.allclose(turn @ turn.T, np.eye(70))


def test_few_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    everything = F.col("vec_id") >= 0
    assert hn.mine(spark.createDataFrame([], schema), everything).collect() == []
    assert hn.mine(spark.createDataFrame([(1, 1, None), (2, 1, [])], schema), everything).collect() == []
    two = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0])], schema)
    assert hn.mine(two, everything).collect() == []
    four = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.5]), (3, 2, [0.9, 9.0]), (4, 2, [0.5, 0.0])], schema)
    found = sorted(map(tuple, hn.mine(four, F.col("vec_id") == 1).collect()))
    assert found == [(1, 2, 1, 3, 65536, 58880)]
