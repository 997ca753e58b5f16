"""What the preparation computes and moves, beside what it returns."""

from __future__ import annotations

import numpy as np
import pandas as pd

from screenloom.operators import neighbors, oversample, preprocess, training


def test_powers_are_taken_of_different_values_only(monkeypatch):
    sizes, caught = [], []

    class Table:
        def select(self, *_):
            return self

        def mapInPandas(self, work, _):
            caught.append(work)
            raise InterruptedError

    try:
        preprocess._likelihoods(Table(), {0: [-1.0, 0.0, 0.5]})
    except InterruptedError:
        pass
    real = np.log1p
    monkeypatch.setattr(np, "log1p", lambda x: sizes.append(np.size(x)) or real(x))
    x = np.array([0.0, 1.0, -2.0] * 400 + [3.0, np.nan])
    (out,) = caught[0]([pd.DataFrame({"x0": x}), pd.DataFrame({"x0": x[:10]})])
    assert max(sizes) <= 4
    every = np.concatenate([x, x[:10]])
    every = every[~np.isnan(every)]
    assert out["n"].tolist() == [len(every)] * 3
    assert np.allclose(out["logs"], (np.sign(every) * real(np.abs(every))).sum())
    for lam, mean, square in zip([-1.0, 0.0, 0.5], out["mean"], out["square"], strict=True):
        y = np.array([preprocess.yeo_johnson_value(v, lam) for v in every])
        assert np.isclose(mean, y.mean()) and np.isclose(square, ((y - y.mean()) ** 2).sum())


def test_neighbours_are_searched_without_vectors_as_payload(spark, monkeypatch):
    payloads, real = [], oversample.nearest_neighbors

    def seen(queries, points, k, same, payload, *rest):
        payloads.extend(points.schema[c].dataType.simpleString() for c in payload)
        return real(queries, points, k, same, payload, *rest)

    monkeypatch.setattr(oversample, "nearest_neighbors", seen)
    given = [(i, int(i >= 9), [float(i), float(i * i)]) for i in range(30)]
    rows = spark.createDataFrame(given, "id long, label int, vec array<double>")
    every = oversample.smote(rows, max_neighbors=2).collect()
    assert payloads == ["bigint"]
    made = [r for r in every if r["synthetic"]]
    assert len(every) == 42 and len(made) == 12 and {r["label"] for r in made} == {0}
    for r in made:
        base = given[r["id"]][2]
        ends = sorted((given[j][2] for j in range(9) if j != r["id"]), key=lambda v: sum((a - b) ** 2 for a, b in zip(v, base, strict=True)))[:2]
        shares = [[(p - a) / (b - a) for p, a, b in zip(r["vec"], base, e, strict=True)] for e in ends]
        assert any(abs(s[0] - s[1]) < 1e-9 and -1e-9 <= s[0] <= 1 + 1e-9 for s in shares)


def test_a_query_moves_once_to_a_group_of_cells(spark, monkeypatch):
    """Spread-out vectors visit nearly all cells; their rows follow the groups of cells, and the neighbours are the nearest."""
    moved, real = [], neighbors.stage

    def seen(df, name):
        staged = real(df, name)
        if name == "visits":
            moved.append(staged.count())
        return staged

    monkeypatch.setattr(neighbors, "stage", seen)
    x = np.random.default_rng(5).normal(size=(400, 16))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    report = {}
    got = neighbors.nearest_neighbors(points, points, 3, True, block_points=200, cell_points=20, report=report).collect()
    assert report["cells"] > 10 and report["visits"] > 2000
    assert sum(moved) < 0.5 * report["visits"]
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag(np.full(400, np.inf))
    expected = {(q, k + 1): int(i) for q in range(400) for k, i in enumerate(np.argsort(far[q], kind="stable")[:3])}
    assert {(r["query_id"], r["rank"]): r["id"] for r in got} == expected


def test_profiles_of_one_file_are_dealt_out(spark, monkeypatch):
    parts = []

    def seen(profiles, *_):
        parts.append(profiles.rdd.getNumPartitions())
        raise InterruptedError

    monkeypatch.setattr(training, "build_features", seen)
    people = spark.range(200).toDF("key").coalesce(1)
    try:
        training.prepare(people, "key")
    except InterruptedError:
        pass
    assert parts and parts[0] >= 4
