"""One search of neighbours for all rows and for those outside each fold."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from screenloom.operators import metrics as mt
from screenloom.operators import models as md
from screenloom.operators import neighbors as nn


def _rows(spark, seed, n=300):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n - 90, 3)), rng.normal(size=(40, 3)) * 0.01 + 30, np.full((50, 3), 4.0)])  # with many copies
    x[-1] = 1e6  # far from all others
    fold, label = rng.integers(0, 4, n), rng.integers(0, 2, n)
    rows = [(int(i), x[i].tolist(), int(fold[i]), int(label[i])) for i in range(n)]
    return x, fold, label, spark.createDataFrame(rows, "id long, vec array<double>, fold int, label int")


def _vote(x, label, q, among, k):
    distance = np.sqrt(((x[among] - x[q]) ** 2).sum(1))
    return label[among[np.lexsort((among, distance))[:k]]].mean()


@pytest.mark.parametrize("block", [20_000, 40])
def test_votes_of_all_and_outside_folds(spark, monkeypatch, block):
    monkeypatch.setattr(nn, "BLOCK_POINTS", block)
    monkeypatch.setattr(nn, "CELL_POINTS", 12)
    x, fold, label, rows = _rows(spark, 3)
    every, outside = nn.classify_folds(rows, 5)
    ids = np.arange(len(x))
    assert {r.id: r.score for r in every.collect()} == {int(q): pytest.approx(_vote(x, label, q, ids, 5)) for q in ids}
    found = {(r.id, r.fold): r.score for r in outside.collect()}
    assert found == {(int(q), int(fold[q])): pytest.approx(_vote(x, label, q, np.flatnonzero(fold != fold[q]), 5)) for q in ids}


def test_validation_shares_a_search(spark, monkeypatch):
    """Fitting and five folds deal the points out once, and the test rows once more; the metrics are those of single fits."""
    monkeypatch.setattr(nn, "BLOCK_POINTS", 40)
    monkeypatch.setattr(nn, "CELL_POINTS", 12)
    dealt, real = [], nn.stage
    monkeypatch.setattr(nn, "stage", lambda df, name: (dealt.append(name), real(df, name))[1])
    rows = _rows(spark, 8)[3].select("id", "label", array_to_vector("vec").alias("features"))
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    trainer = md.default_models()["KNN"]
    found, _, fitted = md.evaluate(trainer, "KNN", train, test, 5)
    values = {r.metric: r.value for r in found.collect()}
    assert dealt.count("cells") == 2
    expected = md.cross_validate(trainer, "KNN", train, 5).first()
    assert (values["cv_mean"], values["cv_std"]) == (pytest.approx(expected.cv_mean), pytest.approx(expected.cv_std))
    single = mt.binary_metrics(md.predictions(fitted, "KNN", train), ["model"]).first()
    assert values["train_accuracy"] == pytest.approx(single.accuracy)


def test_single_precision_loses_no_neighbor():
    """Vectors close to each other, far from the origin and from a few others; equal distances; ids in any order."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 5)) * 1e-3 + 1e3, rng.normal(size=(50, 5)) * 1e5, np.round(rng.normal(size=(150, 5)))])
    ids, bound = rng.permutation(len(x)), np.empty(len(x))
    block = nn._Block(x, ids)
    asked, here = nn._Asked(x, ids), slice(0, len(x))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    bound = np.sort(far, axis=1)[:, 3]
    for limit in (None, bound, bound * 1.5):
        rows, cols, exact, same = block.nearest(asked, 4, False, here, limit)
        expected = [(q, int(c)) for q in range(len(x)) for c in np.lexsort((ids, far[q]))[:4]]
        assert [*zip(rows.tolist(), cols.tolist(), strict=True)] == expected and not same.any()
        assert np.allclose(exact, far[rows, cols])
