"""The perceptron: gradients by differences, Adam step by step, the L2 term, folds."""

import numpy as np
import pyarrow as pa
import pytest

from screenloom.operators import passes
from screenloom.operators import perceptron as pc


def made(seed=1, n=300, width=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    return x, ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)


def table(spark, x, y, folds=3):
    rows = [(i, int(v), list(map(float, r)), i % folds) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, label int, features array<double>, fold int").repartition(4)


def test_gradient_by_differences():
    x, y = made(n=40)
    layers = pc.Layers([4, 6, 5, 1])
    flat = layers.begin(3) + 0.01
    gradient, loss = layers.gradient(flat, x, y)
    assert np.isclose(loss, layers.gradient(flat, x[:25], y[:25])[1] + layers.gradient(flat, x[25:], y[25:])[1])
    for k in range(0, layers.size, 7):
        step = np.zeros(layers.size)
        step[k] = 1e-6
        slope = (layers.gradient(flat + step, x, y)[1] - layers.gradient(flat - step, x, y)[1]) / 2e-6
        assert abs(slope - gradient[k]) < 1e-4 * max(1, abs(slope))


@pytest.mark.parametrize("batches", [1, 3])
def test_steps_of_a_plain_loop(spark, batches):
    """All fits, step by step, without Spark and with moments written out."""
    s = pc.Settings(hidden=(8, 5), epochs=6, batches=batches, patience=100, tolerance=0.0)
    x, y = made()
    found = pc.fit(table(spark, x, y), s, folds=3)
    ids, layers = np.arange(len(x)), pc.Layers([4, 8, 5, 1])
    for m, fitted in enumerate(found):
        flat, mean, square, step = layers.begin(s.seed), 0.0, 0.0, 0
        inside = ids % 3 != m - 1 if m else ids >= 0
        best, best_loss = flat, np.inf
        for epoch in range(s.epochs):
            losses, count = 0.0, 0
            for batch in range(batches):
                use = inside & (pc.batch_of(ids, epoch, batches, s.seed) == batch)
                gradient, loss = layers.gradient(flat, x[use], y[use])
                weights = np.concatenate([np.concatenate([w.ravel(), 0 * b]) for w, b in layers.split(flat)])
                gradient = (gradient + s.l2 * weights) / use.sum()
                losses, count = losses + loss + s.l2 / 2 * (weights**2).sum(), count + use.sum()
                step += 1
                mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
                hat, hat_square = mean / (1 - 0.9**step), square / (1 - 0.999**step)
                flat = flat - s.rate * hat / (np.sqrt(hat_square) + 1e-8 / np.sqrt(1 - 0.999**step))
            if losses / count < best_loss:
                best, best_loss = flat, losses / count
        assert np.allclose(fitted.flat, best, atol=1e-7), m


def test_l2_term_has_effect(spark):
    x, y = made()
    rows = table(spark, x, y)
    norms = []
    for l2 in (0.0, 0.01, 50.0):
        fitted = pc.fit(rows, pc.Settings(hidden=(8,), l2=l2, epochs=25, batches=1))[0]
        norms.append(np.sqrt((pc.Layers(fitted.sizes).penalty(fitted.flat) ** 2).sum()))
    assert norms[0] > norms[1] > norms[2]


def test_learns(spark):
    x, y = made(2, 900)
    found = pc.fit(table(spark, x, y), pc.Settings(hidden=(32, 16), epochs=60, rate=0.02), folds=3)
    for m in (1, 2, 3):
        out = np.arange(900) % 3 == m - 1
        assert ((found[m].score(x[out]) > 0.5) == y[out]).mean() > 0.8


def test_stored_and_empty(spark):
    none = spark.createDataFrame([], "id long, label int, features array<double>")
    assert len(pc.fit(none)[0].score(np.zeros((0, 0)))) == 0
    x, y = made(n=20)
    fitted = pc.fit(table(spark, x, y), pc.Settings(hidden=(3,), epochs=2))[0]
    assert (pc.Perceptron.from_json(fitted.to_json()).score(x) == fitted.score(x)).all()


def test_passes_read_blocks(spark, monkeypatch):
    """Rows reach a pass as blocks of bytes, dealt out evenly: their number, not that of the rows, is what Spark moves."""
    seen, total = [], pc.total
    monkeypatch.setattr(pc, "total", lambda table, *rest: seen.append((table.rows.count(), table.parts)) or total(table, *rest))
    x, y = made(n=900)
    rows = table(spark, x, y, folds=2).coalesce(1)
    found = pc.fit(rows, pc.Settings(hidden=(3,), epochs=1), folds=2)
    assert len(found) == 3 and set(seen) == {(1, 1)}


def test_blocks_keep_all_rows(spark):
    x, y = made(n=900)
    given = table(spark, x, y).repartition(3)
    kept = passes.packed(given, "rows", pc._arrays, list(pc._TYPES), 100)
    assert kept.parts == min(kept.rows.count(), spark.sparkContext.defaultParallelism)

    def work(batches):
        sums = np.zeros((2, 900))
        for ids, labels, _, features in passes.unpacked(batches, pc._TYPES):
            sums[:, ids] += labels, features.reshape(len(ids), -1).sum(axis=1)
        return sums

    assert np.allclose(passes.total(kept, work, (2, 900)), [y, x.sum(axis=1)])


def test_layers_run_in_single_precision(spark, monkeypatch):
    """Rows pass the layers in single precision; sums and steps are double and close to those of double layers."""
    seen, real = [], pc.Layers.gradient

    def gradient(self, flat, x, y):
        seen.append((flat.dtype, x.dtype))
        return real(self, flat, x, y)

    monkeypatch.setattr(pc.Layers, "gradient", gradient)
    x, y = made()
    layers, s = pc.Layers([4, 8, 5, 1]), pc.Settings(hidden=(8, 5), batches=1)
    flat = np.tile(layers.begin(s.seed), (2, 1))
    found = {c: v.astype(t) for (c, t), v in zip(pc._TYPES.items(), (np.arange(len(x)), y, np.arange(len(x)) % 2, x), strict=True)}
    block = pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in found.values()], names=list(found))
    sums = pc._work(layers, flat, np.arange(2), 0, 0, s)(iter([block]))
    assert seen and {d for pair in seen for d in pair} == {np.dtype(np.float32)} and sums.dtype == np.float64
    gradient_, loss = real(layers, flat[0], x, y)
    assert np.allclose(sums[0, :-2], gradient_, atol=1e-5 * np.abs(gradient_).max()) and np.isclose(sums[0, -2], loss)
    assert sums[0, -1] == len(x) and sums[1, -1] == (np.arange(len(x)) % 2 != 0).sum()
