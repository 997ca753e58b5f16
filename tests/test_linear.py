"""Linear classifiers: at the least loss, equal to another solver, all folds as if fitted alone."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from screenloom.operators import linear as ln


def made(seed=1, n=400, width=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * [1, 3, 0.2, 1, 1]
    return x, (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) > 0.4).astype(float)


def table(spark, x, y, folds=4):
    rows = [(i, int(v), list(map(float, r)), i % folds) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, label int, features array<double>, fold int").repartition(3)


def slopes(loss, weights):
    return [(loss(weights + 1e-5 * e) - loss(weights - 1e-5 * e)) / 2e-5 for e in np.eye(len(weights))]


def logistic_objective(x, y, c):
    def loss(w):
        margin = x @ w[:-1] + w[-1]
        return c * (np.logaddexp(0, margin) - y * margin).sum() + (w[:-1] ** 2).sum() / 2

    return loss


def test_logistic_regression(spark):
    x, y = made()
    df = table(spark, x, y)
    found = ln.fit_logistic(df, 0.5, folds=4)
    assert len(found) == 5
    for m, fitted in enumerate(found):
        use = np.arange(len(x)) % 4 != m - 1 if m else np.ones(len(x), bool)
        assert np.abs(slopes(logistic_objective(x[use], y[use], 0.5), fitted.weights)).max() < 1e-2
    vectors = df.withColumn("features", array_to_vector("features"))
    other = LogisticRegression(regParam=1 / (0.5 * len(x)), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(vectors)
    assert np.allclose(found[0].weights, [*other.coefficients.toArray(), other.intercept], atol=1e-4)


def test_support_vectors(spark):
    """Each inner fit is at the least squared hinge loss of the rows outside its fold, and its sigmoid at the least logistic
    loss of the fold's margins, with targets pulled in."""
    x, y = made(2)
    df = table(spark, x, y)
    found = ln.fit_calibrated_svc(df, 0.3, folds=4, inner=3)
    dealt = {r["id"]: r["fold"] for r in ln.mt.stratified_folds(df.drop("fold"), "id", "label", 3, 43).collect()}
    inner = np.array([dealt[i] for i in range(len(x))])
    sign = 2 * y - 1
    for m, fitted in enumerate(found):
        outer = np.arange(len(x)) % 4 != m - 1 if m else np.ones(len(x), bool)
        for part, (weights, curve) in enumerate(zip(fitted.weights, fitted.sigmoids, strict=True)):
            use, out = outer & (inner != part), outer & (inner == part)

            def hinge(w, use=use):
                return 0.3 * (np.maximum(0, 1 - sign[use] * (x[use] @ w[:-1] + w[-1])) ** 2).sum() + (w**2).sum() / 2

            assert np.abs(slopes(hinge, weights)).max() < 1e-2
            margin, ones = x[out] @ weights[:-1] + weights[-1], y[out].sum()
            target = np.where(y[out] > 0, (ones + 1) / (ones + 2), 1 / (len(margin) - ones + 2))

            def loss(ab, margin=margin, target=target):
                t = ab[0] * margin + ab[1]
                return (np.logaddexp(0, t) - target * t).sum()

            assert np.abs(slopes(loss, curve)).max() < 1e-2
        assert ((fitted.score(x) > 0.5) == y).mean() > 0.75
    again = ln.Calibrated.from_json(found[0].to_json())
    assert (again.score(x) == found[0].score(x)).all()


@pytest.mark.parametrize("fit", [ln.fit_logistic, ln.fit_calibrated_svc])
def test_poor_tables(spark, fit):
    schema = "id long, label int, features array<double>"
    assert len(fit(spark.createDataFrame([], schema))[0].score(np.zeros((0, 0)))) == 0
    alike = spark.createDataFrame([(i, 1, [float(i % 3), 1.0]) for i in range(30)], schema)
    assert (fit(alike)[0].score(np.array([[0.0, 1.0], [2.0, 1.0]])) > 0.5).all()
    split = spark.createDataFrame([(i, i % 2, [100.0 * (i % 2), 0.0]) for i in range(40)], schema)
    scores = fit(split)[0].score(np.array([[0.0, 0.0], [100.0, 0.0]]))
    assert scores[0] < 0.5 < scores[1]
    assert split.agg(F.count("*")).first()[0] == 40
