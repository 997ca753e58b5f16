"""Classifiers on feature vectors, their evaluation, and cross-validation."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Model, classification
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.operators import boosting, linear, perceptron
from screenloom.operators import metrics as mt
from screenloom.operators import neighbors as nn
from screenloom.session import stage

SEED = 42
Scorer = boosting.Ensemble | linear.Calibrated | linear.Linear | perceptron.Perceptron
Predictor = Callable[[DataFrame], DataFrame]  # adds score and yhat


@dataclass(frozen=True)
class Fitted:
    """A trained classifier: an MLlib model, the points of a neighbour vote, or an object whose ``score`` takes a matrix of
    features."""

    predict: Predictor
    model: Model | None = None
    scorer: Scorer | None = None
    points: DataFrame | None = None
    k: int = 0


Trainer = Callable[[DataFrame], Fitted]  # rows: id, label, features


@dataclass(frozen=True)
class FoldTrainer:
    """Fits all rows and the rows outside each fold side by side, in the same passes over them."""

    fit: Callable[[DataFrame, int], list[Fitted]]  # rows with fold, and the number of folds

    def __call__(self, rows: DataFrame) -> Fitted:
        return self.fit(rows, 0)[0]


@dataclass(frozen=True)
class Neighbours:
    """A vote of the k nearest training rows. The vote of all rows and the votes of the rows outside each fold share a search."""

    k: int

    def __call__(self, rows: DataFrame) -> Fitted:
        return _from_points(_points(rows).select("id", "vec", "label"), self.k)

    def votes(self, folded: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Predictions of the rows by all of them, and by those outside their fold (with ``fold``)."""
        every, outside = nn.classify_folds(_points(folded), self.k)
        rows, of_fold = folded.join(every, "id"), folded.join(outside, ["id", "fold"])
        return _predicted(rows, name), _predicted(of_fold, name, "fold")


def _with_prediction(predicted: DataFrame, score: Column) -> DataFrame:
    keep = [c for c in predicted.columns if c not in ("rawPrediction", "probability", "prediction")]
    return predicted.select(*keep, score.alias("score"), F.col("prediction").cast("int").alias("yhat"))


def _from_model(model: Model) -> Fitted:
    def predict(df: DataFrame) -> DataFrame:
        return _with_prediction(model.transform(df), vector_to_array(F.col("probability"))[1])

    return Fitted(predict, model=model)


def compact(rows: DataFrame) -> DataFrame:
    """No more partitions than cores: iterative training runs one job per step over all of them."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def mllib(estimator) -> Trainer:
    def train(rows: DataFrame) -> Fitted:
        return _from_model(estimator.fit(compact(rows)))

    return train


def _from_scorer(scorer) -> Fitted:
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(scorer.score(np.stack(features.to_numpy())) if len(features) else [], dtype="float64")

    scored = F.pandas_udf(score, "double")

    def predict(df: DataFrame) -> DataFrame:
        found = df.withColumn("score", scored(vector_to_array(F.col("features"))))
        return found.withColumn("yhat", (F.col("score") > 0.5).cast("int"))

    return Fitted(predict, scorer=scorer)


def in_passes(fit: Callable[..., list], settings) -> FoldTrainer:
    """A trainer of ``boosting``, ``linear`` or ``perceptron``."""

    def train(rows: DataFrame, folds: int) -> list[Fitted]:
        kept = rows.withColumn("features", vector_to_array(F.col("features")))
        return [_from_scorer(f) for f in fit(kept, settings, folds)]

    return FoldTrainer(train)


def _together(work: Callable, items, spark: SparkSession) -> list:
    """Run independent fits side by side; each is a series of small jobs that leaves cores idle."""
    with ThreadPoolExecutor(len(items)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(work), i) for i in items]]


def _points(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vec", vector_to_array("features")).withColumn("label", F.col("label").cast("int"))


def _from_points(points: DataFrame, k: int) -> Fitted:
    def predict(df: DataFrame) -> DataFrame:
        queries = df.select("id", vector_to_array("features").alias("vec"))
        return df.join(nn.classify(queries, points, k), "id")

    return Fitted(predict, points=points, k=k)


def default_models(max_iter_scale: float = 1.0) -> dict[str, Trainer]:
    """The hyper-parameters. ``max_iter_scale`` shrinks trees and iterations for trials."""

    def n(value: int) -> int:
        return max(1, round(value * max_iter_scale))

    models = {
        "RandomForest": mllib(
            RandomForestClassifier(
                numTrees=n(200), maxDepth=6, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=SEED
            )
        ),
        "LogisticRegression": in_passes(linear.fit_logistic, 0.5),
        "LinearSVC": in_passes(linear.fit_calibrated_svc, 0.3),
        "KNN": Neighbours(11),
        "GradientBoosting": mllib(
            GBTClassifier(maxIter=n(150), maxDepth=4, subsamplingRate=0.8, stepSize=0.05, seed=SEED)
        ),
        "MLP": in_passes(perceptron.fit, perceptron.Settings(epochs=n(200))),
        "RegularizedBoosting": in_passes(boosting.fit, boosting.Settings(trees=n(200))),
    }
    return models


# ---- persistence -----------------------------------------------------------------------------------------------


def save(fitted: Fitted, spark: SparkSession, path: str) -> None:
    """Store a trained classifier below ``path``."""
    kind, detail = "points", str(fitted.k)
    if fitted.model is not None:
        kind, detail = "model", f"{type(fitted.model).__module__}.{type(fitted.model).__name__}"
        fitted.model.write().overwrite().save(f"{path}/model")
    elif fitted.scorer is not None:
        kind, detail = type(fitted.scorer).__name__, fitted.scorer.to_json()
    else:
        fitted.points.write.mode("overwrite").parquet(f"{path}/points")
    about = spark.createDataFrame([(kind, detail)], "kind string, detail string")
    about.coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load(spark: SparkSession, path: str) -> Fitted:
    about = spark.read.schema("kind string, detail string").json(f"{path}/about").first()
    if about["kind"] == "model":
        return _from_model(getattr(classification, about["detail"].rsplit(".", 1)[1]).load(f"{path}/model"))
    for kind in Scorer.__args__:
        if about["kind"] == kind.__name__:
            return _from_scorer(kind.from_json(about["detail"]))
    return _from_points(spark.read.parquet(f"{path}/points"), int(about["detail"]))


# ---- evaluation ------------------------------------------------------------------------------------------------


def predictions(fitted: Fitted, name: str, rows: DataFrame) -> DataFrame:
    """(model, id, y, yhat, score)."""
    return _predicted(fitted.predict(rows), name)


def _predicted(found: DataFrame, name: str, *others: str) -> DataFrame:
    return found.select(F.lit(name).alias("model"), "id", F.col("label").cast("int").alias("y"), "yhat", "score", *others)


def cross_validate(trainer: Trainer, name: str, rows: DataFrame, folds: int = 5) -> DataFrame:
    """(model, cv_mean, cv_std) of the accuracy over stratified folds."""
    folded = stage(mt.stratified_folds(rows, "id", "label", folds, SEED), "folds")

    def one(fold: int) -> DataFrame:
        fitted = trainer(folded.where(F.col("fold") != fold).drop("fold"))
        return stage(_held_out(fitted, name, folded, fold), "held")

    parts = _together(one, range(folds), rows.sparkSession)
    return mt.cv_scores(reduce(DataFrame.unionByName, parts), ["model"])


def _held_out(fitted: Fitted, name: str, folded: DataFrame, fold: int) -> DataFrame:
    held = predictions(fitted, name, folded.where(F.col("fold") == fold).drop("fold"))
    return held.withColumn("fold", F.lit(fold))


def _fitted_and_validated(trainer: Trainer, name: str, rows: DataFrame, folds: int) -> tuple[Fitted, DataFrame, DataFrame | None]:
    """The model fitted on all rows, its predictions of them, and its accuracy over folds (none without folds)."""
    if not folds or not isinstance(trainer, FoldTrainer | Neighbours):
        fitted = trainer(rows)
        return fitted, predictions(fitted, name, rows), cross_validate(trainer, name, rows, folds) if folds else None
    folded = stage(mt.stratified_folds(rows, "id", "label", folds, SEED), "folds")
    if isinstance(trainer, Neighbours):
        every, held = trainer.votes(folded, name)
        return trainer(rows), every, mt.cv_scores(held, ["model"])
    fitted, *by_fold = trainer.fit(folded, folds)
    held = reduce(DataFrame.unionByName, [_held_out(f, name, folded, k) for k, f in enumerate(by_fold)])
    return fitted, predictions(fitted, name, rows), mt.cv_scores(stage(held, "held"), ["model"])


def evaluate(
    trainer: Trainer, name: str, train: DataFrame, test: DataFrame, folds: int = 5
) -> tuple[DataFrame, DataFrame, Fitted]:
    """Long metrics (model, metric, value), test predictions, and the fitted model. 0 folds skips validation."""
    fitted, trained, validated = _fitted_and_validated(trainer, name, train, folds)
    tested = stage(predictions(fitted, name, test), "tested")  # read by several metrics
    accuracy = mt.binary_metrics(trained, ["model"])
    wide = (
        mt.binary_metrics(tested, ["model"])
        .withColumnRenamed("accuracy", "test_accuracy")
        .join(accuracy.select("model", F.col("accuracy").alias("train_accuracy")), "model")
        .join(mt.roc_auc(tested, ["model"]), "model", "left")
        .withColumn("roc_auc", F.coalesce("roc_auc", F.lit(0.0)))
    )
    names = [m for m in mt.METRICS if not m.startswith("cv_")]
    if validated is not None:
        wide = wide.join(validated, "model")
        names = mt.METRICS
    return mt.long_metrics(wide, names), tested, fitted


def feature_importance(fitted: Fitted, names: list[str], spark: SparkSession, top: int = 20) -> DataFrame:
    """The most important features of a tree model."""
    values = fitted.model.featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def actual_vs_predicted(tested: DataFrame) -> DataFrame:
    return tested.select(
        "model", "id", F.col("y").alias("actual"), F.col("score").alias("probability"),
        F.col("yhat").alias("predicted"), (F.col("y") == F.col("yhat")).alias("correct"),
    )

