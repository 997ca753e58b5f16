"""Classification metrics over a long table of predictions (model, id, y, yhat, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom.dims.domain import CLASS_NAMES
from screenloom.functions.hashing import hash32
from screenloom.functions.scores import rounded
from screenloom.operators.positions import running_totals, same_keys_join, with_position

SCORE_BINS = 1024
HASH_BLOCK = 1 << 16  # 65,536 hash blocks

# Metric names in display order.
METRICS = [
    "train_accuracy", "test_accuracy", "precision", "recall", "f1_score", "fpr", "fnr", "roc_auc", "mse", "rmse",
    "mae", "cv_mean", "cv_std",
]

# Which metrics each chart shows.
CHARTS = {
    "train_vs_test_accuracy": ["train_accuracy", "test_accuracy"],
    "precision_recall_f1": ["precision", "recall", "f1_score"],
    "fpr_fnr_comparison": ["fpr", "fnr"],
    "roc_auc_comparison": ["roc_auc"],
    "cv_comparison": ["cv_mean", "cv_std", "test_accuracy"],
    "error_metrics": ["mse", "rmse", "mae"],
    "metric_dashboard": ["test_accuracy", "precision", "recall", "f1_score", "roc_auc"],
    "f1_score_comparison": ["f1_score"],
    "fpr_comparison": ["fpr"],
    "fnr_comparison": ["fnr"],
    "precision_comparison": ["precision"],
    "recall_comparison": ["recall"],
}


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def confusion(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with tn, fp, fn, tp."""
    y, yhat = F.col("y"), F.col("yhat")
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    counts = [F.count_if((y == a) & (yhat == p)).alias(name) for name, (a, p) in cells.items()]
    return predictions.groupBy(*keys).agg(*counts)


def confusion_matrix(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Long form with all four cells, empty ones included."""
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
        for c, a, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ]
    return confusion(predictions, keys).select(*keys, F.inline(F.array(*cells)))


def rates() -> dict[str, Column]:
    """Metrics that follow from the four counts. With labels 0 and 1 both errors equal the miss rate."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    miss = _ratio(fp + fn, total)
    return {
        "accuracy": _ratio(tn + tp, total),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": _ratio(fp, fp + tn),
        "fnr": _ratio(fn, fn + tp),
        "mse": miss,
        "rmse": F.sqrt(miss),
        "mae": miss,
    }


def binary_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    return confusion(predictions, keys).withColumns(rates()).select(*keys, *rates())


def class_report(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages and accuracy."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def values(hit: Column, wrong: Column, missed: Column) -> list[Column]:
        return [
            _ratio(hit, hit + wrong),
            _ratio(hit, hit + missed),
            _ratio(2 * hit, 2 * hit + wrong + missed),
            (hit + missed).cast("double"),
        ]

    negative, positive = values(tn, fn, fp), values(tp, fp, fn)
    total = (tn + fp + fn + tp).cast("double")
    macro = [(a + b) / 2 for a, b in zip(negative[:3], positive[:3])] + [total]
    weighted = [
        _ratio(a * negative[3] + b * positive[3], total) for a, b in zip(negative[:3], positive[:3])
    ] + [total]
    accuracy = [_ratio(tn + tp, total)] * 3 + [total]
    rows = [
        F.struct(F.lit(name).alias("class"), *[v.alias(n) for v, n in zip(row, ("precision", "recall", "f1", "support"))])
        for name, row in zip([*CLASS_NAMES, "accuracy", "macro avg", "weighted avg"], (negative, positive, accuracy, macro, weighted))
    ]
    return confusion(predictions, keys).select(*keys, F.inline(F.array(*rows)))


def class_counts(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class, tp, fp, fn) for any number of classes: all that occur as label or prediction."""
    cells = predictions.groupBy(*keys, "y", "yhat").agg(F.count("*").alias("n"))
    hit = F.col("y") == F.col("yhat")
    entries = F.array(
        F.struct(F.col("y").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("yhat").alias("class"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"),
                 F.lit(0).cast("long").alias("fn")),
    )
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    return cells.select(*keys, F.inline(entries)).groupBy(*keys, "class").agg(*sums)


def macro_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of any number of classes: precision, recall and F1 are means over the classes; the rates of false alarms
    and misses belong to two classes and are 0 here."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    means = class_counts(predictions, keys).groupBy(*keys).agg(
        F.avg(_ratio(tp, tp + fp)).alias("precision"),
        F.avg(_ratio(tp, tp + fn)).alias("recall"),
        F.avg(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1_score"),
    )
    miss = F.col("y") - F.col("yhat")
    whole = predictions.groupBy(*keys).agg(
        F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("accuracy"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("fnr"),
        F.avg(miss * miss).alias("mse"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(F.abs(miss)).alias("mae"),
    )
    return same_keys_join(whole, means, keys).select(*keys, *rates())


# ---- ranking quality -------------------------------------------------------------------------------------------


def _cumulative(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Per distinct score: positives and negatives at it and above it. Score bins bound every window."""
    binned = predictions.where(F.col("score").isNotNull()).withColumn("_bin", F.floor(F.col("score") * SCORE_BINS))
    measures = {"pos": F.col("y").cast("long"), "neg": (1 - F.col("y")).cast("long")}
    return running_totals(binned, keys, [("_bin", False), ("score", False)], measures)


def _class_totals(predictions: DataFrame, keys: list[str]) -> DataFrame:
    scored = predictions.where(F.col("score").isNotNull())
    return scored.groupBy(*keys).agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg"))


def roc_curve(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Points by falling threshold, equal scores together, starting at the origin."""
    points = _cumulative(predictions, keys).join(_class_totals(predictions, keys), keys)
    curve = points.select(
        *keys,
        F.col("score").alias("threshold"),
        _ratio(F.col("neg_before") + F.col("neg"), F.col("n_neg")).alias("fpr"),
        _ratio(F.col("pos_before") + F.col("pos"), F.col("n_pos")).alias("tpr"),
    )
    origin = _class_totals(predictions, keys).select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(curve)


def roc_auc(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half; 0 with one class only."""
    wins = (F.col("neg") * (F.col("pos_before") + F.col("pos") / 2)).alias("wins")
    area = _cumulative(predictions, keys).select(*keys, wins).groupBy(*keys).agg(F.sum("wins").alias("wins"))
    joined = area.join(_class_totals(predictions, keys), keys)
    return joined.select(*keys, _ratio(F.col("wins"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"))


# ---- splits ----------------------------------------------------------------------------------------------------


def _shuffled_position(df: DataFrame, key: str, label: str, seed: int | str) -> DataFrame:
    hashed = df.withColumn("_hash", hash32(key, seed=seed)).withColumn(
        "_block", F.floor(F.col("_hash") / HASH_BLOCK)
    )
    order = [F.col("_hash"), F.col(key)]
    return with_position(hashed, [label], [("_block", True)], order, "_position").drop("_hash", "_block")


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly the rounded share of each label (no label is a class of its own), chosen by hash."""
    wanted = df.groupBy(label).agg(F.floor(F.count("*") * test_size + 0.5).alias("_wanted"))
    placed = same_keys_join(_shuffled_position(df, key, label, f"{seed}-split"), wanted, [label])
    return placed.withColumn("is_test", F.col("_position") <= F.col("_wanted")).drop("_position", "_wanted")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: each label is dealt out evenly."""
    placed = _shuffled_position(df, key, label, f"{seed}-fold")
    return placed.withColumn("fold", ((F.col("_position") - 1) % folds).cast("int")).drop("_position")


def cv_scores(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of accuracy over folds."""
    per_fold = predictions.groupBy(*keys, "fold").agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("a"))
    return per_fold.groupBy(*keys).agg(F.avg("a").alias("cv_mean"), F.stddev_pop("a").alias("cv_std"))


def label_distribution(labels: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share of each class; as many rows as classes."""
    counts = labels.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", F.col("n") / total)


def class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: total / (classes x count)."""
    counts = labels.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    weight = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return counts.withColumn("weight", weight)


# ---- summaries -------------------------------------------------------------------------------------------------


def long_metrics(wide: DataFrame, names: list[str]) -> DataFrame:
    """(model, metric, value) from one row per model."""
    entries = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
    return wide.select("model", F.inline(F.array(*entries)))


def model_summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per model, four decimals, best test accuracy first."""
    wide = metrics.groupBy("model").pivot("metric", names).agg(F.first("value"))
    return wide.select("model", *[rounded(F.col(m)).alias(m) for m in names]).orderBy(
        F.desc("test_accuracy"), "model"
    )


def best_model(metrics: DataFrame, order: dict[str, int]) -> DataFrame:
    """Model with the highest test accuracy; the one listed first wins ties."""
    pairs = [F.lit(x) for item in order.items() for x in item]
    position = F.coalesce(F.element_at(F.create_map(*pairs), F.col("model")), F.lit(len(order)))
    accuracy = metrics.where(F.col("metric") == "test_accuracy")
    best = F.max_by("model", F.struct("value", -position)).alias("model")
    return accuracy.agg(best, F.max("value").alias("test_accuracy"))


def chart_metrics(metrics: DataFrame) -> DataFrame:
    """(chart, model, metric, value) for every chart that compares models."""
    shown = [F.struct(F.lit(c).alias("chart"), F.lit(m).alias("metric")) for c, ms in CHARTS.items() for m in ms]
    charts = F.filter(F.array(*shown), lambda s: s["metric"] == F.col("metric"))
    return metrics.select("model", "value", F.inline(charts)).select("chart", "model", "metric", "value")
