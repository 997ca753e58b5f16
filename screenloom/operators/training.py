"""From profiles to prepared training and test rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.config import PreprocessConfig
from screenloom.operators.features import FEATURES, build_features, noisy
from screenloom.operators.metrics import stratified_split
from screenloom.operators.oversample import smote
from screenloom.operators.positions import with_position
from screenloom.operators.preprocess import FittedPreprocessor, fit
from screenloom.session import dealt, stage


@dataclass(frozen=True)
class Prepared:
    train: DataFrame  # id, label, features
    test: DataFrame
    fitted: FittedPreprocessor


def prepare(
    profiles: DataFrame,
    key: str,
    cfg: PreprocessConfig | None = None,
    test_size: float = 0.2,
    use_smote: bool = True,
    reference_order: bool = False,
) -> Prepared:
    """Features, label, split, fitted preprocessing and oversampling.

    Statistics come from the training rows. ``reference_order`` fits on all rows before the split, with noise in
    train and test. ``key`` must be unique; ids number the rows in the order of its hash.
    """
    cfg = cfg or PreprocessConfig()
    features = build_features(dealt(profiles, key), key, cfg)  # profiles of one file would be one task's
    hashed = stage(features, "features").withColumn("_hash", F.xxhash64(key)).withColumn("_all", F.lit(0))
    placed = hashed.withColumn("_block", F.shiftright("_hash", 44))
    numbered = with_position(placed, ["_all"], [("_block", True)], [F.col("_hash"), F.col(key)], "id")
    split = stratified_split(numbered.drop("_hash", "_all", "_block"), key, "label", test_size, cfg.random_state)
    split = stage(split, "split")
    basis = split if reference_order else split.where(~F.col("is_test"))
    fitted = fit(basis, FEATURES, key, cfg)
    noise = noisy(FEATURES, key, cfg) if cfg.noise_std else {}
    train_rows = split.where(~F.col("is_test")).withColumns(noise)
    test_rows = split.where("is_test")
    if reference_order:
        test_rows = test_rows.withColumns(noise)
    train = fitted.vectors(train_rows, ["id", "label"])
    test = fitted.vectors(test_rows, ["id", "label"])
    if use_smote:
        arrays = stage(train.select("id", "label", vector_to_array("features").alias("vec")), "train")
        balanced = smote(arrays, cfg.random_state)
        # New rows get ids of their own: below zero, numbered in the order of a hash of their values.
        made = balanced.where("synthetic").withColumn("_hash", F.xxhash64("id", "vec")).withColumn("_all", F.lit(0))
        made = stage(made.withColumn("_block", F.shiftright("_hash", 44)), "made")
        order = [F.col("_hash"), F.col("id"), F.col("vec")]
        numbered = with_position(made, ["_all"], [("_block", True)], order, "_place").withColumn("id", -F.col("_place"))
        given = balanced.where("not synthetic").select("id", "label", "vec")
        every = given.unionByName(numbered.select("id", "label", "vec"))
        train = every.select("id", "label", array_to_vector("vec").alias("features"))
    return Prepared(stage(train, "prepared_train"), stage(test, "prepared_test"), fitted)
