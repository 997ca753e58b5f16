"""From raw documents to token files: five stages, each one operator over all rows its predecessor kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from screenloom.llm import decontam, mixing, quality_gam, simhash, token_files
from screenloom.llm.queries import tokenizer_file
from screenloom.session import ship_package, stage

Step = Callable[[SparkSession, DataFrame, str], DataFrame]
ORACLE_SQL = None  # a fitted classifier, fingerprints, alignments and a tokenizer are beyond SQL


def _with_package(step: Step) -> Step:
    """The step, with the package handed to the Python workers first, wherever the session was started."""

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return step(spark, docs, sf_dir)

    return run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; rejected ones go."""
    model = quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gam.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, that with the least id."""
    return simhash.keep_one(docs, shingle=3, distance=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per use of a document, so some rows repeat and some go."""
    return mixing.realise(docs, mixing.plan(docs)).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: one row per document row with its place among all ids."""
    return token_files.round_trip(docs, tokenizer_file(), end_id=2)


STAGES = [
    ("quality classifier", _with_package(quality)),
    ("SimHash near-dedup", _with_package(near_dedup)),
    ("benchmark decontamination", _with_package(decontamination)),
    ("source mixing", _with_package(source_mixing)),
    ("token files", _with_package(token_output)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
