"""Streams over arriving files, and sinks that can be read back as tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.session import new_path


def file_stream(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Rows of parquet files called ``name`` (a glob) that arrive in ``folder``. A table of that name that is a folder of part
    files, as Spark writes it, is read from all of them."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, name))
    if table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isDirectory(table):
        return reader.parquet(os.path.join(folder, name))
    return reader.option("pathGlobFilter", name).parquet(folder)


def append_to_table(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> str:
    """Process what is available and append it to a parquet table; returns its path."""
    spark = stream.sparkSession
    path = path or new_path(spark, name)
    run = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or new_path(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start(path)
    )
    run.awaitTermination()
    return path


def batches_to_table(
    stream: DataFrame, name: str, mode: str, work: Callable[[DataFrame], DataFrame] | None = None, checkpoint: str | None = None
) -> str:
    """Write every micro-batch below its own number, so that a repeated batch replaces itself; returns the path."""
    spark = stream.sparkSession
    path = new_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        rows = work(batch) if work else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint or new_path(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return path


def latest_rows(spark: SparkSession, path: str, keys: list[str], values: list[str]) -> DataFrame:
    """The newest row per key of a table written in update mode."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, *[F.col("v")[v].alias(v) for v in values])
