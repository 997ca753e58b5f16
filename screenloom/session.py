"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()  # applications whose workers have the package


def build_session(
    app: str = "screenloom", cpus: str = "*", shuffle_partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """A local session with the settings the jobs expect. On a cluster, submit with the same settings.

    ``shared`` becomes ``spark.checkpoint.dir``, the folder that holds intermediate tables.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, or a part of the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), "screenloom", spark.sparkContext.applicationId)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(_own_folder(spark), f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    For results that are costly to compute (text extraction) and read more than once. The table survives the
    loss of executors, later reads prune its columns, and its size is known to the optimizer.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over as many tasks as shuffles have, or cores if those are more.

    For narrow rows that much work follows from: tables of a few files, or of few bytes, would leave it to a few tasks.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def release(spark: SparkSession) -> None:
    """Delete whatever this application has staged. Tables that read it must have been used by then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to its Python workers, as ``--py-files`` does; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(archive))  # the driver serves it to the executors
    _SHIPPED.add(context.applicationId)
