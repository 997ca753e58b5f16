"""Tables of the final report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from screenloom.dims.stages import STATUS_LABELS
from screenloom.functions.scores import label_of, rounded
from screenloom.operators.stages import with_status


def export_candidates(ranked: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Ranked candidates with percentages and their status."""

    def pct(column: str):
        return rounded(F.col(column) * 100, 1).alias(f"{column}_pct")

    skills = F.when(F.size("skills") == 0, "—").otherwise(F.array_join("skills", ", "))
    joined = with_status(ranked, states, keys)
    return joined.select(
        "jd_id", "rank", "candidate_id", F.coalesce("name", F.lit("—")).alias("name"), skills.alias("skills"),
        pct("match_score"), pct("jd_coverage"), pct("experience_score"), pct("keyword_sim"), "status",
        label_of(F.col("status"), STATUS_LABELS).alias("status_label"),
    )


def kpis(counted: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the named tables."""
    rows = [df.agg(F.count("*").alias("value")).select(F.lit(name).alias("kpi"), "value") for name, df in counted.items()]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


def write_report(sheets: dict[str, DataFrame], path: str, file_format: str = "csv") -> dict[str, str]:
    """One table per sheet below ``path``; returns where each was written.

    The report appears whole or not at all: sheets are written to a draft next to ``path``, which takes its place when all are
    done, by a rename of the shared file system. If any sheet fails, the draft goes and what stood at ``path`` stays. (A store
    without renames copies; there a reader can see part of it.)
    """
    if not sheets:
        return {}
    spark = next(iter(sheets.values())).sparkSession
    mark = uuid.uuid4().hex
    draft, old = f"{path}.draft-{mark}", f"{path}.old-{mark}"
    try:
        for name, df in sheets.items():
            writer = df.write.format(file_format)
            if file_format == "csv":
                writer = writer.option("header", True).option("escape", '"')
            writer.save(f"{draft}/{name}")
        store, place = _store(spark, path)
        _, drafted = _store(spark, draft)
        _, aside = _store(spark, old)
        replaced = store.exists(place)
        if replaced and not store.rename(place, aside):
            raise OSError(f"cannot put aside {path}")
        if not store.rename(drafted, place):
            if replaced:
                store.rename(aside, place)
            raise OSError(f"cannot publish {path}")
        if replaced:
            store.delete(aside, True)
    except Exception:
        store, drafted = _store(spark, draft)
        store.delete(drafted, True)
        raise
    return {name: f"{path}/{name}" for name in sheets}


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def read_sheet(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV sheet of a report, with the types it was written with; texts may hold line breaks."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.schema(schema).csv(path)
