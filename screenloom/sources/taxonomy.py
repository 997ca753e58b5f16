"""Skill taxonomies as JSON files: {category: {canonical: [aliases]}}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NESTED = "map<string,map<string,array<string>>>"


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Registration entries (ord, category, canonical, aliases) in file order; several files follow path order.

    ``path`` may be a folder of files, each an object of its own, as ``write_taxonomy`` leaves it. A file that is none is an
    error that names it.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parsed = F.from_json("value", NESTED)
    wrong = F.raise_error(F.concat(F.lit("no JSON object of categories: "), F.col("file"))).cast(NESTED)
    nested = files.select("file", F.coalesce(parsed, wrong).alias("taxonomy"))
    categories = nested.select("file", F.posexplode("taxonomy").alias("c", "category", "skills"))
    skills = categories.select("file", "c", "category", F.posexplode("skills").alias("s", "canonical", "aliases"))
    # A taxonomy has few files; their rank makes the leading part of the order.
    names = sorted(r["file"] for r in files.select("file").distinct().collect())
    ranks = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("file")) if names else F.lit(0)
    return skills.select(
        F.array(*[c.cast("long") for c in (ranks, F.col("c"), F.col("s"))]).alias("ord"),
        "category",
        "canonical",
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
    )


def write_taxonomy(entries: DataFrame, path: str) -> None:
    """A folder with one JSON object per file, categories in registration order over the files; later registrations of
    a (category, canonical) pair replace earlier ones. One category is the most that a row holds."""
    latest = entries.groupBy("category", "canonical").agg(
        F.max_by("aliases", "ord").alias("aliases"), F.min("ord").alias("ord")
    )
    skills = F.array_sort(F.collect_list(F.struct("ord", "canonical", "aliases")))
    by_category = latest.groupBy("category").agg(F.min("ord").alias("ord"), skills.alias("s")).select(
        "ord",
        F.create_map(
            "category", F.map_from_entries(F.transform("s", lambda x: F.struct(x["canonical"], x["aliases"])))
        ).alias("taxonomy"),
    )
    rows = by_category.repartitionByRange("ord").sortWithinPartitions("ord")
    # {"A":{..}} and {"B":{..}} of one file become {"A":{..},\n"B":{..}}
    objects = rows.select(F.to_json("taxonomy").alias("value")).mapInPandas(_one_object, "value string")
    objects.write.mode("overwrite").text(path)


def _one_object(batches):
    import pandas as pd

    parts = [value[1:-1] for batch in batches for value in batch["value"]]
    if parts:
        yield pd.DataFrame({"value": ["{" + ",\n".join(parts) + "}"]})
