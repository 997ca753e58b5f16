"""Knowledge banks for interview questions.

JSON: {skill: {concepts: {tier: [..]}, coding_patterns: [..], scenarios: [..], design_topics: [..]}}.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.dims.question_bank import STARTER_BANK, TIERS

TOPIC = (
    "struct<concepts:map<string,array<string>>,coding_patterns:array<string>,"
    "scenarios:array<string>,design_topics:array<string>>"
)
BANK = f"map<string,{TOPIC}>"


def _wide(documents: DataFrame) -> DataFrame:
    """(skill, tier, concepts, coding, scenarios, design); a tier without concepts uses the first tier's."""
    none = F.array().cast("array<string>")

    def listed(column: Column) -> Column:
        return F.coalesce(column, none)

    every = documents.select("file", F.explode("bank").alias("skill", "topic"))
    topics = every.groupBy("skill").agg(F.max_by("topic", "file").alias("topic"))  # the last registration counts
    tiers = F.explode(F.array(*[F.lit(t) for t in TIERS])).alias("tier")
    by_tier = topics.select("skill", "topic", tiers)
    concepts = F.coalesce(
        F.element_at(F.col("topic.concepts"), F.col("tier")), F.element_at(F.col("topic.concepts"), F.lit(TIERS[0]))
    )
    return by_tier.select(
        "skill",
        "tier",
        listed(concepts).alias("concepts"),
        listed(F.col("topic.coding_patterns")).alias("coding"),
        listed(F.col("topic.scenarios")).alias("scenarios"),
        listed(F.col("topic.design_topics")).alias("design"),
    )


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """The bank of a file or a folder. A skill that several files register has the topics of the last one, by path. A file
    that is no JSON object is an error that names it."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    wrong = F.raise_error(F.concat(F.lit("no JSON object of skills: "), F.col("file"))).cast(BANK)
    return _wide(files.select("file", F.coalesce(F.from_json("value", BANK), wrong).alias("bank")))


def starter_bank(spark: SparkSession) -> DataFrame:
    document = spark.createDataFrame([(json.dumps(STARTER_BANK),)], "value string")
    return _wide(document.select(F.lit("").alias("file"), F.from_json("value", BANK).alias("bank")))
