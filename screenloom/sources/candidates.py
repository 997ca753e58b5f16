"""Candidate sources: profile files, uploaded texts, seeded samples and demo rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from screenloom.dims.domain import DEMO_NAMES, DEMO_SKILL_BUNDLES
from screenloom.functions.hashing import hash32, hash_pick, hash_uniform
from screenloom.functions.text import guess_experience, guess_name, resume_text, strip
from screenloom.operators.positions import with_position
from screenloom.sources.records import read_csv

# Column names of the candidate file.
PROFILE_SCHEMA = (
    "Name string, Age double, Gender string, Education_Level string, Field_of_Study string, "
    "Experience_Years double, Skills string, Certifications string, Current_Job_Title string, "
    "Target_Job_Description string"
)
PROFILE_NAMES = {
    "Name": "name",
    "Age": "age",
    "Gender": "gender",
    "Education_Level": "education_level",
    "Field_of_Study": "field_of_study",
    "Experience_Years": "experience_years",
    "Skills": "skills_text",
    "Certifications": "certifications",
    "Current_Job_Title": "current_job_title",
    "Target_Job_Description": "target_job_description",
}


def read_profiles(spark: SparkSession, path: str, file_format: str = "csv", id_column: str | None = None) -> DataFrame:
    """Profiles with ``ord``, the place of the row (files by path, rows as they stand in them, from 0), and
    ``candidate_id``: the named column, else ord + 1. Places do not depend on how Spark splits the input. Quoted fields of
    a CSV file may span lines; a large file is read by many tasks all the same."""
    schema = PROFILE_SCHEMA + (f", {id_column} string" if id_column else "")
    if file_format == "csv":
        raw = read_csv(spark, path, StructType.fromDDL(schema), placed=True)
    else:
        loaded = spark.read.schema(schema).format(file_format).load(path)
        raw = loaded.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.lit(0), "_seq": F.monotonically_increasing_id()})
    placed = raw.withColumn("_all", F.lit(0))
    numbered = with_position(placed, ["_all"], [("_file", True), ("_start", True)], [F.col("_seq")], "_place")
    numbered = numbered.withColumn("ord", F.col("_place") - 1)
    ident = F.col(id_column) if id_column else (F.col("ord") + 1).cast("string")
    columns = [F.col(old).alias(new) for old, new in PROFILE_NAMES.items()]
    return numbered.select(ident.alias("candidate_id"), "ord", *columns)


def as_candidates(profiles: DataFrame) -> DataFrame:
    """Profiles with resume text and the display fields kept."""
    text = resume_text(
        "name", "education_level", "field_of_study", "experience_years", "current_job_title", "skills_text",
        "certifications", "target_job_description",
    )
    default_name = F.concat(F.lit("Candidate_"), "candidate_id")
    return profiles.select(
        "candidate_id",
        "ord",
        F.coalesce("name", default_name).alias("name"),
        text.alias("resume_text"),
        F.coalesce("experience_years", F.lit(0.0)).alias("experience_years"),
        F.col("skills_text").alias("raw_skills"),
        F.col("education_level").alias("education"),
        F.col("current_job_title").alias("current_job"),
        "certifications",
    )


def seeded_sample(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, the same ones on every run: a top-n by hash, without a full sort."""
    return df.orderBy(hash_uniform(id_column, seed=seed), id_column).limit(n)


def demo_rows(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A demo candidate per ``position`` (0-based)."""
    names = F.array(*[F.lit(n) for n in DEMO_NAMES])
    name = F.element_at(names, (F.col("position") % len(DEMO_NAMES) + 1).cast("int"))
    bundle = hash_pick(DEMO_SKILL_BUNDLES, "position", seed=f"{seed}-skills")
    text_years = (hash32("position", seed=f"{seed}-text") % 10 + 1).cast("string")
    return ids.select(
        (F.col("position") + 1).cast("string").alias("candidate_id"),
        name.alias("name"),
        F.concat(bundle, F.lit(" "), text_years, F.lit(" years experience")).alias("resume_text"),
        (hash32("position", seed=f"{seed}-years") % 10 + 1).cast("double").alias("experience_years"),
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: (stem, text). Bytes that are no UTF-8 are dropped."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    decoded = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    return files.select(F.regexp_replace(name, r"\.(pdf|txt)$", "").alias("stem"), decoded.alias("text"))


def as_uploads(texts: DataFrame) -> DataFrame:
    """Candidates from uploaded texts; blank texts are rejected."""
    text = F.col("text")
    return texts.where(strip(text) != "").select(
        F.concat(F.lit("PDF_"), "stem").alias("candidate_id"),
        guess_name(text).alias("name"),
        text.alias("resume_text"),
        guess_experience(text).alias("experience_years"),
        F.lit("pdf_upload").alias("source"),
        F.col("stem").alias("filename"),
    )
