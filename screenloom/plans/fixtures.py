"""Inputs of the registered queries, derived from the given tables. Every input covers its whole table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.dims.domain import EDUCATION_LEVEL, FIELD_SCORE, SKILL_VOCABULARY, TITLE_SCORE
from screenloom.functions.text import parse_skills, resume_text

AS_OF = dt.date(2024, 1, 31)
JOBS = 25
EDUCATION = [*EDUCATION_LEVEL, "Bootcamp"]
FIELDS = [*FIELD_SCORE, "History"]
TITLES = [*TITLE_SCORE, "Teacher"]
CLAUSES = ["{r} years of experience", "Minimum {r} years", "At least {r} years", "{r}+ years industry", ""]
EVENT_STAGE = {
    "signup": "shortlisted",
    "view": "interview_scheduled",
    "click": "interviewed",
    "purchase": "selected",
    "error": "rejected",
}
RESUME_EXTRAS = " c++ c# ci/cd node.js www.netflix.com react native https://a.b/c Python's"
RESUME_HEADS = ["Name: Priya Sharma. ", "Arjun Mehta\n", "5+ years of experience. ", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], position: Column) -> Column:
    """Value at a 0-based position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def skill_list(k: Column) -> Column:
    """0 to 10 distinct vocabulary skills, joined by commas."""
    n = (k * 5 % 11).cast("int")
    vocabulary = F.array(*[F.lit(v) for v in SKILL_VOCABULARY])
    picked = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.element_at(vocabulary, ((k * 3 + i * 7) % 40 + 1).cast("int"))
    )
    return F.when(n > 0, F.array_join(picked, ", "))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    skills = F.coalesce(skill_list(k), F.when(k % 2 == 1, "None"))
    certifications = F.when(k % 4 == 1, "None").when(k % 4 >= 2, "AWS Certified")
    profile = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("candidate_id"),
        k.alias("ord"),
        F.col("c_name").alias("name"),
        F.when(k % 97 != 0, (21 + k * 7 % 45).cast("double")).alias("age"),
        pick(["Male", "Female", "Other"], k % 3).alias("gender"),
        pick(EDUCATION, k % 7).alias("education_level"),
        pick(FIELDS, k % 17).alias("field_of_study"),
        (k * 13 % 41 / 2.0).alias("experience_years"),
        skills.alias("skills_text"),
        certifications.alias("certifications"),
        pick(TITLES, k % 16).alias("current_job_title"),
    )
    objective = F.concat(F.lit("Seeking "), F.col("current_job_title"), F.lit(" role"))
    return profile.withColumn("target_job_description", objective)


def with_resume_text(profiles: DataFrame) -> DataFrame:
    text = resume_text(
        "name", "education_level", "field_of_study", "experience_years", "current_job_title", "skills_text",
        "certifications", "target_job_description",
    )
    return profiles.withColumn("resume_text", text)


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns ranking needs."""
    profiles = with_resume_text(candidates(spark, sf_dir))
    return profiles.select("candidate_id", "ord", "name", "experience_years", "resume_text")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    wanted = F.concat_ws(", ", *[pick(SKILL_VOCABULARY, (k * 5 + i * 11) % 40) for i in range(4)])
    years = F.concat((k % 6 + 1).cast("string"), F.when(k % 4 == 3, ".5").otherwise(""))
    clause = F.replace(pick(CLAUSES, k % 5), F.lit("{r}"), years)
    text = F.concat(F.lit("Looking for a "), pick(TITLES, k % 16), F.lit(" with "), wanted, F.lit(". "), clause)
    jd_text = F.when(k == 23, "   ").when(k == 24, "Friendly people wanted.").otherwise(text)
    return table(spark, sf_dir, "nation").select(k.cast("string").alias("jd_id"), jd_text.alias("jd_text"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is an application of its customer to a job; repeated applications count once."""
    orders = table(spark, sf_dir, "orders")
    pairs = orders.select(
        F.col("o_custkey").cast("string").alias("candidate_id"),
        (F.col("o_orderkey") % JOBS).cast("string").alias("jd_id"),
    )
    return pairs.distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(table(spark, sf_dir, "documents"))


def as_documents(texts: DataFrame) -> DataFrame:
    """Resume documents: the given texts with a head line and a skill line."""
    k = F.col("doc_id")
    extras = F.when(k % 10 == 0, RESUME_EXTRAS).otherwise("")
    skills = F.coalesce(skill_list(k), F.lit(""))
    text = F.concat(pick(RESUME_HEADS, k % 4), F.col("text"), F.lit(" Skills: "), skills, extras)
    return texts.select("doc_id", text.alias("text"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select(
        "candidate_id", "ord", "name", "experience_years", parse_skills(F.col("skills_text")).alias("skills")
    )


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction record per customer; some fields are left unchanged or blank."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("candidate_id"),
        F.when(k % 3 == 0, F.concat(F.lit("Corrected "), F.col("c_name"))).alias("corrected_name"),
        F.when(k % 5 == 0, k % 30 / 2.0).alias("corrected_years"),
        F.when(k % 4 == 0, "Terraform, Kafka").when(k % 4 == 1, "  ").alias("manual_skills"),
    )


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_stage_events(table(spark, sf_dir, "events"))


def as_stage_events(events: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for item in EVENT_STAGE.items() for x in item]
    return events.select(
        F.col("user_id").cast("string").alias("candidate_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.element_at(F.create_map(*pairs), F.col("event_type")).alias("new_state"),
        (F.col("event_id") % 50 == 0).alias("forced"),
    )


MODELS = [37, 53, 71]


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three made-up models for every labelled document."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    sizes = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    models = F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("m")
    joined = labels.join(sizes, "doc_id").select("doc_id", "y", "n_chars", models)
    score = F.col("n_chars") * F.col("m") % 1000 / 1000.0
    return joined.select(
        "doc_id",
        F.concat(F.lit("model_"), F.col("m").cast("string")).alias("model"),
        "y",
        score.alias("score"),
        (score >= 0.5).cast("int").alias("yhat"),
    )


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *NUMERIC)


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy from the part catalogue: type -> name -> brand and sized name."""
    return table(spark, sf_dir, "part").select(
        F.array(F.col("p_partkey").cast("long")).alias("ord"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("canonical"),
        F.array("p_brand", F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("aliases"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
