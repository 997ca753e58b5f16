"""Scoring and ranking of applications, one (candidate, job) pair per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.functions import scores as s
from screenloom.functions.text import required_experience, strip
from screenloom.operators.positions import with_position
from screenloom.operators.skills import Matcher
from screenloom.session import stage

TIE_BLOCK = 1 << 16


def job_skills(jobs: DataFrame, matcher: Matcher) -> DataFrame:
    """Jobs with their skills and required experience."""
    with_skills = matcher.skills(jobs, "jd_text", out="jd_skills")
    return with_skills.withColumn("required_years", required_experience(F.col("jd_text")))


def valid_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.size("jd_skills") > 0)


def invalid_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that cannot be ranked, with the reason."""
    reason = F.when(strip(F.col("jd_text")) == "", "empty job description").otherwise("no known skills")
    return jobs.where(F.size("jd_skills") == 0).select("jd_id", "jd_text", reason.alias("reason"))


def apply_to_all(candidates: DataFrame, jd_ids: list[str]) -> DataFrame:
    """Applications of every candidate to each of a few named jobs."""
    jobs = F.explode(F.array(*[F.lit(j) for j in jd_ids]))
    return candidates.select("candidate_id", jobs.alias("jd_id"))


def score_columns() -> list[tuple[str, Column]]:
    # Canonical skills are distinct within a list, so set sizes are the counts.
    matched = F.size(F.array_intersect("skills", "jd_skills"))
    wanted = F.size("jd_skills")
    extra = F.size("skills") - matched
    return [
        ("jd_coverage", s.jd_coverage(matched, wanted)),
        ("breadth_bonus", s.breadth_bonus(extra)),
        ("keyword_sim", s.keyword_similarity(matched, wanted)),
        ("experience_score", s.experience_score(F.coalesce("experience_years", F.lit(0.0)), F.col("required_years"))),
    ]


def score_applications(candidates: DataFrame, jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """Scores of every application to a valid job.

    ``candidates`` carry ``skills`` and ``jobs`` carry ``jd_skills``. Both joins are equi-joins; a job that draws a
    large share of all applications is broadcast with its table when that is small, else split by the adaptive
    skew join.
    """
    pairs = applications.join(valid_jobs(jobs), "jd_id").join(candidates, "candidate_id")
    scored = pairs.withColumns(dict(score_columns()))
    total = s.match_score(
        F.col("jd_coverage"), F.col("keyword_sim"), F.col("breadth_bonus"), F.col("experience_score")
    )
    return scored.withColumn("match_score", total)


def rank(scored: DataFrame) -> DataFrame:
    """Rank within each job by score, ties by input order.

    Scores have four decimals, so a job has at most some ten thousand of them; ties are split into blocks of the
    input order. No task sees more than one block of one score of one job.
    """
    leveled = scored.withColumn("_block", F.floor(F.col("ord") / TIE_BLOCK))
    levels = [("match_score", False), ("_block", True)]
    return with_position(leveled, ["jd_id"], levels, [F.col("ord")], "rank").drop("_block")


def rank_candidates(
    candidates: DataFrame, jobs: DataFrame, applications: DataFrame, matcher: Matcher
) -> DataFrame:
    """Extract skills of both sides, score and rank every application."""
    with_skills = matcher.skills(candidates, "resume_text").drop("resume_text")
    scored = score_applications(with_skills, job_skills(jobs, matcher), applications)
    return rank(stage(scored.drop("jd_text"), "scored"))


def rank_for_job(candidates: DataFrame, jd_text: str, matcher: Matcher) -> DataFrame:
    """All candidates against one job; a job without known skills is an error."""
    spark = candidates.sparkSession
    job = spark.createDataFrame([("job", jd_text)], "jd_id string, jd_text string")
    if not valid_jobs(job_skills(job, matcher)).take(1):
        raise ValueError("No valid skills found in the job description: name skills such as Python or Docker.")
    return rank_candidates(candidates, job, apply_to_all(candidates, ["job"]), matcher)


# ---- views of a ranking ----------------------------------------------------------------------------------------


def screening_result(ranked: DataFrame) -> DataFrame:
    return ranked.select("jd_id", "candidate_id", "name", "rank", "match_score", "skills")


def top_ranked(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.where(F.col("rank") <= n)


def degenerate_jobs(scored: DataFrame) -> DataFrame:
    """Jobs whose applications all have the same score."""
    spread = scored.groupBy("jd_id").agg(
        F.min("match_score").alias("low"), F.max("match_score").alias("high"), F.count("*").alias("applications")
    )
    return spread.select("jd_id", "applications", (F.col("low") == F.col("high")).alias("degenerate"))


def stale_rankings(current: DataFrame, last_ranked: DataFrame) -> DataFrame:
    """Jobs whose text changed since it was ranked."""
    before = last_ranked.select("jd_id", F.col("jd_text").alias("ranked_text"))
    changed = (F.col("ranked_text") != "") & (strip(F.col("jd_text")) != strip(F.col("ranked_text")))
    return current.join(before, "jd_id").where(changed).select("jd_id", "jd_text", "ranked_text")


def display_skills(limit: int = 10) -> tuple[Column, Column]:
    """Matched skills first, up to ``limit``; and how many are hidden."""
    ordered = F.concat(F.array_intersect("skills", "jd_skills"), F.array_except("skills", "jd_skills"))
    shown = F.slice(ordered, 1, limit)
    return shown, F.size("skills") - F.size(shown)


def apply_corrections(candidates: DataFrame, corrections: DataFrame) -> DataFrame:
    """Overlay corrected names and years; non-blank manual skills are added to the resume text."""
    fixes = corrections.select("candidate_id", "corrected_name", "corrected_years", "manual_skills")
    manual = strip(F.coalesce("manual_skills", F.lit("")))
    text = F.when(manual != "", F.concat_ws(" ", "resume_text", "manual_skills")).otherwise(F.col("resume_text"))
    return (
        candidates.join(fixes, "candidate_id", "left")
        .withColumn("name", F.coalesce("corrected_name", "name"))
        .withColumn("experience_years", F.coalesce("corrected_years", "experience_years"))
        .withColumn("resume_text", text)
        .drop("corrected_name", "corrected_years", "manual_skills")
    )


def preview(candidates: DataFrame) -> DataFrame:
    """Short listing; ``candidates`` carry ``skills`` and optionally ``source``."""
    source = F.col("source") if "source" in candidates.columns else F.lit(None).cast("string")
    first = F.array_join(F.slice("skills", 1, 4), ", ")
    return candidates.select(
        "candidate_id",
        "name",
        F.coalesce("experience_years", F.lit(0.0)).alias("experience_years"),
        F.coalesce(source, F.lit("dataset")).alias("source"),
        F.when(F.size("skills") == 0, "—").otherwise(first).alias("skills_preview"),
    )
