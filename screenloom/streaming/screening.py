"""Continuous screening of arriving resumes against known jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.functions import scores as s
from screenloom.operators.ranking import score_columns, valid_jobs
from screenloom.operators.skills import Matcher


def screen_stream(resumes: DataFrame, jobs: DataFrame, matcher: Matcher) -> DataFrame:
    """Scores of a stream of (candidate_id, jd_id, resume_text, experience_years); no state is kept.

    ``jobs`` is a table with skills (``ranking.job_skills``), joined anew in every micro-batch.
    """
    with_skills = matcher.skills(resumes, "resume_text").drop("resume_text")
    scored = with_skills.join(valid_jobs(jobs), "jd_id").withColumns(dict(score_columns()))
    total = s.match_score(
        F.col("jd_coverage"), F.col("keyword_sim"), F.col("breadth_bonus"), F.col("experience_score")
    )
    return scored.withColumn("match_score", total)
