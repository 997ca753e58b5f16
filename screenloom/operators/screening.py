"""The whole run over one ranking: schedule the best, move stages, ask questions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.operators import questions as qs
from screenloom.operators import scheduling as sc
from screenloom.operators import stages as st
from screenloom.session import stage

INTERVIEWED = 5


@dataclass(frozen=True)
class ScreeningRun:
    ranked: DataFrame
    scheduled: DataFrame
    states: DataFrame
    questions: DataFrame


def run(
    ranked: DataFrame,
    jobs: DataFrame,
    current: DataFrame,
    as_of: dt.date,
    bank: DataFrame,
    interviewed: int = INTERVIEWED,
    n_per_skill: int = 3,
) -> ScreeningRun:
    """``ranked`` comes from ``ranking.rank_candidates`` and is written once; ``current`` holds known stages."""
    ranked = stage(ranked, "ranked")
    calendars = jobs.select(F.col("jd_id").alias("calendar_id"), F.lit(as_of).alias("as_of"))
    best = ranked.where(F.col("rank") <= interviewed)
    requests = best.select(F.col("jd_id").alias("calendar_id"), F.col("rank").alias("position"), "candidate_id")
    scheduled = sc.schedule(requests, sc.slot_calendar(calendars)).withColumnRenamed("calendar_id", "jd_id")
    synced = st.sync_after_scheduling(ranked, scheduled, current, carry=("rank",))
    slots = scheduled.where(~F.col("conflict")).select(
        "jd_id", "candidate_id", sc.slot_text(F.col("slot")).alias("slot")
    )
    states = synced.join(slots, ["jd_id", "candidate_id"], "left").select(
        "jd_id", "candidate_id", "rank", "slot", "state"
    )
    # The best candidate of each job is asked; the same person may lead several jobs.
    leaders = ranked.where(F.col("rank") == 1).select(
        F.concat_ws("/", "jd_id", "candidate_id").alias("candidate_id"), "skills", "experience_years"
    )
    return ScreeningRun(ranked, scheduled, states, qs.generate_questions(leaders, bank, n_per_skill))
