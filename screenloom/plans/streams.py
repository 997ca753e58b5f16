"""Queries that run as streams over the given tables until nothing is left, then read their sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenloom.functions.text import guess_experience
from screenloom.operators.ranking import job_skills
from screenloom.plans import fixtures as fx
from screenloom.plans.oracle_inputs import r, with_inputs
from screenloom.plans.registry import CHECKS, query
from screenloom.plans.screening import starter_matcher
from screenloom.session import new_path
from screenloom.streaming import sources as so
from screenloom.streaming import stages as ss
from screenloom.streaming.screening import screen_stream


def event_stream(spark, d):
    schema = fx.table(spark, d, "events").schema
    return fx.as_stage_events(so.file_stream(spark, d, "events.parquet", schema))


def stage_log(spark, d):
    return so.append_to_table(ss.transition_stream(event_stream(spark, d)), "stage_log")


@query("stream_transition_log", CHECKS["transition_log"])
def stream_transition_log(spark, d):
    log = spark.read.schema(ss.LOG_SCHEMA).parquet(stage_log(spark, d))
    return log.select("candidate_id", "event_id", "previous", "requested", "state", "success")


@query(
    "stream_funnel",
    f"SELECT state AS stage, count(*) AS candidates FROM ({CHECKS['stage_upsert']}) GROUP BY 1",
)
def stream_funnel(spark, d):
    """Live counts per stage: a second stream over the log of the first."""
    log = so.file_stream(spark, stage_log(spark, d), "*.parquet", ss.LOG_SCHEMA)
    path = so.batches_to_table(ss.funnel_changes(log), "funnel", "update")
    return so.latest_rows(spark, path, ["stage"], ["candidates"]).where(F.col("candidates") > 0)


@query(
    "stream_daily_requests",
    with_inputs(
        "pev", "SELECT strftime(ts, '%Y-%m-%d') AS day, new_state, count(*) AS requests FROM pev GROUP BY 1, 2"
    ),
)
def stream_daily_requests(spark, d):
    path = so.batches_to_table(ss.daily_requests(event_stream(spark, d)), "daily", "update")
    return so.latest_rows(spark, path, ["day", "new_state"], ["requests"])


_EXPERIENCE = CHECKS["guess_experience"]
_SCREEN = {
    "years": "SELECT doc_id, years FROM (" + _EXPERIENCE + ")",
    "jobs": with_inputs(
        "", "SELECT jd_id, required_years, n_jd, jd_skills FROM (SELECT DISTINCT jd_id, required_years, n_jd, jd_skills "
        "FROM scored_pairs)"
    ),
    "pairs": """SELECT 'PDF_' || d.doc_id::VARCHAR AS candidate_id, j.jd_id, y.years, j.required_years, j.n_jd,
  len(list_intersect(coalesce(h.skills, []), j.jd_skills)) AS matched, len(coalesce(h.skills, [])) AS n_skills
 FROM docs d JOIN jobs j ON j.jd_id = (d.doc_id%25)::VARCHAR JOIN years y USING (doc_id)
 LEFT JOIN (SELECT doc_id, list(canonical) AS skills FROM doc_hits GROUP BY 1) h USING (doc_id)""",
}


@query(
    "stream_screen",
    with_inputs(
        "docs doc_hits scored_pairs",
        f"""SELECT candidate_id, jd_id, {r('''0.55*floor(matched::DOUBLE/n_jd*1e4+0.5)/1e4 + 0.1*(matched::DOUBLE/n_jd)
  + 0.1*least(0.2::DOUBLE, floor((n_skills-matched)*0.04::DOUBLE*1e4+0.5)/1e4)
  + 0.25*CASE WHEN required_years = 0 THEN 0.7::DOUBLE WHEN years >= required_years THEN
   least(1.0::DOUBLE, 0.7::DOUBLE + 0.06::DOUBLE*(years-required_years))
   ELSE greatest(0.0::DOUBLE, 0.5::DOUBLE*years/required_years) END''', 4)} AS match_score FROM pairs""",
        _SCREEN,
    ),
)
def stream_screen(spark, d):
    """Each arriving document applies to one job."""
    matcher = starter_matcher(spark)
    schema = fx.table(spark, d, "documents").schema
    arriving = fx.as_documents(so.file_stream(spark, d, "documents.parquet", schema))
    resumes = arriving.select(
        F.concat(F.lit("PDF_"), F.col("doc_id").cast("string")).alias("candidate_id"),
        (F.col("doc_id") % fx.JOBS).cast("string").alias("jd_id"),
        F.col("text").alias("resume_text"),
        guess_experience(F.col("text")).alias("experience_years"),
    )
    scored = screen_stream(resumes, job_skills(fx.jobs(spark, d), matcher), matcher)
    kept = scored.select("candidate_id", "jd_id", "match_score")
    return spark.read.schema(kept.schema).parquet(so.append_to_table(kept, "screened"))


@query("stream_transition_log_delayed", CHECKS["transition_log"])
def stream_transition_log_delayed(spark, d):
    """The events in four micro-batches of files that overlap in time, in an order of their own, and a last one far ahead: events
    wait for the watermark, and the log equals the batch log."""
    events = fx.stage_events(spark, d)
    folder = new_path(spark, "shuffled-events")
    files = events.rdd.getNumPartitions()  # of a micro-batch, each written by a task of its own
    for part in range(4):
        events.where(F.col("event_id") % 4 == (part * 3 + 2) % 4).repartition(files).write.mode("append").parquet(folder)
    end = events.agg(F.max("ts").alias("ts")).select(
        F.lit("_end").alias("candidate_id"), F.lit(-1).cast("long").alias("event_id"),
        F.explode(F.array(*[F.col("ts") + F.expr(f"INTERVAL {400 + k} DAYS") for k in range(2)])).alias("ts"),
        F.lit("rejected").alias("new_state"), F.lit(False).alias("forced"),
    )
    end.coalesce(1).write.mode("append").parquet(folder)
    arriving = so.file_stream(spark, folder, "*.parquet", events.schema, files_per_batch=files)
    log = spark.read.schema(ss.LOG_SCHEMA).parquet(so.append_to_table(ss.transition_stream(arriving, delay="390 days"), "log"))
    rows = log.where("candidate_id <> '_end'")
    return rows.select("candidate_id", "event_id", "previous", "requested", "state", "success")


@query(
    "stream_promotions",
    with_inputs(
        "pev",
        """SELECT candidate_id, slot, count(*) AS interviews FROM (
  SELECT candidate_id, ts + INTERVAL 2 HOURS AS slot, (SELECT max(ts) FROM pev) AS last FROM pev
  WHERE new_state = 'interview_scheduled') WHERE slot <= last - INTERVAL 1 HOUR GROUP BY 1, 2""",
    ),
)
def stream_promotions(spark, d):
    """Interviews two hours after they were agreed; the watermark stands one hour before the latest event."""
    slot = F.when(F.col("new_state") == "interview_scheduled", F.col("ts") + F.expr("INTERVAL 2 HOURS"))
    agreed = event_stream(spark, d).select("candidate_id", "ts", slot.alias("slot"))
    promoted = ss.promotion_stream(agreed, "1 hour")
    path = so.append_to_table(promoted, "promotions")
    return spark.read.schema(promoted.schema).parquet(path).groupBy("candidate_id", "slot").agg(F.count("*").alias("interviews"))
