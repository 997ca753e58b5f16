"""Queries on interview slots, stages and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenloom.dims.stages import PRIORITY_LABELS, STAGES, STATUS_LABELS, TRANSITIONS
from screenloom.functions.hashing import hash32
from screenloom.functions.scores import label_of
from screenloom.operators import reports as rp
from screenloom.operators import scheduling as sc
from screenloom.operators import stages as st
from screenloom.plans import fixtures as fx
from screenloom.plans.oracle_inputs import CTES, NEEDS, items, lit, r, with_inputs
from screenloom.plans.registry import query
from screenloom.plans.screening import ranked

PAST = "2024-02-03 12:00:00"

_SLOTS = """SELECT calendar_id, strptime(strftime(day, '%Y-%m-%d') || ' ' || tm, '%Y-%m-%d %H:%M') AS slot FROM (
  SELECT calendar_id, as_of + n::INTEGER AS day, n FROM {calendars}, (SELECT unnest(range(1, 8)) AS n)),
  (SELECT unnest(['09:00','11:00','14:00','16:00']) AS tm) WHERE dayofweek(day) <> 0"""
_JD_CALENDARS = "SELECT jd_id AS calendar_id, DATE '2024-01-31' AS as_of FROM jd"
_STATE = f"(({items(STAGES)})[k%7+1])"

CTES |= {
    "jd_calendars": _JD_CALENDARS,
    "jd_slots": _SLOTS.format(calendars="jd_calendars"),
    "numbered_slots": "SELECT *, row_number() OVER (PARTITION BY calendar_id ORDER BY slot) AS position FROM jd_slots",
    "schedule": """SELECT k.jd_id, k.candidate_id, k.rank, s.slot, CASE WHEN s.slot IS NULL THEN 'no_slots_available'
  ELSE 'scheduled' END AS status, s.slot IS NULL AS conflict
 FROM ranked k LEFT JOIN numbered_slots s ON s.calendar_id = k.jd_id AND s.position = k.rank""",
    "states": f"SELECT k::VARCHAR AS candidate_id, {_STATE} AS state, k AS ord, "
    "CASE WHEN k%10 <> 0 THEN c_name END AS name FROM (SELECT c_custkey AS k, c_name FROM customer)",
    "synced": """SELECT s.jd_id, s.candidate_id, t.state AS before, s.slot, CASE WHEN NOT conflict THEN
  'interview_scheduled' WHEN t.state IS NULL OR t.state IN ('applied','shortlisted') THEN 'rejected' ELSE t.state END
  AS state FROM schedule s LEFT JOIN states t USING (candidate_id)""",
}
NEEDS |= {
    "jd_calendars": ["jd"],
    "jd_slots": ["jd_calendars"],
    "numbered_slots": ["jd_slots"],
    "schedule": ["ranked", "numbered_slots"],
    "synced": ["schedule", "states"],
}


def current_states(spark, d):
    """A stage per customer; some are not in the process. Every tenth has no name."""
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(
        k.cast("string").alias("candidate_id"),
        F.when(k % 7 < 6, fx.pick([*STAGES, ""], k % 7)).alias("state"),
        k.alias("ord"),
        F.when(k % 10 != 0, F.col("c_name")).alias("name"),
    )


def jd_schedule(spark, d, ranking=None):
    ranking = ranked(spark, d) if ranking is None else ranking
    calendars = fx.jobs(spark, d).select(F.col("jd_id").alias("calendar_id"), F.lit(fx.AS_OF).alias("as_of"))
    requests = ranking.select(F.col("jd_id").alias("calendar_id"), F.col("rank").alias("position"), "candidate_id")
    return sc.schedule(requests, sc.slot_calendar(calendars)).withColumnRenamed("calendar_id", "jd_id")


_BOOKED = "('0x' || substr(md5(calendar_id || '|' || strftime(slot, '%Y-%m-%d %H:%M') || '|7'), 1, 8))::BIGINT % 3 = 0"


@query(
    "available_slots",
    with_inputs(
        "",
        f"""SELECT calendar_id, strftime(slot, '%Y-%m-%d %H:%M') AS slot,
  row_number() OVER (PARTITION BY calendar_id ORDER BY slot) AS slot_number FROM slots WHERE NOT ({_BOOKED})""",
        {
            "calendars": "SELECT s_suppkey::VARCHAR AS calendar_id, DATE '2024-01-31' + (s_suppkey%7)::INTEGER AS as_of "
            "FROM supplier",
            "slots": _SLOTS.format(calendars="calendars"),
        },
    ),
)
def available_slots(spark, d):
    """Free slots of one interviewer calendar per supplier."""
    as_of = F.date_add(F.lit(fx.AS_OF), (F.col("s_suppkey") % 7).cast("int"))
    calendars = fx.table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("calendar_id"), as_of.alias("as_of")
    )
    slots = sc.slot_calendar(calendars)
    booked = slots.where(hash32("calendar_id", sc.slot_text(F.col("slot")), seed=7) % 3 == 0)
    return sc.number_slots(sc.free_slots(slots, booked)).withColumn("slot", sc.slot_text(F.col("slot")))


@query(
    "schedule_interviews",
    with_inputs(
        "schedule",
        "SELECT jd_id, candidate_id, strftime(slot, '%Y-%m-%d %H:%M') AS slot, status, conflict FROM schedule",
    ),
)
def schedule_interviews(spark, d):
    return jd_schedule(spark, d).select(
        "jd_id", "candidate_id", sc.slot_text(F.col("slot")).alias("slot"), "status", "conflict"
    )


@query(
    "schedule_report",
    with_inputs(
        "schedule states",
        """SELECT jd_id, candidate_id, coalesce(name, '—') AS name, strftime(slot, '%Y-%m-%d %H:%M') AS slot, status
 FROM schedule LEFT JOIN states USING (candidate_id) WHERE NOT conflict""",
    ),
)
def schedule_report(spark, d, ranking=None):
    scheduled = jd_schedule(spark, d, ranking).withColumnRenamed("jd_id", "calendar_id")
    return sc.schedule_report(scheduled, current_states(spark, d)).withColumnRenamed("calendar_id", "jd_id")


@query("stage_sync", with_inputs("synced", "SELECT jd_id, candidate_id, before, state FROM synced"))
def stage_sync(spark, d):
    ranking = ranked(spark, d)
    return st.sync_after_scheduling(ranking, jd_schedule(spark, d, ranking), current_states(spark, d))


@query(
    "auto_interviewed",
    with_inputs(
        "synced",
        f"""SELECT jd_id, candidate_id, CASE WHEN state = 'interview_scheduled' AND slot < TIMESTAMP '{PAST}'
  THEN 'interviewed' ELSE state END AS state FROM synced""",
    ),
)
def auto_interviewed(spark, d):
    ranking = ranked(spark, d)
    scheduled = jd_schedule(spark, d, ranking)
    synced = st.sync_after_scheduling(ranking, scheduled, current_states(spark, d))
    as_of = F.lit(PAST).cast("timestamp")
    promoted = st.promote_past_interviews(synced, scheduled, as_of, ["jd_id", "candidate_id"])
    return promoted.select("jd_id", "candidate_id", "state")


_ALLOWED = " ".join(f"WHEN {lit(s)} THEN {items(f)}::VARCHAR[]" for s, f in TRANSITIONS.items())
_ALLOWED = f"CASE state {_ALLOWED} ELSE []::VARCHAR[] END"


@query(
    "allowed_transitions",
    with_inputs("states", f"SELECT candidate_id, state, array_to_string({_ALLOWED}, ', ') AS allowed FROM states"),
)
def allowed_transitions(spark, d):
    allowed = F.array_join(st.allowed_from(F.col("state")), ", ")
    return current_states(spark, d).select("candidate_id", "state", allowed.alias("allowed"))


_REQUESTED = f"(({items(STAGES)})[(k::INTEGER*5//7)%6+1])"


@query(
    "transition_results",
    with_inputs(
        "",
        """SELECT candidate_id, new_state, ok AS success, CASE WHEN ok THEN state END AS previous,
  CASE WHEN ok THEN new_state ELSE state END AS current_state,
  CASE WHEN state IS NULL THEN 'Candidate ' || candidate_id || ' not found in pipeline.' WHEN NOT ok THEN
   'Invalid transition: ' || state || ' → ' || new_state || '. Allowed: [' ||
   array_to_string(list_transform(allowed, lambda x: '''' || x || ''''), ', ') || ']' END AS error
 FROM (SELECT *, state IS NOT NULL AND list_contains(allowed, new_state) AS ok FROM (
  SELECT *, """
        + _ALLOWED
        + f""" AS allowed FROM (SELECT k::VARCHAR AS candidate_id, {_STATE} AS state, {_REQUESTED} AS new_state
   FROM (SELECT c_custkey AS k FROM customer))))""",
    ),
)
def transition_results(spark, d):
    requested = fx.pick(STAGES, F.floor(F.col("c_custkey") * 5 / 7) % 6)
    requests = fx.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("candidate_id"), requested.alias("new_state")
    )
    return st.request_results(requests, current_states(spark, d))


@query(
    "register_candidates",
    with_inputs(
        "states",
        """SELECT candidate_id, ord, coalesce(state, 'applied') AS state, state IS NULL AS added FROM (
  SELECT o_custkey::VARCHAR AS candidate_id, min(o_orderkey) AS ord FROM orders GROUP BY 1)
  LEFT JOIN (SELECT candidate_id, state FROM states) USING (candidate_id)""",
    ),
)
def register_candidates(spark, d):
    arrivals = fx.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("candidate_id"), F.col("o_orderkey").alias("ord")
    )
    return st.register(arrivals, current_states(spark, d))


_PAIRS = ", ".join(lit(f"{a}>{b}") for a, following in TRANSITIONS.items() for b in following)
_FOLD = f"""SELECT candidate_id, list_reduce(list_prepend('applied', list({{event}} ORDER BY ts, event_id)),
  lambda s, e: CASE WHEN e[1] = '!' THEN e[2:] WHEN s || '>' || e IN ({_PAIRS}) THEN e ELSE s END) AS state
 FROM pev GROUP BY candidate_id"""


@query("stage_fold", with_inputs("pev", _FOLD.format(event="new_state")))
def stage_fold(spark, d):
    return st.fold_states(fx.stage_events(spark, d).withColumn("forced", F.lit(False)))


_UPSERT = _FOLD.format(event="CASE WHEN forced THEN '!' ELSE '' END || new_state")


@query("stage_upsert", with_inputs("pev", _UPSERT))
def stage_upsert(spark, d):
    return st.fold_states(fx.stage_events(spark, d))


@query(
    "transition_log",
    "WITH RECURSIVE pev AS ("
    + CTES["pev"]
    + f"""), seq AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY ts, event_id) AS n FROM pev),
 walk AS (SELECT candidate_id, n, event_id, 'applied' AS previous, new_state AS requested, CASE WHEN forced OR
   'applied>' || new_state IN ({_PAIRS}) THEN new_state ELSE 'applied' END AS state, forced FROM seq WHERE n = 1
  UNION ALL SELECT s.candidate_id, s.n, s.event_id, w.state, s.new_state, CASE WHEN s.forced OR
   w.state || '>' || s.new_state IN ({_PAIRS}) THEN s.new_state ELSE w.state END, s.forced
  FROM walk w JOIN seq s ON s.candidate_id = w.candidate_id AND s.n = w.n + 1)
 SELECT candidate_id, event_id, previous, requested, state, forced OR previous <> state AS success FROM walk""",
)
def transition_log(spark, d):
    return st.transition_log(fx.stage_events(spark, d)).drop("ts")


_SUMMARY = ", ".join(f"({i}, {lit(s)})" for i, s in enumerate(STAGES, start=1))


@query(
    "stage_summary",
    with_inputs(
        "states",
        f"""SELECT position, stage, CASE WHEN stage = 'applied' THEN (SELECT count(*) FROM states)
  ELSE (SELECT count(*) FROM states WHERE state = stage) END AS candidates
 FROM (VALUES {_SUMMARY}) t(position, stage)""",
    ),
)
def stage_summary(spark, d):
    return st.stage_summary(current_states(spark, d))


@query(
    "status_board",
    with_inputs(
        "states",
        """SELECT state, row_number() OVER (PARTITION BY state ORDER BY ord) AS position, candidate_id,
  coalesce(name, candidate_id) AS name FROM states WHERE state IS NOT NULL""",
    ),
)
def status_board(spark, d):
    return st.status_board(current_states(spark, d))


_LABELS = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in STATUS_LABELS.items())


def exported(spark, d, ranking=None):
    ranking = ranked(spark, d) if ranking is None else ranking
    return rp.export_candidates(ranking, current_states(spark, d), ["candidate_id"])


@query(
    "export_candidates",
    with_inputs(
        "ranked states",
        f"""SELECT jd_id, rank, candidate_id, k.name, CASE WHEN len(skills) = 0 THEN '—' ELSE
  array_to_string(skills, ', ') END AS skills, {r('match_score*100', 1)} AS match_score_pct,
  {r('jd_coverage*100', 1)} AS jd_coverage_pct, {r('experience_score*100', 1)} AS experience_score_pct,
  {r('keyword_sim*100', 1)} AS keyword_sim_pct, coalesce(state, 'not_in_pipeline') AS status,
  CASE coalesce(state, 'not_in_pipeline') {_LABELS} END AS status_label
 FROM ranked k LEFT JOIN states USING (candidate_id)""",
    ),
)
def export_candidates(spark, d, ranking=None):
    return exported(spark, d, ranking).orderBy("jd_id", "rank")


@query(
    "status_breakdown",
    with_inputs(
        "ranked states",
        """SELECT coalesce(state, 'not_in_pipeline') AS status, count(*) AS candidates
 FROM ranked LEFT JOIN states USING (candidate_id) GROUP BY 1""",
    ),
)
def status_breakdown(spark, d):
    return st.status_breakdown(exported(spark, d))


@query(
    "status_labels",
    with_inputs(
        "states",
        f"""SELECT candidate_id, CASE state {_LABELS} ELSE state END AS label,
  CASE p WHEN 'high' THEN '🚨 HIGH' WHEN 'medium' THEN '⚠️ MEDIUM' WHEN 'low' THEN '📋 LOW' WHEN 'none' THEN '✅ NONE'
   ELSE p END AS priority FROM (SELECT *, (['high','medium','low','none','other'])[ord%5+1] AS p FROM states)""",
    ),
)
def status_labels(spark, d):
    priority = fx.pick(["high", "medium", "low", "none", "other"], F.col("ord") % 5)
    return current_states(spark, d).select(
        "candidate_id",
        label_of(F.col("state"), STATUS_LABELS).alias("label"),
        label_of(priority, PRIORITY_LABELS).alias("priority"),
    )
