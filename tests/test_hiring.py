import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from screenloom.dims.stages import STAGES, TRANSITIONS
from screenloom.operators import scheduling as sc
from screenloom.operators import stages as st
from screenloom.streaming import sources as so
from screenloom.streaming import stages as ss

SCHEMA = "candidate_id string, event_id long, ts timestamp, new_state string, forced boolean"


def history(n, seed=1, people=4):
    """Events of a few candidates; the first one owns most of them."""
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        who = "hot" if rnd.random() < 0.7 else f"c{rnd.randrange(people)}"
        ts = start + dt.timedelta(seconds=rnd.randrange(200_000))
        rows.append((who, i, ts, rnd.choice(STAGES), rnd.random() < 0.05))
    return rows


def walk(rows, start="applied"):
    """Stage changes one after the other."""
    state, log = {}, []
    for who, event_id, _, new, forced in sorted(rows, key=lambda r: (r[2], r[1])):
        before = state.get(who, start)
        ok = forced or new in TRANSITIONS.get(before, [])
        state[who] = new if ok else before
        log.append((who, event_id, before, new, state[who], ok))
    return state, sorted(log)


@pytest.mark.parametrize("chunk", [3, 1024])
def test_fold_and_log_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(st, "CHUNK", chunk)
    rows = history(400)
    events = spark.createDataFrame(rows, SCHEMA)
    state, log = walk(rows)
    assert {r.candidate_id: r.state for r in st.fold_states(events).collect()} == state
    got = st.transition_log(events).drop("ts").collect()
    assert sorted(tuple(r) for r in got) == log


def test_absent_candidates_only_enter_by_force(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", 1, t, "shortlisted", False), ("b", 1, t, "shortlisted", True)]
    got = st.fold_states(spark.createDataFrame(rows, SCHEMA), start=st.ABSENT).collect()
    assert {r.candidate_id: r.state for r in got} == {"a": "", "b": "shortlisted"}


def test_request_results(spark):
    requests = spark.createDataFrame([("a", "shortlisted"), ("b", "selected"), ("x", "rejected")], "candidate_id string, new_state string")
    current = spark.createDataFrame([("a", "applied"), ("b", "selected")], "candidate_id string, state string")
    got = {r.candidate_id: r for r in st.request_results(requests, current).collect()}
    assert (got["a"].success, got["a"].previous, got["a"].current_state) == (True, "applied", "shortlisted")
    assert got["b"].error == "Invalid transition: selected → selected. Allowed: []"
    assert got["x"].error == "Candidate x not found in pipeline."


def test_calendar_and_schedule(spark):
    calendars = spark.createDataFrame([("j", dt.date(2024, 1, 31))], "calendar_id string, as_of date")
    slots = sc.slot_calendar(calendars)
    text = [r.t for r in slots.select(sc.slot_text(F.col("slot")).alias("t")).orderBy("t").collect()]
    assert len(text) == 24 and text[0] == "2024-02-01 09:00" and not any(t.startswith("2024-02-04") for t in text)
    assert sc.slot_calendar(calendars, skip_sunday=False).count() == 28
    requests = spark.createDataFrame([("j", i, f"c{i}") for i in range(1, 31)], "calendar_id string, position long, candidate_id string")
    booked = slots.orderBy("slot").limit(5)
    rows = sc.schedule(requests, sc.free_slots(slots, booked)).collect()
    taken = [r.slot for r in rows if not r.conflict]
    assert len(taken) == len(set(taken)) == 19
    assert {r.candidate_id for r in rows if r.conflict} == {f"c{i}" for i in range(20, 31)}
    assert {r.status for r in rows if r.conflict} == {"no_slots_available"}


def test_promotion_is_idempotent_and_skips_bad_slots(spark):
    states = spark.createDataFrame([(c, "interview_scheduled") for c in "abc"], "candidate_id string, state string")
    slots = spark.createDataFrame([("a", "2024-01-01 09:00"), ("b", "soon"), ("c", "2030-01-01 09:00")], "candidate_id string, slot string")
    now = F.lit("2024-06-01").cast("timestamp")
    once = st.promote_past_interviews(states, slots, now, ["candidate_id"])
    twice = st.promote_past_interviews(once, slots, now, ["candidate_id"])
    want = {"a": "interviewed", "b": "interview_scheduled", "c": "interview_scheduled"}
    assert {r.candidate_id: r.state for r in once.collect()} == want
    assert {r.candidate_id: r.state for r in twice.collect()} == want


def test_summary_and_board(spark):
    rows = [("a", "applied", 0, "Ann"), ("b", "rejected", 1, None), ("c", "rejected", 2, "Cid"), ("d", None, 3, "Dee")]
    states = spark.createDataFrame(rows, "candidate_id string, state string, ord long, name string")
    summary = [(r.stage, r.candidates) for r in st.stage_summary(states).orderBy("position").collect()]
    assert summary == [("applied", 4)] + [(s, 2 if s == "rejected" else 0) for s in STAGES[1:]]
    board = sorted((r.state, r.position, r.name) for r in st.status_board(states).collect())
    assert board == [("applied", 1, "Ann"), ("rejected", 1, "b"), ("rejected", 2, "Cid")]



def test_stream_equals_batch_over_ordered_files(spark, tmp_path):
    rows = sorted(history(300, seed=2), key=lambda r: (r[2], r[1]))
    schema = spark.createDataFrame(rows, SCHEMA).schema
    folder, log_path, checkpoint = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    for part in (rows[:120], rows[120:200], rows[200:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        # The next run continues from the checkpoint.
        stream = ss.transition_stream(so.file_stream(spark, folder, "*.parquet", schema))
        so.append_to_table(stream, "log", checkpoint=checkpoint, path=log_path)
    log = spark.read.schema(ss.LOG_SCHEMA).parquet(log_path)
    state, expected = walk(rows)
    got = sorted(tuple(r) for r in log.select("candidate_id", "event_id", "previous", "requested", "state", "success").collect())
    assert got == expected
    assert log.where("first").count() == len(state)
    path = so.batches_to_table(ss.funnel_changes(so.file_stream(spark, log_path, "*.parquet", ss.LOG_SCHEMA)), "funnel", "update")
    counts = {r.stage: r.candidates for r in so.latest_rows(spark, path, ["stage"], ["candidates"]).collect() if r.candidates}
    assert counts == {s: list(state.values()).count(s) for s in set(state.values())}


def test_stream_waits_for_the_watermark(spark, tmp_path):
    rows = history(200, seed=3)
    ordered = sorted(rows, key=lambda r: (r[2], r[1]))
    # Two files that overlap in time, then a far later event that moves the watermark past all of them.
    late = ("end", 10_000, dt.datetime(2024, 3, 1), "rejected", False)
    later = ("end", 10_001, dt.datetime(2024, 4, 1), "rejected", False)
    folder, log_path, checkpoint = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    for part in (ordered[::2], ordered[1::2], [late], [later]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        schema = spark.createDataFrame(part, SCHEMA).schema
        stream = ss.transition_stream(so.file_stream(spark, folder, "*.parquet", schema), delay="10 days")
        so.append_to_table(stream, "log", checkpoint=checkpoint, path=log_path)
    log = spark.read.schema(ss.LOG_SCHEMA).parquet(log_path).where("candidate_id <> 'end'")
    got = sorted(tuple(r) for r in log.select("candidate_id", "event_id", "previous", "requested", "state", "success").collect())
    assert got == walk(rows)[1]
