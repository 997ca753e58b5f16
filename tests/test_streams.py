"""Streams over tables in the layouts Spark writes, and the keyed state of late events."""

from __future__ import annotations

import pandas as pd

from screenloom.plans import all_queries
from screenloom.plans import fixtures as fx
from screenloom.streaming import sources as so
from screenloom.streaming import stages as ss


def test_a_table_of_part_files_is_streamed_whole(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/other.parquet")
    stream = so.file_stream(spark, str(tmp_path), "events.parquet", "id long")
    rows = spark.read.schema("id long").parquet(so.append_to_table(stream, "parts"))
    assert sorted(r["id"] for r in rows.collect()) == list(range(100))


def test_documents_in_part_files_are_screened(spark, tmp_path):
    docs = spark.range(30).selectExpr("id AS doc_id", "'Python and SQL, 3 years of experience' AS text")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    nations = spark.range(25).selectExpr("CAST(id AS int) AS n_nationkey")
    nations.write.parquet(f"{tmp_path}/nation.parquet")
    rows = all_queries()["stream_screen"](spark, str(tmp_path)).collect()
    valid = [k for k in range(30) if k % fx.JOBS not in (23, 24)]
    assert sorted(r["candidate_id"] for r in rows) == sorted(f"PDF_{k}" for k in valid)


class _Stub:
    """Stands in for a table and hands back the function that a step would run on it."""

    def withWatermark(self, *_):
        return self

    def groupBy(self, *_):
        return self

    def applyInPandasWithState(self, work, *_):
        return work


class _State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutTimestamp(self, _):
        pass

    def getCurrentWatermarkMs(self):
        return self.watermark


def test_waiting_events_cost_no_frame_and_lose_no_order():
    advance, state = ss.transition_stream(_Stub(), delay="1 day"), _State()
    stages = ["interview_scheduled", "shortlisted", None]
    frame = pd.DataFrame({"event_id": [3, 1, 2], "ts": pd.to_datetime([7, 5, 7], unit="ms"), "new_state": stages, "forced": [False, None, True]})
    state.watermark = 0
    assert list(advance(("a",), [frame], state)) == []
    assert [w[1] for w in state.get[1]] == [1, 2, 3]
    state.watermark = 6
    (first,) = advance(("a",), [], state)
    state.watermark = 7
    (second,) = advance(("a",), [], state)
    log = pd.concat([first, second])
    assert log["event_id"].tolist() == [1, 2, 3] and log["first"].tolist() == [True, False, False]
