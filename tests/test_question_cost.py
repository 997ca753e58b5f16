"""What questions and reports compute and move, beside what they return."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from screenloom.operators import questions as qs
from screenloom.operators import ranking as rk
from screenloom.operators.backends import Backend, answered
from screenloom.plans import reports
from screenloom.sources.question_bank import starter_bank


def _profiles(spark):
    rows = [("a", ["Python", "Docker"], 1.0), ("a", ["Python"], 1.0), (None, ["SQL"], 9.0), (None, ["SQL"], 9.0), ("b", [], None)]
    return spark.createDataFrame(rows, "candidate_id string, skills array<string>, experience_years double").coalesce(1)


def test_questions_are_made_by_many_tasks_and_not_shuffled(spark):
    found = qs.generate_questions(_profiles(spark), starter_bank(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "question" not in shuffles[0]
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_questions_of_repeated_and_null_candidates_are_asked_once(spark):
    rows = qs.generate_questions(_profiles(spark), starter_bank(spark)).collect()
    asked = [(r["candidate_id"], r["question"]) for r in rows]
    assert len(asked) == len(set(asked)) and {c for c, _ in asked} == {"a", None}
    assert all(r["hint"] and r["follow_up"] and "{item}" not in r["hint"] + r["follow_up"] for r in rows)


def test_requests_are_computed_once(spark):
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    requests = spark.range(40).select(F.concat(F.lit("r"), (F.col("id") % 4).cast("string")).alias("request"))
    found = answered(requests.mapInArrow(make, "request string"), [Backend("upper", lambda r: pc.utf8_upper(pa.array(r)))])
    assert {(r["request"], r["answer"]) for r in found.collect()} == {(f"r{k}", f"R{k}") for k in range(4)}
    assert found.count() == 40 and made.value == 40


def test_a_report_ranks_once(spark, sf_dir, monkeypatch):
    calls, real = [], rk.rank_candidates
    monkeypatch.setattr(rk, "rank_candidates", lambda *given: calls.append(1) or real(*given))
    monkeypatch.setattr(reports, "write_report", lambda sheets, path: {name: path for name in sheets})
    monkeypatch.setattr(reports, "read_sheet", lambda spark, path, schema: schema)
    reports._sheet("pipeline")(spark, sf_dir)
    assert len(calls) == 1
