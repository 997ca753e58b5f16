import json

import pytest
from pyspark.sql import functions as F

from screenloom.dims import question_bank as qb
from screenloom.operators import questions as qs
from screenloom.sources.question_bank import read_bank, starter_bank

PROFILES = [
    ("junior", ["Python", "Machine Learning", "SQL"], 1.0),
    ("mid", ["React", "Node.js", "Docker", "AWS"], 3.5),
    ("senior", ["Kubernetes", "DevOps", "Python", "Natural Language Processing"], 7.0),
    ("fresher", ["Data Structures and Algorithms", "C++"], 0.5),
    ("many", [f"S{i}" for i in range(12)], 3.0),
    ("none", [], 3.0),
]
SCHEMA = "candidate_id string, skills array<string>, experience_years double"


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame(PROFILES, SCHEMA).cache()


def test_mix_rounds_half_to_even():
    totals = {n: [sum(qs.question_mix(n)[t]) for t in qb.TIERS] for n in range(1, 6)}
    assert totals == {1: [0, 0, 0], 2: [2, 0, 2], 3: [2, 3, 2], 4: [5, 3, 5], 5: [5, 5, 5]}


def test_questions_per_profile(spark, profiles):
    asked = qs.generate_questions(profiles, starter_bank(spark), 3).collect()
    per = {p: [q for q in asked if q.candidate_id == p] for p, _, _ in PROFILES}
    assert {p: len(q) for p, q in per.items()} == {
        "junior": 6, "mid": 12, "senior": 8, "fresher": 4, "many": 24, "none": 0,
    }
    assert {q.skill for q in per["many"]} == {f"S{i}" for i in range(8)}
    assert all("{" not in q.question + q.hint + q.follow_up for q in asked)
    generic = [q for q in per["fresher"] if q.type == "conceptual"]
    assert generic and all(q.skill in q.question or "fundamentals" in q.question or "tooling" in q.question for q in generic)


def test_same_questions_on_every_run(spark, profiles):
    bank = starter_bank(spark)
    one = qs.generate_questions(profiles, bank, 5)
    two = qs.generate_questions(profiles.repartition(5), bank, 5)
    assert one.exceptAll(two).count() == 0 and one.count() == two.count()


def test_repeated_question_is_asked_once(spark, tmp_path):
    topic = {"concepts": {"junior": ["x"]}, "coding_patterns": [], "scenarios": ["same?"], "design_topics": []}
    (tmp_path / "bank.json").write_text(json.dumps({"A": topic, "B": topic}))
    bank = read_bank(spark, str(tmp_path / "bank.json"))
    person = spark.createDataFrame([("p", ["A", "B"], 9.0)], SCHEMA)
    scenarios = qs.generate_questions(person, bank, 7).where(F.col("type") == "scenario").collect()
    assert [(q.skill, q.question) for q in scenarios] == [("A", "same?")]
