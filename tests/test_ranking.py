import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from screenloom.functions import scores as s
from screenloom.functions.text import required_experience
from screenloom.operators import ranking as rk
from screenloom.operators import skills as sk
from screenloom.operators.positions import running_totals, with_position

PEOPLE = [
    ("1", 0, "Alice", "Python Machine Learning Docker AWS 5 years experience", 5.0),
    ("2", 1, "Bob", "JavaScript React Node.js 2 years experience", 2.0),
]
SCHEMA = "candidate_id string, ord long, name string, resume_text string, experience_years double"


@pytest.fixture(scope="module")
def matcher(spark):
    return sk.Matcher.build(sk.starter_entries(spark))


def test_two_candidates(spark, matcher):
    people = spark.createDataFrame(PEOPLE, SCHEMA)
    rows = rk.rank_for_job(people, "Python ML engineer 3+ years experience cloud DevOps.", matcher).collect()
    best, second = sorted(rows, key=lambda r: r["rank"])
    # Job: DevOps, Machine Learning, Python. Alice has two of three and two more; no pattern names the years.
    assert (best.name, best.jd_coverage, best.breadth_bonus) == ("Alice", 0.6667, 0.08)
    assert best.match_score == pytest.approx(0.55 * 0.6667 + 0.1 * 2 / 3 + 0.1 * 0.08 + 0.25 * 0.7, abs=1e-4)
    assert (second.name, second.jd_coverage) == ("Bob", 0.0)


def test_job_without_skills_is_an_error(spark, matcher):
    with pytest.raises(ValueError, match="No valid skills"):
        rk.rank_for_job(spark.createDataFrame(PEOPLE, SCHEMA), "Friendly people wanted.", matcher)


def test_experience(spark):
    jobs = [
        ("3 years of experience", 3.0), ("Minimum 2.5 years", 2.5), ("at least 4 years", 4.0),
        ("6+ years professional", 6.0), ("no numbers", 0.0),
    ]
    df = spark.createDataFrame(jobs, "t string, want double")
    assert all(r.want == r.got for r in df.withColumn("got", required_experience(F.col("t"))).collect())
    cases = [(5.0, 0.0, 0.7), (5.0, 3.0, 0.82), (1.0, 4.0, 0.125), (40.0, 1.0, 1.0)]
    df = spark.createDataFrame(cases, "y double, r double, want double")
    for r in df.withColumn("got", s.experience_score(F.col("y"), F.col("r"))).collect():
        assert r.got == pytest.approx(r.want)


def test_score_ceiling_and_cut_percent(spark):
    row = spark.range(1).select(
        s.match_score(F.lit(1.0), F.lit(1.0), s.breadth_bonus(F.lit(50)), F.lit(1.0)).alias("top"),
        s.percent(F.lit(0.29)).alias("pct"),
    ).first()
    assert (row.top, row.pct) == (0.92, 28)


def test_rank_with_a_hot_job_and_many_ties(spark, monkeypatch):
    monkeypatch.setattr(rk, "TIE_BLOCK", 16)
    rnd = random.Random(5)
    rows = [
        ("hot" if i % 3 else f"j{i % 7}", str(i), i, 0.5 if i % 2 else rnd.randint(0, 30) / 100) for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "jd_id string, candidate_id string, ord long, match_score double")
    got = {(r.jd_id, r.candidate_id): r["rank"] for r in rk.rank(df).collect()}
    plain = F.row_number().over(Window.partitionBy("jd_id").orderBy(F.desc("match_score"), "ord"))
    assert got == {(r.jd_id, r.candidate_id): r.p for r in df.withColumn("p", plain).collect()}


def test_positions_and_totals(spark):
    rows = [(i % 2, i // 100, i % 10, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, a int, b int, id long")
    got = with_position(df, ["k"], [("a", True), ("b", False)], [F.col("id")], "p").collect()
    for k in (0, 1):
        ordered = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], -r[2], r[3]))
        assert {r.id: r.p for r in got if r.k == k} == {r[3]: i for i, r in enumerate(ordered, 1)}
    totals = running_totals(df, ["k"], [("a", True)], {"s": F.col("id")}).collect()
    for r in totals:
        assert r.s_before == sum(x[3] for x in rows if x[0] == r.k and x[1] < r.a)


def test_display_skills(spark):
    df = spark.createDataFrame([(list("ABCDEFGHIJKL"), ["L", "C"])], "skills array<string>, jd_skills array<string>")
    shown, hidden = rk.display_skills(10)
    row = df.select(shown.alias("s"), hidden.alias("h")).first()
    assert (row.s, row.h) == (list("CLABDEFGHI"), 2)


def test_stale_ranking(spark):
    now = spark.createDataFrame([("a", "x "), ("b", "y"), ("c", "z")], "jd_id string, jd_text string")
    last = spark.createDataFrame([("a", " x"), ("b", "old"), ("c", "")], "jd_id string, jd_text string")
    assert [r.jd_id for r in rk.stale_rankings(now, last).collect()] == ["b"]
