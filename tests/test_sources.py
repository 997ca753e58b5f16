import csv

import pytest
from pyspark.sql import functions as F

from screenloom.functions.scores import label_of, pretty_json, safe_json
from screenloom.operators.reports import read_sheet, write_report
from screenloom.sources import candidates as src
from screenloom.sources.question_bank import read_bank
from screenloom.sources.taxonomy import read_taxonomy

HEADER = [
    "Name", "Age", "Gender", "Education_Level", "Field_of_Study", "Experience_Years", "Skills", "Certifications",
    "Current_Job_Title", "Target_Job_Description",
]


def test_candidate_file(spark, tmp_path):
    rows = [
        ["Ann", "30", "Female", "PhD", "Physics", "2.5", "Python, SQL", "None", "Data Analyst", 'A "data" role'],
        ["", "", "", "", "", "", "", "", "", ""],
    ]
    with open(tmp_path / "people.csv", "w", newline="") as f:
        csv.writer(f).writerows([HEADER, *rows])
    people = src.as_candidates(src.read_profiles(spark, str(tmp_path / "people.csv"))).collect()
    ann, empty = sorted(people, key=lambda r: r.candidate_id)
    assert ann.resume_text == (
        "Name: Ann. Education: PhD in Physics. Experience: 2.5 years. Current role: Data Analyst. "
        'Skills: Python, SQL. Certifications: None. Objective: A "data" role'
    )
    assert (empty.name, empty.experience_years) == ("Candidate_2", 0.0)
    assert (ann.ord, empty.ord) == (0, 1)


def test_sample_is_exact_and_stable(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("candidate_id"))
    first = {r.candidate_id for r in src.seeded_sample(ids, "candidate_id", 50).collect()}
    again = {r.candidate_id for r in src.seeded_sample(ids.repartition(9), "candidate_id", 50).collect()}
    assert len(first) == 50 and first == again
    assert src.seeded_sample(ids.limit(3), "candidate_id", 50).count() == 3
    assert src.seeded_sample(ids.limit(0), "candidate_id", 50).count() == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Name: Priya Sharma\n3 years of experience \xff Python")
    (tmp_path / "b.txt").write_text(" \n\t ")
    got = src.as_uploads(src.read_texts(spark, str(tmp_path))).collect()
    assert [(r.candidate_id, r.name, r.experience_years) for r in got] == [("PDF_a", "Priya Sharma", 3.0)]
    assert got[0].resume_text.endswith("experience  Python")


def test_demo_rows(spark):
    rows = src.demo_rows(spark.range(25).withColumnRenamed("id", "position")).collect()
    assert rows[0].name == rows[10].name == "Priya Sharma"
    assert all(1 <= r.experience_years <= 10 and r.resume_text.endswith("years experience") for r in rows)


def test_json_helpers_and_labels(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("{oops",), (None,)], "s string")
    assert [r.k for r in df.select(safe_json(F.col("s"), "k int")["k"].alias("k")).collect()] == [1, None, None]
    row = spark.range(1).select(pretty_json(F.struct(F.lit(1).alias("a"))).alias("j"), label_of(F.lit("x"), {"y": "Y"}).alias("l"))
    assert row.first().l == "x" and '"a" : 1' in row.first().j


def test_report(spark, tmp_path):
    sheets = {"people": spark.range(3), "none": spark.range(0)}
    written = write_report(sheets, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(written["people"]).count() == 3


def test_report_appears_whole_or_not_at_all(spark, tmp_path):
    """A sheet that fails leaves no other sheet behind, and the report that stood there stays; texts may hold line breaks."""
    path = str(tmp_path / "report")
    good = spark.createDataFrame([(1, 'a "quoted"\nline, and more', None), (2, "", 0.5)], "id long, text string, share double")
    bad = spark.range(3).select(F.expr("raise_error('no sheet')").cast("string").alias("x"))
    with pytest.raises(Exception, match="no sheet"):
        write_report({"good": good, "bad": bad}, path)
    assert list(tmp_path.iterdir()) == []
    written = write_report({"good": good, "again": good.limit(1)}, path)
    back = sorted(map(tuple, read_sheet(spark, written["good"], good.schema).collect()))
    assert back[0] == (1, 'a "quoted"\nline, and more', None) and back[1][2] == 0.5
    with pytest.raises(Exception, match="no sheet"):
        write_report({"good": good.limit(0), "bad": bad}, path)
    assert [p.name for p in tmp_path.iterdir()] == ["report"]
    assert read_sheet(spark, written["good"], good.schema).count() == 2
    write_report({"good": good.limit(1)}, path)  # a new report takes the place of the old one
    assert sorted(p.name for p in (tmp_path / "report").iterdir()) == ["good"]
    assert write_report({}, path) == {}


def test_broken_taxonomy_is_an_error(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"Data": {"SQL": ["postgres"]}}')
    assert [r.canonical for r in read_taxonomy(spark, str(tmp_path)).collect()] == ["SQL"]
    (tmp_path / "broken.json").write_text('{"Data": {"SQL": ')
    with pytest.raises(Exception, match="broken.json"):
        read_taxonomy(spark, str(tmp_path)).collect()


def test_bank_of_several_files_keeps_the_last_registration(spark, tmp_path):
    topic = '{"concepts": {"easy": ["%s"]}, "coding_patterns": [], "scenarios": [], "design_topics": []}'
    (tmp_path / "a.json").write_text('{"SQL": %s, "Python": %s}' % (topic % "old", topic % "p"))
    (tmp_path / "b.json").write_text('{"SQL": %s}' % (topic % "new"))
    rows = [(r.skill, r.tier) for r in read_bank(spark, str(tmp_path)).collect()]
    assert len(rows) == len(set(rows)) and {s for s, _ in rows} == {"SQL", "Python"}
    concepts = {c for r in read_bank(spark, str(tmp_path)).where("skill = 'SQL'").collect() for c in r.concepts}
    assert concepts <= {"new"}
