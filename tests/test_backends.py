"""Back-ends: fallbacks, errors, and that nothing is asked twice."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from screenloom.operators import backends as be
from screenloom.operators.questions import from_backends


def noting(name, folder, answers):
    """A back-end that notes every request it gets in a file of its own."""

    def ask(requests):
        import os
        import uuid

        for r in requests.to_pylist():
            with open(os.path.join(folder, f"{name}-{uuid.uuid4().hex}"), "w") as out:
                out.write(r)
        return pa.array([answers(r) for r in requests.to_pylist()], pa.string())

    return be.Backend(name, ask)


def fails(requests):
    raise ConnectionError("no back-end there")


def noted(folder, name):
    return sorted(p.read_text() for p in folder.iterdir() if p.name.startswith(f"{name}-"))


def table(spark, values):
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "id long, request string, key string").repartition(3)


def test_chain_and_finished_answers(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    store = str(tmp_path / "answers")
    first = noting("first", str(notes), lambda r: f"1:{r}" if len(r) % 2 else None)
    second = noting("second", str(notes), lambda r: None if r == "none" else f"2:{r}")
    chain = [be.Backend("down", lambda r: (_ for _ in ()).throw(ConnectionError())), first, second]
    values = ["a", "bb", "a", None, "none", "ccc", "bb", ""]
    expected = {"a": ("1:a", "first"), "bb": ("2:bb", "second"), "none": (None, None), "ccc": ("1:ccc", "first"), "": ("2:", "second"), None: (None, None)}
    for run in range(2):
        found = be.answered(table(spark, values), chain, store=store, part=2)
        assert found.columns == ["id", "request", "key", "answer", "backend"]
        rows = found.collect()
        assert sorted(r["id"] for r in rows) == list(range(len(values)))
        assert all((r["answer"], r["backend"]) == expected[r["request"]] for r in rows)
        # each different request once; only the one that nobody answered is asked again
        assert noted(notes, "first") == sorted(["", "a", "bb", "ccc", "none"] + ["none"] * run)
        assert noted(notes, "second") == sorted(["", "bb", "none"] + ["none"] * run)
    more = be.answered(table(spark, ["a", "dd"]), [second], store=store).collect()
    assert {r["request"]: r["answer"] for r in more} == {"a": "1:a", "dd": "2:dd"}
    other = be.answered(table(spark, ["a"]), [second], store=store, kind="another model").collect()
    assert other[0]["answer"] == "2:a"


def test_errors_leave_their_batch_to_the_next():
    short = be.Backend("short", lambda r: pa.array(["x"]))
    half = be.Backend("half", lambda r: pa.array([v.as_py() if k % 2 else None for k, v in enumerate(r)]))
    last = be.Backend("last", lambda r: pa.array([f"{v}!" for v in r.to_pylist()]))
    requests = pa.array(["a", "b", None, "c"])
    answers, names = be.ask_chain([be.Backend("down", fails), short, half, last], requests)
    assert answers.to_pylist() == ["a!", "b", None, "c!"] and names.to_pylist() == ["last", "half", None, "last"]
    assert be.ask_chain([], requests)[0].to_pylist() == [None] * 4


@pytest.mark.parametrize("values", [[], [None, None]])
def test_nothing_to_ask(spark, values):
    found = be.answered(table(spark, values), [be.Backend("down", fails)])
    assert found.count() == len(values) and found.where("answer is not null").count() == 0


def test_questions_keep_the_bank_where_nobody_answers(spark):
    rows = [(c, s, t, "easy", f"What is {s}?") for c in ("1", "2") for s in ("SQL", "R") for t in ("coding", "conceptual")]
    questions = spark.createDataFrame(rows, "candidate_id string, skill string, type string, difficulty string, question string")
    chain = [be.Backend("polite", lambda r: pa.array([f"Please: {v.splitlines()[1]}" if "| coding |" in v else None for v in r.to_pylist()]))]
    found = from_backends(questions, chain).groupBy("type", "origin", "question").agg(F.count("*").alias("n")).collect()
    assert {(r["type"], r["origin"], r["question"]): r["n"] for r in found} == {
        ("coding", "polite", "Please: What is SQL?"): 2, ("coding", "polite", "Please: What is R?"): 2,
        ("conceptual", "bank", "What is SQL?"): 2, ("conceptual", "bank", "What is R?"): 2,
    }
