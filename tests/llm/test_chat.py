"""Chat windows: exact reading back, budgets, and equality of both ways of formatting."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from screenloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, index long, block string, kind int"
AWKWARD = ["### ", "</turn>", "\\### assistant: x", "\\\\</turn>\n</turn>\n", "a\n</turn>\n### user: b", "#### x", "\\", "", None, "é日本 " * 50]


def letters():
    """A token per character, so that budgets can be checked by length."""
    return lambda texts: [len(t) for t in texts]


def made_turns(seed, conversations=40, longest=12):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.randrange(1, longest)):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "to ol: x%\n", None, "system"])
            text = rng.choice([*AWKWARD, "w" * rng.randrange(300), "w " * rng.randrange(40)])
            rows.append((conv, rng.choice([turn, turn, None]), role, text, 1, "x", 2))
    rows += [rows[3], rows[3], (7, 90, "assistant", "long " * 20_000, 1, "x", 0)]
    rng.shuffle(rows)
    return rows


def ordered(rows):
    low = lambda x: (x is not None, x or 0)
    by = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (low(r[1]), (r[2] or ""), (r[3] or "").encode())):
        by.setdefault(conv, []).append((role or "", text or ""))
    return by


def windows_by(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["conv_id"], []).append(r)
    return {c: sorted(some, key=lambda r: r["first_turn"]) for c, some in found.items()}


@pytest.mark.parametrize("text", [t for t in AWKWARD if t is not None])
def test_turns_read_back(text):
    turns = [("user", text), ("a: b%\n", text + text), ("", text)]
    whole = "".join(chat.write_turn(*t)[0] for t in turns)
    assert chat.read_turns(whole) == turns
    assert chat.unescape(chat.escape(text)) == text


@pytest.mark.parametrize(("budget", "history", "block"), [(400, 100, 3000), (150, 0, 1000), (10_000, 2000, 100_000)])
def test_windows(spark, budget, history, block):
    rows = made_turns(budget)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = windows_by(chat.format_windows(df, letters(), budget, history, block))
    expected = ordered(rows)
    assert found.keys() == expected.keys()
    for conv, windows in found.items():
        turns, place = expected[conv], 0
        tokens = [len(chat.write_turn(*t)[0]) for t in turns]
        lead = next((k for k, t in enumerate(turns) if t[0] == "system" and 2 * tokens[k] <= budget), None)
        for w in windows:
            all_turns, new = chat.read_turns(w["text"]), chat.read_turns(w["text"][w["fresh_from"] :])
            assert w["first_turn"] == place and w["n_turns"] == len(new) and new == turns[place : place + len(new)]
            assert w["n_tokens"] == len(w["text"]) and (w["n_tokens"] <= budget or len(all_turns) == 1)
            old = all_turns[: len(all_turns) - len(new)]
            if lead is not None and lead < place and tokens[lead] + tokens[place] <= budget:
                assert old and old.pop(0) == turns[lead]
                assert len(old) <= place - lead - 1
            assert old == turns[place - len(old) : place] and sum(tokens[place - len(old) : place]) <= history
            learnt = [chat.unescape(w["text"][s["start"] : s["end"]]) for s in w["loss"]]
            assert learnt == [text for role, text in new if role == "assistant" and text]
            place += len(new)
        assert place == len(turns)


@pytest.mark.parametrize("seed", range(3))
def test_long_conversations_give_the_same_windows(spark, seed):
    rows = made_turns(seed, 4, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plain = chat.format_windows(df, letters(), 700, 300, 2500, long=1 << 30)
    split = chat.format_windows(df, letters(), 700, 300, 2500, long=-1)
    assert windows_by(plain) == windows_by(split)


def test_digests(spark):
    rows = made_turns(9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    windows = chat.format_windows(df, letters(), 500, 100, 3000, long=2000)
    found = {r["conv_id"]: r for r in chat.digests(chat.read_back(windows)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = ordered(rows)
    assert found.keys() == expected.keys()
    for conv, turns in expected.items():
        learnt = "".join(text for role, text in turns if role == "assistant")
        r = found[conv]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r["loss_chars"] == len(learnt) and r["loss_sha256"] == sha(learnt)
    total = windows.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars")).collect()
    assert {r["conv_id"]: r["chars"] for r in total} == {c: r["formatted_chars"] for c, r in found.items()}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.read_back(chat.format_windows(none, letters()))).collect() == []


def test_history_must_fit(spark):
    with pytest.raises(ValueError):
        chat.format_windows(spark.createDataFrame([], SCHEMA), letters(), history=10, block=10)
