"""Periodic runs against brute force, and suffix trees against plain comparison."""

import random
import re

import numpy as np
import pytest

from screenloom.llm import periodic


def brute(symbols, length, exponent):
    n, found = len(symbols), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and symbols[j] == symbols[j + q]:
                j += 1
            if j > i and j - i + q >= max(length, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, size, q) for (i, size), q in found.items())


def made(rng):
    symbols, kinds = [], rng.choice([1, 2, 3, 4])
    while len(symbols) < rng.randrange(70):
        if rng.random() < 0.5:
            symbols += [rng.randrange(kinds) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 8)
        else:
            symbols += [rng.randrange(kinds) + (rng.randrange(20) if rng.random() < 0.3 else 0) for _ in range(5)]
    return symbols


@pytest.mark.parametrize(("length", "exponent"), [(6, 4), (2, 2), (3, 3)])
def test_runs(length, exponent):
    rng = random.Random(length)
    for _ in range(600):
        symbols = made(rng)
        found = periodic.runs(np.array(symbols, np.int64) + 1, length, exponent)
        assert [tuple(r) for r in found.tolist()] == brute(symbols, length, exponent), symbols


def test_common_beginnings_in_constant_time():
    rng = random.Random(3)
    text = [rng.randrange(1, 4) for _ in range(200)] + [0]
    tree = periodic.SuffixTree(np.array(text), both_orders=True)
    assert [int(i) for i in np.argsort(tree.rank)] == sorted(range(201), key=lambda i: text[i:])
    assert [int(i) for i in np.argsort(tree.reversed_rank)] == sorted(range(201), key=lambda i: [-x if x else -9 for x in text[i:]])
    a, b = np.array([(i, j) for i in range(201) for j in range(201) if i != j]).T
    for i, j, size in zip(a.tolist(), b.tolist(), tree.common(a, b).tolist(), strict=True):
        assert text[i : i + size] == text[j : j + size] and text[i + size] != text[j + size]


def test_least_copies():
    for length, exponent in [(6, 4), (2, 2), (3, 3), (10, 2), (6, 7)]:
        gram, copies, room = periodic.least_copies(length, exponent)
        places = [max(length, exponent * q) - gram + 1 for q in range(1, 500)]
        assert copies == min(p // q for q, p in enumerate(places, 1)) and room == min(places)


def collapsed(words, found):
    gone = {i for start, size, q in found for i in range(start + q, start + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_documents(spark):
    """Nulls, blanks, odd blanks, a long periodic text, repeated rows and clashing columns."""
    rng = random.Random(8)
    texts = [rng.choice([" ", "\n", "\t \r\n"]).join(f"é{s}" for s in made(rng)) for _ in range(150)]
    texts += [None, "", " \n ", "a", "a a a a a", "a a a a a a", " ".join(["x y z"] * 30_000), " ".join(map(str, range(400_000)))]
    rows = [(i * 7 % 1009, t, 1, "r", 2) for i, t in enumerate(texts)] + [(None, texts[3], 1, "r", 2), (None, None, 1, "r", 2)]
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string, n_words int").repartition(4)
    found = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(df).collect()]
    expected = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        own = [(0, 90_000, 3)] if words[:4] == ["x", "y", "z", "x"] else [] if len(words) == 400_000 else brute(words, 6, 4)
        expected.append((doc_id, len(words), own, collapsed(words, own)))
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert any(len(own) > 1 for _, _, own, _ in expected)


def test_empty_table(spark):
    assert periodic.find_runs(spark.createDataFrame([], "doc_id string, text string")).collect() == []
