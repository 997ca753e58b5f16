"""Phrases on whole batches against a search text by text."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from screenloom.operators.dictionary import Dictionary

PHRASES = ["c", "c++", "c#", ".net", "asp.net", "node.js", "machine learning", "machine", "learning", "a-b", "a", "++", "é", "naïve b", "r&d", "x_1"]
BITS = ["c", "c++", "c#", ".net", "asp", "node.js", "machine", "learning", "machine  learning", "-", "b", "a", " ", " ", "é", "naïve", "+", "&d", "r", "x_1", "A", "_"]


def brute(phrases, names, text):
    found = {n for p, n in zip(phrases, names, strict=True) if re.search(f"(?<![a-z0-9_]){re.escape(p)}(?![a-z0-9_])", text or "")}
    return sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(12))) for _ in range(1500)] + [None, "", "c", " c", "c "]
    names = [f"n{k % 11}" for k in range(len(PHRASES))]
    found = Dictionary(PHRASES, names).find(pa.array(texts, pa.string())).to_pylist()
    for text, own in zip(texts, found, strict=True):
        assert own == brute(PHRASES, names, text), text
    assert sum(map(len, found)) > 1000


def test_slices_and_borders_between_texts():
    """No phrase reaches from one text into the next, also where an array begins inside its buffer."""
    texts = pa.array(["zzz", "machine", "learning", "machine", None, " learning", "machine learning"], pa.string())
    own = Dictionary(["machine learning", "zzz"], ["ml", "z"])
    assert own.find(texts).to_pylist() == [["z"], [], [], [], [], [], ["ml"]]
    assert own.find(texts.slice(3, 4)).to_pylist() == [[], [], [], ["ml"]]
    assert own.find(texts.slice(0, 0)).to_pylist() == []


def test_many_phrases_and_long_texts():
    rng = np.random.default_rng(1)
    words = [f"word{k}" for k in range(3000)]
    phrases = [" ".join(rng.choice(words, rng.integers(1, 4))) for _ in range(20_000)]
    phrases = sorted(set(phrases))
    texts = [" ".join(rng.choice(words, 30)) for _ in range(50)] + [" ".join(phrases[:5000])]
    found = Dictionary(phrases, phrases).find(pa.array(texts)).to_pylist()
    for text, own in zip(texts[:50], found, strict=False):
        assert own == sorted(p for p in phrases if f" {p} " in f" {text} ")
    assert set(phrases[:5000]) <= set(found[-1])


def test_none():
    assert Dictionary([], []).find(pa.array(["a", None])).to_pylist() == [[], []]
    assert Dictionary(["++"], ["p"]).find(pa.array(["a++", "a ++ b", "++"])).to_pylist() == [[], ["p"], ["p"]]
