"""Words of whole texts as numpy arrays, with 64-bit word and n-gram hashes.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
UTF-8 never uses those bytes inside a character, so splitting bytes splits the text. Everything here works on one
Arrow batch inside a task; nothing keeps state between batches.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE = 1 << 20  # bytes of text worked on at once; arrays of several numbers a byte are made for them
BLANKS = b" \t\n\x0b\x0c\r"
_SEGMENT = 1 << 20  # bytes hashed at once; longer words are hashed one by one
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2^64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Words:
    """``first[d]:first[d + 1]`` are the words of text ``d``; word ``i`` is ``data[starts[i]:ends[i]]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Hand freed memory back to the system: a worker that waits for its next task keeps none of the last one's."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text each; a longer text stands alone. Memory freed
    meanwhile goes back after each batch."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype("float64"))
    begin, total = 0, 0.0
    for row, size in enumerate(sizes):
        if row > begin and total + size > limit:
            yield batch.slice(begin, row - begin)
            begin, total = row, 0.0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)
    release()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins; a null text is empty."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(plain):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = plain.buffers()
    at = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def scan(texts: pa.Array, separators: bytes = BLANKS) -> Words:
    """Words are runs without any of ``separators`` (ASCII)."""
    data, offsets = text_bytes(texts)
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    inside = table[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    closes[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below ``size``."""
    if base not in _powers or len(_powers[base][0]) < size:
        steps = np.full(max(size, 1 << 16), base, dtype=np.uint64)
        back = np.full(len(steps), pow(base, -1, 1 << 64), dtype=np.uint64)
        steps[0] = back[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _powers[base]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of ``values[start:end]``, from prefix sums."""
    powers, inverse = _power_tables(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(values)], dtype=np.uint64, out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash per word that depends on its bytes alone."""
    result = np.empty(len(words.starts), dtype=np.uint64)
    i = 0
    while i < len(result):
        base = words.starts[i]
        j = int(np.searchsorted(words.ends, base + _SEGMENT, side="right"))
        if j <= i:
            result[i] = xxhash.xxh64_intdigest(words.data[base : words.ends[i]].tobytes(), 7)
            i += 1
            continue
        s, e = words.starts[i:j] - base, words.ends[i:j] - base
        values = words.data[base : base + e[-1]].astype(np.uint64) + np.uint64(1)
        result[i:j] = mix(_spans(values, s, e, _BASE) + (e - s).astype(np.uint64))
        i = j
    return result


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of words ``hashes[start:end]``."""
    length = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(_spans(mix(hashes + np.uint64(seed)), starts, ends, _BASE ^ 0x5DEECE66C) + length)


def gram_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Indexes of the words that begin a run of ``size`` words of one text."""
    counts = np.diff(first)
    valid = np.ones(int(first[-1]), dtype=bool)
    for back in range(1, size):
        last = first[1:][counts >= back] - back
        valid[last] = False
    return np.flatnonzero(valid)


def owner(first: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
