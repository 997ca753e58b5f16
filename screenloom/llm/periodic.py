"""Periodic runs of words: suffix trees, constant-time common extensions, Lyndon roots.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping it. After the runs
theorem every run has a root, one period of it, that is the longest Lyndon word at its place under the order of the words or
under the reversed order. So there are two candidates per word. Both Ukkonen trees, of the document and of its reversal, are
walked into Euler tours; the least depth between two leaves of a tour is the length of their common extension, found in
constant time in a sparse table. Each candidate is extended to the right in the first tree and to the left in the second.

Before trees are grown, words that no wanted run can contain are taken out, exactly: in a run of at least ``exponent`` periods
every three words in a row stand a known number of times (``least_copies``). What lies between is contracted to one separator
that stands nowhere else, so a tree grows with the repetitive part of its document only.

Equality of words and of three words in a row is equality of 64-bit hashes. One pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.scan import Words, gram_starts, mix, owner, pieces, run_hashes, scan, word_hashes

LENGTH = 6  # words of a run, at least
EXPONENT = 4  # periods of a run, at least
_WORDS = 1 << 18  # words put together at once
RUNS = "array<struct<start: long, length: long, period: long>>"


# ---- suffix trees -----------------------------------------------------------------------------------------------


def ukkonen(text: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Per node of the suffix tree: parent, beginning of its edge, depth in symbols (of inner nodes); and the leaf of each
    suffix. Symbols are numbers from 0; the last one stands nowhere else."""
    size, sigma = len(text), max(text) + 1
    child: dict[int, int] = {}
    start, stop, parent, link, depth, leaves = [0], [0], [0], [0], [0], []
    node = edge = length = waiting = 0
    for i, symbol in enumerate(text):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                edge = i
            key = node * sigma + text[edge]
            below = child.get(key, 0)
            if not below:
                above, key_of_leaf = node, key
            else:
                span = stop[below] - start[below]
                if length >= span:
                    node, edge, length = below, edge + span, length - span
                    continue
                cut = start[below] + length
                if text[cut] == symbol:
                    if last:
                        link[last] = node
                    length += 1
                    break
                above = len(start)
                start.append(start[below])
                stop.append(cut)
                parent.append(node)
                link.append(0)
                depth.append(depth[node] + length)
                child[key] = above
                child[above * sigma + text[cut]] = below
                start[below], parent[below] = cut, above
                key_of_leaf = above * sigma + symbol
            leaf = len(start)
            start.append(i)
            stop.append(size)
            parent.append(above)
            link.append(0)
            depth.append(0)
            child[key_of_leaf] = leaf
            leaves.append(leaf)
            if last:
                link[last] = above
            last = above if above != node else 0
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return parent, start, depth, leaves


class SuffixTree:
    """The tree of ``text`` with its Euler tour. ``rank`` orders suffixes by the numbers of their symbols, and
    ``reversed_rank`` by falling numbers; the last symbol is 0 and least under both."""

    def __init__(self, text: np.ndarray, both_orders: bool):
        parent, start, depth, leaves = (np.array(x, np.int64) for x in ukkonen(text.tolist()))
        suffix = np.full(len(parent), -1)
        suffix[leaves] = np.arange(len(text))
        head = text[start]
        tour = self._tour(parent, head)
        at = np.flatnonzero(suffix[tour] >= 0)
        self.rank = self._ranks(suffix[tour[at]])
        turn = depth[parent[tour[at[:-1] + 1]]]  # the node where the tour turns between two leaves is the lowest
        self.least = [turn]
        while 2 << len(self.least) - 1 <= len(turn):
            step, below = 1 << len(self.least) - 1, self.least[-1]
            self.least.append(np.minimum(below[: len(below) - step], below[step:]))
        if both_orders:
            tour = self._tour(parent, np.where(head == 0, 0, text.max() + 1 - head))
            found = suffix[tour]
            self.reversed_rank = self._ranks(found[found >= 0])

    @staticmethod
    def _ranks(suffixes: np.ndarray) -> np.ndarray:
        rank = np.empty(len(suffixes), np.int64)
        rank[suffixes] = np.arange(len(suffixes))
        return rank

    @staticmethod
    def _tour(parent: np.ndarray, head: np.ndarray) -> np.ndarray:
        """All nodes as a walk in depth first meets them, children by ``head``."""
        order = np.lexsort((-head[1:], parent[1:])) + 1  # the walk takes the last one first
        ends = np.searchsorted(parent[order], np.arange(len(parent) + 1)).tolist()
        children, found, todo = order.tolist(), [], [0]
        while todo:
            node = todo.pop()
            found.append(node)
            if ends[node] < ends[node + 1]:
                todo += children[ends[node] : ends[node + 1]]
        return np.array(found)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of suffixes ``a`` and ``b`` (different ones)."""
        x, y = self.rank[a], self.rank[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((y - x).astype(float))[1] - 1
        result = np.empty(len(x), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            result[at] = np.minimum(self.least[k][x[at]], self.least[k][y[at] - (1 << int(k))])
        return result


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    values = rank.tolist()
    result, open_ = [len(values)] * len(values), []
    for i, value in enumerate(values):
        while open_ and values[open_[-1]] > value:
            result[open_.pop()] = i
        open_.append(i)
    return np.array(result)


def runs(symbols: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs with at least ``length`` symbols and ``exponent`` (2 or more) periods, by start
    and then period. Symbols are numbers from 1."""
    size = len(symbols)
    if size < 2:
        return np.zeros((0, 3), np.int64)
    forward = SuffixTree(np.append(symbols, 0), both_orders=True)
    place = np.arange(size)
    roots = [_next_smaller(rank)[:size] - place for rank in (forward.rank, forward.reversed_rank)]
    place, period = np.concatenate([place, place]), np.concatenate(roots)
    inside = place + period < size
    place, period = place[inside], period[inside]
    right = forward.common(place, place + period)
    del forward
    back = SuffixTree(np.append(symbols[::-1], 0), both_orders=False)
    left = np.zeros(len(place), np.int64)
    some = np.flatnonzero(place > 0)
    left[some] = back.common(size - place[some], size - place[some] - period[some])
    total = left + period + right
    found = np.column_stack([place - left, total, period])
    found = np.unique(found[total >= np.maximum(length, exponent * period)], axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


# ---- what a run can contain ---------------------------------------------------------------------------------------


def least_copies(length: int, exponent: int) -> tuple[int, int, int]:
    """(g, copies, room): any g words in a row inside a run stand there ``copies`` times or more, and a run has ``room``
    such places in a row at least.

    A run of L words has L - g + 1 places, dealt out over q residues, so each residue holds (L - g + 1) // q at least.
    """
    for gram in (3, 2, 1):
        # Beyond q = 2 (g - 1) the quotient no longer falls: (e q - g + 1) // q is then e - 1, or e for g = 1.
        least = [max(length, exponent * q) - gram + 1 for q in range(1, 2 * gram + length + 2)]
        copies = min(places // q for q, places in enumerate(least, 1))
        if copies >= 2 or gram == 1:
            return gram, copies, min(least)
    raise AssertionError


def reachable(w: Words, hashes: np.ndarray, length: int, exponent: int, rounds: int = 4) -> np.ndarray:
    """Mask of the words that a run can contain."""
    gram, copies, room = least_copies(length, exponent)
    at = gram_starts(w.first, gram)
    salt = mix(owner(w.first).astype(np.uint64) + np.uint64(11))
    keys = run_hashes(hashes, at, at + gram, seed=5) ^ salt[at]
    text = owner(w.first)
    for _ in range(rounds):
        before = len(at)
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        stay = count[which] >= copies
        at, keys = at[stay], keys[stay]
        if len(at):
            fresh = np.append(True, (np.diff(at) > 1) | (np.diff(text[at]) > 0))
            island = np.cumsum(fresh) - 1
            stay = np.bincount(island)[island] >= room
            at, keys = at[stay], keys[stay]
        if len(at) == before:
            break
    mask = np.zeros(len(hashes), bool)
    for step in range(gram):
        mask[at + step] = True
    return mask


def document_runs(hashes: np.ndarray, inside: np.ndarray, length: int, exponent: int) -> np.ndarray:
    """Runs of one document of which only the words ``inside`` (places, ascending) can be part of one."""
    if not len(inside):
        return np.zeros((0, 3), np.int64)
    _, symbols = np.unique(hashes[inside], return_inverse=True)
    breaks = np.flatnonzero(np.diff(inside) > 1) + 1
    separators = symbols.max() + 2 + np.arange(len(breaks))
    contracted = np.insert(symbols + 1, breaks, separators)
    places = np.insert(inside, breaks, -1)
    found = runs(contracted, length, exponent)
    found[:, 0] = places[found[:, 0]]
    return found


# ---- on Spark ---------------------------------------------------------------------------------------------------


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one blank."""
    words = np.flatnonzero(keep)
    text = owner(w.first)[words]
    size = (w.ends - w.starts)[words]
    follows = np.append(False, text[1:] == text[:-1])[: len(words)]  # a blank goes before it
    ends = np.cumsum(size + follows)
    out = np.full(ends[-1] if len(ends) else 0, 0x20, np.uint8)
    for at in range(0, len(words), _WORDS):
        part = slice(at, at + _WORDS)
        length = size[part]
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(ends[part] - length, length) + inner] = w.data[np.repeat(w.starts[words[part]], length) + inner]
    last = np.searchsorted(text, np.arange(len(w.first)))
    offsets = np.append(0, ends)[last].astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(out)]
    return pa.Array.from_buffers(pa.large_string(), len(w.first) - 1, buffers).cast(pa.string())


def find_runs(docs: DataFrame, length: int = LENGTH, exponent: int = EXPONENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period in words, by start and then period), collapsed.

    Words are runs of characters other than blanks; ``collapsed`` has each run cut to its first period, words joined by one
    blank. A null, empty or blank text has no words, no runs and an empty ``collapsed``; a text shorter than a run has none.
    Rows are judged one by one, so repeated rows and ids give repeated results; an empty table gives an empty result; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                w = scan(piece.column("text"))
                hashes = word_hashes(w)
                inside = np.flatnonzero(reachable(w, hashes, length, exponent))
                keep = np.ones(len(hashes), bool)
                edges = np.searchsorted(inside, w.first)
                found = []
                for d in range(len(piece)):
                    low, high = w.first[d], w.first[d + 1]
                    own = document_runs(hashes[low:high], inside[edges[d] : edges[d + 1]] - low, length, exponent)
                    for start, size, period in own.tolist():
                        keep[low + start + period : low + start + size] = False
                    found.append(own)
                values = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                fields = [pa.array(values[:, k].copy()) for k in range(3)]
                offsets = pa.array(np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                columns = [piece.column("doc_id"), pa.array(np.diff(w.first)), lists, joined(w, keep)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")
