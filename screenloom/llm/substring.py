"""Exact substring deduplication by seed and extend.

Seeds are winnowed word anchors: of the 5-word runs in each 13-word window the one with the least hash, so equal
windows choose the same anchor at the same place. The windows that choose one anchor follow each other; their words
together are the anchor's reach. Documents meet on anchors:

* reach also found in a smaller document: every window in it is repeated (the match extends over the whole reach);
* only the anchor found there: the match ends inside the reach, so its windows are compared one by one, against one
  witness (the smallest document) for each different reach of that anchor;
* otherwise nothing repeats there.

Consecutive repeated windows merge into maximal repeats. Copies within one Arrow batch are settled before the shuffle,
so an anchor reaches it once a batch however many documents share it. Nothing emits pairs of documents.

Equality between documents is equality of two 64-bit hashes: of anchor and reach, or two of a window. Words are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenloom.llm.scan import Words, gram_starts, owner, pieces, run_hashes, scan, word_hashes

ANCHOR_WORDS = 5
_RESOLVED, _OPEN, _WITNESS = 0, 1, 2


def _anchors(words: Words, length: int) -> tuple[np.ndarray, ...]:
    """For each reach: text, first window, last window, anchor hash, reach hash; and the word hashes."""
    hashes = word_hashes(words)
    windows = gram_starts(words.first, length)
    if not len(windows):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), hashes
    span = length - ANCHOR_WORDS + 1
    at = np.arange(len(hashes) - ANCHOR_WORDS + 1)
    grams = run_hashes(hashes, at, at + ANCHOR_WORDS, seed=1)
    least, place = grams[windows].copy(), np.zeros(len(windows), dtype=np.int64)
    for step in range(1, span):
        value = grams[windows + step]
        better = value < least
        least[better] = value[better]
        place[better] = step
    anchor = windows + place
    text = owner(words.first)[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(windows)) - 1
    low, high, mid = windows[head], windows[tail], anchor[head]
    reach = run_hashes(hashes, low, high + length, seed=2) ^ ((mid - low) * 64 + (high - low)).astype(np.uint64)
    return text[head], low, high, grams[mid], reach, hashes


def _seed(column: str, length: int):
    """Rows (anchor, reach, doc_id, kind) of a batch: one open row per reach, for its smallest document; larger
    documents of the batch are resolved at once and travel under a key of their own, apart from hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for piece in pieces(batch, column):
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                text, _, _, anchor, reach, _ = _anchors(scan(piece.column(column)), length)
                found.append((anchor, reach, ids[text]))
            if not found:
                continue
            anchor, reach, ids = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((ids, reach))
            anchor, reach, ids = anchor[order], reach[order], ids[order]
            same = reach[1:] == reach[:-1]
            keep = np.append(True, ~(same & (ids[1:] == ids[:-1]))) if len(ids) else np.zeros(0, bool)
            first = np.append(True, ~same)[: len(ids)]
            least = ids[first][np.cumsum(first) - 1] if len(ids) else ids
            resolved = ids > least
            key = np.where(resolved, run_hashes(ids.view(np.uint64), np.arange(len(ids)), np.arange(len(ids)) + 1), anchor)
            kind = np.where(resolved, _RESOLVED, _OPEN).astype(np.int8)
            columns = [key.view(np.int64)[keep], reach.view(np.int64)[keep], ids[keep], kind[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "reach", "doc_id", "kind"])

    return run


def _windows(length: int):
    """Rows (window, check, doc_id) of the windows in open or witness reaches; two hashes name a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pc.fill_null(pc.greater(pc.list_value_length(batch.column("unsettled")), 0), False)
            for piece in pieces(batch.filter(some), "text"):
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                text, low, high, _, reach, hashes = _anchors(scan(piece.column("text")), length)
                wanted = _listed(piece.column("unsettled"), text, reach)
                starts = _ranges(low[wanted], high[wanted])
                value, check = (run_hashes(hashes, starts, starts + length, seed=k).view(np.int64) for k in (3, 4))
                docs = np.repeat(ids[text[wanted]], (high - low + 1)[wanted])
                order = np.lexsort((value, docs))
                docs, value, check = docs[order], value[order], check[order]
                new = np.append(True, (docs[1:] != docs[:-1]) | (value[1:] != value[:-1]))[: len(docs)]
                columns = [pa.array(c[new]) for c in (value, check, docs)]
                yield pa.RecordBatch.from_arrays(columns, names=["window", "check", "doc_id"])

    return run


def _listed(lists: pa.Array, text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether ``value[i]`` stands in the list of its text. Lists are sorted by text, so one search serves all."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    counts = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(flat) or not len(text):
        return np.zeros(len(text), dtype=bool)
    here = np.stack([np.repeat(np.arange(len(counts)), counts), flat])
    here = np.unique(here[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ here[1].view(np.uint64))
    key = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ value.view(np.uint64)
    return here[np.minimum(np.searchsorted(here, key), len(here) - 1)] == key


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the closed ranges, one after another."""
    size = high - low + 1
    if not len(size):
        return np.zeros(0, dtype=np.int64)
    steps = np.ones(int(size.sum()), dtype=np.int64)
    at = np.cumsum(size)[:-1]
    steps[0] = low[0]
    steps[at] = low[1:] - high[:-1]
    return np.cumsum(steps)


def _cut(length: int):
    """Remove covered words: rows (doc_id, n_words, n_removed, kept_text, repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = scan(piece.column("text"))
                text, low, high, _, reach, hashes = _anchors(words, length)
                whole = _listed(piece.column("resolved"), text, reach)
                depth = np.zeros(len(hashes) + 1, dtype=np.int64)
                np.add.at(depth, low[whole], 1)
                np.add.at(depth, high[whole] + length, -1)
                part = _listed(piece.column("unsettled"), text, reach) & ~whole
                starts = _ranges(low[part], high[part])
                value = run_hashes(hashes, starts, starts + length, seed=3)
                starts = starts[_listed(piece.column("repeated"), owner(words.first)[starts], value)]
                np.add.at(depth, starts, 1)
                np.add.at(depth, starts + length, -1)
                gone = np.cumsum(depth[:-1]) > 0
                yield _result(piece, words, gone)

    return run


def _result(piece: pa.RecordBatch, words: Words, gone: np.ndarray) -> pa.RecordBatch:
    data = words.data.tobytes()
    kept, removed, repeats = [], [], []
    for d in range(len(piece)):
        a, b = words.first[d], words.first[d + 1]
        here = gone[a:b]
        removed.append(int(here.sum()))
        own = data[words.offsets[d] : words.offsets[d + 1]].split()  # bytes split at the same six separators
        joined = b" ".join([w for w, out in zip(own, here.tolist(), strict=True) if not out] if here.any() else own)
        kept.append(joined)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]])))
        repeats.append(edge.astype(np.int64))
    flat = np.concatenate(repeats) if repeats else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, repeats)]), pa.int32()), pa.array(flat))
    return pa.RecordBatch.from_arrays(
        [
            piece.column("doc_id"),
            pa.array(np.diff(words.first), pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array([k.decode() for k in kept], pa.string()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            lists,
        ],
        names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "repeats"],
    )


def remove_repeats(docs: DataFrame, length: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its words without those inside a ``length``-word run that a smaller ``doc_id`` has too.

    Columns: doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256, and repeats (begin
    and end word numbers of the maximal repeats, in turn). Runs are judged on the input. A null text has no words; a
    text shorter than ``length`` loses nothing; a row without id loses nothing and takes nothing. Rows that share an
    id never remove each other's words. An empty table gives an empty result; other columns are ignored.
    """
    if length < ANCHOR_WORDS:
        raise ValueError(f"length must be {ANCHOR_WORDS} words or more")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "anchor long, reach long, doc_id long, kind byte"
    seeds = texts.where("doc_id is not null").mapInArrow(_seed("text", length), schema)
    by_anchor, by_reach = Window.partitionBy("anchor"), Window.partitionBy("anchor", "reach")
    met = (
        seeds.withColumn("_reach_doc", F.min("doc_id").over(by_reach))
        .withColumn("_anchor_doc", F.min("doc_id").over(by_anchor))
        .withColumn("_last_reach", F.max("reach").over(by_anchor))
        .withColumn("_first_reach", F.min("reach").over(by_anchor))
    )
    own = F.col("doc_id") == F.col("_reach_doc")
    state = (
        F.when((F.col("kind") == _RESOLVED) | ~own, F.lit(_RESOLVED))
        .when(F.col("_anchor_doc") < F.col("doc_id"), F.lit(_OPEN))
        .when(F.col("_first_reach") < F.col("_last_reach"), F.lit(_WITNESS))
    )
    states = met.select("doc_id", "reach", state.alias("state")).where("state is not null")
    lists = states.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("state") == _RESOLVED, F.col("reach"))).alias("resolved"),
        F.collect_list(F.when(F.col("state") != _RESOLVED, F.col("reach"))).alias("unsettled"),
    )
    # Both passes over the texts read this join as it is, so that the texts are shuffled once.
    listed = texts.join(lists, "doc_id", "left").select("doc_id", "text", "resolved", "unsettled")
    windows = listed.mapInArrow(_windows(length), "window long, check long, doc_id long")
    least = F.min("doc_id").over(Window.partitionBy("window", "check"))
    repeated = (
        windows.withColumn("_least", least)
        .where("_least < doc_id")
        .groupBy("doc_id")
        .agg(F.collect_list("window").alias("repeated"))
    )
    result = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, repeats array<long>"
    return (
        listed.join(repeated, "doc_id", "left")
        .select("doc_id", "text", "resolved", "unsettled", "repeated")
        .mapInArrow(_cut(length), result)
    )
