"""Cross-entropy difference between two matched n-gram models.

The target model counts the words of chosen documents, the background model those of all documents. Both share one
vocabulary (every word of the corpus, and one symbol for the beginning of a text) and one smoothing, so their losses differ by
the counts alone. A document's score is the mean over its tokens of the loss under the target model minus the loss under the
background model: the lower, the more it reads like the target.

Words and bigrams are counted exactly, in tables that grow with the corpus, without a row for any of them. Texts are packed into
blocks. A block sends the sorted hashes of its different words and bigrams, with their counts, as bytes to the ranges of hashes they
fall into; a range adds up what all blocks sent and answers each of them with the counts in the corpus, in the order in which it
asked. The block, whose texts meet the answers in a cogroup, then has every count its losses need. Words and bigrams are equal where
their 64-bit hashes are.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.scan import mix, owner, pieces, scan, word_hashes
from screenloom.session import stage

HOT = 1 << 21  # hashes that meet in one range, about, repeated ones included
BEGIN = 0  # stands for the word before a text
_TEXT = 1 << 22  # bytes of text in a block, or one longer text
_LEAST = 1 << 10  # a range is worth no less
_RANGES = 1 << 16
PRIOR = 8.0  # how many tokens the unigram share weighs against the bigram counts


# ---- counts that grow with the corpus ---------------------------------------------------------------------------


def _bigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its text, the hash of the word before it, its hash."""
    w = scan(texts)
    now = word_hashes(w)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[w.first[:-1][np.diff(w.first) > 0]] = BEGIN
    return owner(w.first), before, now


def _keys(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + now)


def _bytes(values: np.ndarray) -> bytes:
    """Whole numbers, their first bytes together, then their second ones: small ones take little."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _numbers(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8")[:, 0]


def _block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Texts and ids as one row."""
    table = pa.Table.from_batches(parts)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as out:
        out.write_table(table.combine_chunks())
    ids = pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64()))
    columns = [pa.array([uuid.uuid4().int >> 65]), ids, pa.array([table["text"].nbytes]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "size", "body"])


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in pieces(batch, "text"):
            if held and size + piece.nbytes > _TEXT:
                yield _block(held)
                held, size = [], 0
            held.append(piece)
            size += piece.nbytes
    if held:
        yield _block(held)


def _opened(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def _different(body: bytes) -> tuple[pa.Table, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """A block's table, the row of each of its words, its different words (and the beginning) and bigrams, ascending, and where
    among them each word, the one before it, and the bigram stand."""
    table = _opened(body)
    text, before, now = _bigrams(table["text"].chunk(0)) if len(table) else (np.zeros(0, int), *[np.zeros(0, np.uint64)] * 2)
    words = np.unique(np.append(now, np.uint64(BEGIN)))
    pairs, pair = np.unique(_keys(before, now), return_inverse=True)
    return table, text, [words, pairs], [np.searchsorted(words, now), np.searchsorted(words, before), pair]


def _sent(frame: pd.DataFrame, marked: pd.DataFrame, bits: int) -> pd.DataFrame:
    """What a block sends to each range."""
    rows = []
    for number, body in zip(frame["block"], frame["body"], strict=True):
        table, text, kinds, (word, before, pair) = _different(body)
        target = np.zeros(len(table), bool)
        target[marked["place"].to_numpy(dtype=np.int64)] = True
        chosen, begins = target[text], kinds[0][before] == BEGIN
        for kind, (keys, at) in enumerate(zip(kinds, (word, pair), strict=True)):
            counts = [np.bincount(at, w, minlength=len(keys)).astype(np.int64) for w in (chosen, np.ones(len(at), bool))]
            if not kind:
                for k, w in enumerate((chosen & begins, begins)):
                    counts[k][0] += w.sum()
            where = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            for low, high in _runs(where):
                some = np.diff(keys[low:high], prepend=np.uint64(0))
                rows.append((2 * int(where[low]) + kind, number, high - low, _bytes(some), *(_bytes(c[low:high]) for c in counts)))
    return pd.DataFrame(rows, columns=["range", "block", "n", "keys", "target", "background"])


def _runs(where: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(where)) + 1
    ends = [0, *cuts.tolist(), len(where)]
    return ((a, b) for a, b in zip(ends[:-1], ends[1:], strict=True) if a < b)


def _answered(frame: pd.DataFrame) -> pd.DataFrame:
    """The counts of a range in the whole corpus, for each block that asked; its first row also tells how many words the range has."""
    sizes = frame["n"].to_numpy(dtype=np.int64)
    keys = np.concatenate([np.cumsum(_numbers(k, n), dtype=np.uint64) for k, n in zip(frame["keys"], sizes, strict=True)])
    known, at = np.unique(keys, return_inverse=True)
    ends, found = np.append(0, np.cumsum(sizes)), {"range": frame["range"], "block": frame["block"], "n": sizes}
    real = (known != BEGIN) & (int(frame["range"].iloc[0]) % 2 == 0)
    first = np.arange(len(frame)) == 0
    found["kinds"] = np.where(first, real.sum(), 0)
    for side in ("target", "background"):
        given = np.concatenate([_numbers(c, n) for c, n in zip(frame[side], sizes, strict=True)])
        total = np.bincount(at, given, minlength=len(known)).astype(np.int64)
        found[f"{side}_words"] = np.where(first, total[real].sum(), 0)
        found[side] = [_bytes(total[at[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pd.DataFrame(found)


def _scored(frame: pd.DataFrame, answers: pd.DataFrame, size: dict[str, float], prior: float) -> pd.DataFrame:
    """The mean losses of each text of a block."""
    answers = answers.sort_values("range")
    rows = []
    for body in frame["body"]:
        table, text, _, (word, before, pair) = _different(body)
        n_tokens = np.bincount(text, minlength=len(table))
        ids = table["doc_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        found = {"doc_id": ids, "n_tokens": n_tokens}
        for side in ("target", "background"):
            counts = []
            for kind in (0, 1):
                own = answers[answers["range"] % 2 == kind]
                counts.append(np.concatenate([np.zeros(0), *(_numbers(c, n) for c, n in zip(own[side], own["n"], strict=True))]))
            share = (counts[0][word] + 1.0) / (size[f"{side}_words"] + max(size["kinds"], 1))
            losses = -np.log((counts[1][pair] + prior * share) / (counts[0][before] + prior))
            found[f"{side}_loss"] = np.bincount(text, losses, minlength=len(table)) / np.maximum(n_tokens, 1)
        rows.append(pd.DataFrame(found))
    every = ["doc_id", "n_tokens", "target_loss", "background_loss"]
    return pd.concat(rows)[every] if rows else pd.DataFrame(columns=every)


def score_all(docs: DataFrame, targets: DataFrame, prior: float = PRIOR, hot: int = HOT) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, n_tokens, target_loss, background_loss, difference. The target
    model counts the documents whose id stands in ``targets`` (doc_id, each once), the background model all. About ``hot`` hashes
    meet in one range, 1,024 at least and no less than what falls into a 65,536th.
    """
    blocks = stage(docs.select("doc_id", "text").mapInArrow(_in_blocks, "block long, ids array<long>, size long, body binary"), "blocks")
    places = blocks.select("block", F.posexplode("ids").alias("place", "doc_id"))
    marked = places.join(targets.hint("merge"), "doc_id").select(F.col("block").alias("of"), "place")
    hashes = (blocks.agg(F.sum("size")).first()[0] or 0) / 3  # words and bigrams, about
    bits = math.ceil(math.log2(min(_RANGES, max(1.0, hashes / max(hot, _LEAST)))))
    bodies = blocks.select("block", "body").groupBy("block")
    sent = bodies.cogroup(marked.groupBy("of")).applyInPandas(
        lambda frame, places: _sent(frame, places, bits), "range int, block long, n long, keys binary, target binary, background binary"
    )
    kept = "range int, block long, n long, kinds long, target_words long, target binary, background_words long, background binary"
    answers = stage(sent.groupBy("range").applyInPandas(_answered, kept), "answers")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kinds", "target_words", "background_words")]
    size = {k: float(v) for k, v in answers.agg(*sums).first().asDict().items()}
    scored = bodies.cogroup(answers.select("range", "block", "n", "target", "background").groupBy("block")).applyInPandas(
        lambda frame, own: _scored(frame, own, size, float(prior)), "doc_id long, n_tokens long, target_loss double, background_loss double"
    )
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, label: str = "quality", hot: int = HOT) -> DataFrame:
    """Score all documents, with those labelled 1 as the target. Labels meet documents by id; of labels that share an id the
    greatest counts. Both sides are dealt out by id at every size: labels grow with the corpus and are never broadcast.

    A null text or one without words has no tokens and zero losses. Rows are judged one by one, so repeated rows and ids give
    repeated results; an empty table gives an empty result; other columns are ignored.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label)).alias("_label"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score_all(narrow, known.where("_label = 1").select("doc_id"), hot=hot)
