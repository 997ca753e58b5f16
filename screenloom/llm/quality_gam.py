"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a row of shape features (lengths, character classes, repetition). Features are cut into quantile bins.
Shallow trees are boosted in turn, feature after feature, each adding to the lookup table of its feature; then the same
on the feature pairs that explain most of what is left. A score is the sum of one table entry per feature and pair.

The model is fitted on a bounded sample of labelled rows (``MAX_ROWS`` rows of ``len(FEATURES)`` numbers); its tables,
some ten thousand numbers, go to the tasks that score all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.labelled import MAX_ROWS, held_out, labelled_texts
from screenloom.llm.scan import gram_starts, owner, pieces, run_hashes, scan, word_hashes

FEATURES = [
    "log_words", "log_bytes", "mean_word", "std_word", "longest_word", "upper", "lower", "digit", "wide", "stop", "comma",
    "shout", "bar", "symbol", "bracket", "quote", "lines", "line_words", "distinct_words", "distinct_pairs",
    "distinct_runs", "top_word", "top_run", "same_as_before", "short_words", "capital_words", "marked_words", "all_caps",
]
BINS, PAIR_BINS, PAIRS = 32, 8, 10


# ---- features ---------------------------------------------------------------------------------------------------


def _class(table: np.ndarray, characters: str) -> np.ndarray:
    return table[:, [ord(c) for c in characters]].sum(axis=1)


def _most(values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Greatest value per text (``text`` ascending); zero without any."""
    most = np.zeros(texts)
    if len(values):
        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        most[text[heads]] = np.maximum.reduceat(values, heads)
    return most


def _repeats(keys: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many different keys, and how often the commonest stands. 40 bits tell the keys of a text apart."""
    if not len(keys):
        return np.zeros(texts), np.zeros(texts)
    k = np.sort((text.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24)))
    heads = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(heads, len(k)))
    where = (k[heads] >> np.uint64(40)).astype(np.int64)
    return np.bincount(where, minlength=texts).astype(float), _most(size, where, texts)


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; a null text or one without words is all zeros."""
    w = scan(texts)
    n = len(w.offsets) - 1
    size = np.diff(w.offsets)
    table = np.zeros((n, 256))
    for d in range(n):
        table[d] = np.bincount(w.data[w.offsets[d] : w.offsets[d + 1]], minlength=256)
    words = np.diff(w.first)
    text = owner(w.first)
    length = (w.ends - w.starts).astype(float)
    per_word = lambda v: np.bincount(text, v, minlength=n) / np.maximum(words, 1)
    per_byte = lambda v: v / np.maximum(size, 1)
    mean = per_word(length)
    longest = _most(length, text, n)
    hashes = word_hashes(w)
    distinct, top = _repeats(hashes, text, n)
    shares = []
    for run in (2, 3):
        at = gram_starts(w.first, run)
        runs = run_hashes(hashes, at, at + run)
        several, most = _repeats(runs, text[at], n)
        shares.append((several / np.maximum(words - run + 1, 1), most / np.maximum(words - run + 1, 1)))
    before = np.zeros(len(hashes))
    before[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    head = w.data[w.starts] if len(w.starts) else np.zeros(0, np.uint8)
    tail = w.data[w.ends - 1] if len(w.ends) else head
    upper = np.concatenate([[0], np.cumsum((w.data >= 65) & (w.data <= 90))])
    lower = np.concatenate([[0], np.cumsum((w.data >= 97) & (w.data <= 122))])
    ups, lows = upper[w.ends] - upper[w.starts], lower[w.ends] - lower[w.starts]
    marked = (tail < 128) & ~((tail >= 48) & (tail <= 57)) & ~((tail >= 65) & (tail <= 90)) & ~((tail >= 97) & (tail <= 122))
    lines = table[:, 10] + (size > 0)
    columns = [
        np.log1p(words), np.log1p(size), mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)), longest,
        per_byte(table[:, 65:91].sum(axis=1)), per_byte(table[:, 97:123].sum(axis=1)), per_byte(table[:, 48:58].sum(axis=1)),
        per_byte(table[:, 128:].sum(axis=1)), per_byte(_class(table, ".?")), per_byte(_class(table, ",;:")),
        per_byte(_class(table, "!")), per_byte(_class(table, "|")), per_byte(_class(table, "#$%&*@^~_+=\\/<>")),
        per_byte(_class(table, "()[]{}")), per_byte(_class(table, "\"'`-")), lines / np.maximum(words, 1),
        words / np.maximum(lines, 1), distinct / np.maximum(words, 1), shares[0][0], shares[1][0],
        top / np.maximum(words, 1), shares[1][1], per_word(before), per_word(length <= 3),
        per_word((head >= 65) & (head <= 90)), per_word(marked), per_word((ups > 1) & (lows == 0)),
    ]
    rows = np.stack(columns, axis=1) if n else np.zeros((0, len(FEATURES)))
    rows[words == 0] = 0
    return rows


# ---- the model --------------------------------------------------------------------------------------------------


@dataclass
class Gam:
    """Score of a row: ``sigmoid(base + sum tables[f][bin] + sum pair_tables[p][bin, bin])``."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, rows[:, f], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            left = np.searchsorted(self.pair_edges[a], rows[:, a], side="right")
            total += table[left, np.searchsorted(self.pair_edges[b], rows[:, b], side="right")]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """The step of a tree of depth two over ordered bins: a value per bin."""

    def cut(a: int, b: int) -> int | None:
        sg, sh = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        tg, th = g[a:b].sum(), h[a:b].sum()
        fits = (sh >= least) & (th - sh >= least)
        if not fits.any():
            return None
        gain = np.where(fits, sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge), -1)
        best = int(gain.argmax())
        return a + best + 1 if gain[best] > 1e-9 else None

    ends = [0, len(g)]
    if middle := cut(0, len(g)):
        ends = sorted({0, middle, len(g), *filter(None, (cut(0, middle), cut(middle, len(g))))})
    step = np.zeros(len(g))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a table into four parts: its gain, and a value per cell."""
    best, step = 0.0, np.zeros_like(g)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    cg, ch = np.zeros(np.add(g.shape, 1)), np.zeros(np.add(g.shape, 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [
                (cg[i, j], ch[i, j]),
                (cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j]),
                (cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j]),
                (cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]),
            ]
            gain = sum(a * a / (b + ridge) for a, b in parts) - whole
            if gain > best:
                best = gain
                values = [a / (b + ridge) for a, b in parts]
                step[:i, :j], step[:i, j:], step[i:, :j], step[i:, j:] = values
    return best, step


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.15, ridge: float = 2.0, least: float = 2.0) -> Gam:
    """Cyclic boosting on the logistic loss. One class only (or no rows) gives a constant score."""
    positive = float(labels.sum())
    prior = (positive + 1) / (len(labels) + 2)
    model = Gam(base=float(np.log(prior / (1 - prior))))
    if not 0 < positive < len(labels):
        return model
    count = rows.shape[1]
    model.edges = [_edges(rows[:, f], BINS) for f in range(count)]
    model.pair_edges = [_edges(rows[:, f], PAIR_BINS) for f in range(count)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, rows[:, f], side="right") for f, e in enumerate(model.edges)]
    margin = np.full(len(labels), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return labels - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(count):
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size), ridge, least)
            model.tables[f] += step
            margin += step[bins[f]]
    coarse = [np.searchsorted(e, rows[:, f], side="right") for f, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def cells(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = coarse[a] * shape[b] + coarse[b]
        size = shape[a] * shape[b]
        return np.bincount(place, g, size).reshape(shape[a], shape[b]), np.bincount(place, h, size).reshape(shape[a], shape[b])

    g, h = slopes()
    gains = {(a, b): _quadrants(*cells(a, b, g, h), ridge)[0] for a in range(count) for b in range(a)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(rounds // 5):
        for k, (a, b) in enumerate(model.pairs):
            step = rate * _quadrants(*cells(a, b, *slopes()), ridge)[1]
            model.pair_tables[k] += step
            margin += step[coarse[a], coarse[b]]
    return model


# ---- on Spark ---------------------------------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, max_rows: int = MAX_ROWS) -> Gam:
    """Fit on at most ``max_rows`` labelled texts that are not held out. No labels give a constant score of one half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                flat = pa.array(features(piece.column("text")).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(piece) + 1) * len(FEATURES), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), lists], names=["doc_id", "label", "row"])

    sample = labelled_texts(docs, labels, "quality", modulus, remainder, max_rows)
    found = sample.mapInArrow(run, "doc_id long, label int, row array<double>").toArrow()
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    rows = found["row"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))[order]
    return fit(rows, (found["label"].to_numpy()[order] > 0).astype(float))


def score(docs: DataFrame, model: Gam, modulus: int = 4, remainder: int = 2, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score (higher: label 1 likelier), predicted (score >= threshold).

    A null or empty text has all features zero and is scored like any other; rows are judged one by one, so repeated
    rows and ids give repeated results. An empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                values = pa.array(model.score(features(piece.column("text"))))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), values], names=["doc_id", "held_out", "score"])

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out("doc_id", modulus, remainder).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    scored = texts.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Gam, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns, in one pass."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                good = model.score(features(piece.column(text))) >= threshold
                yield piece.filter(pa.array(good)).select(names)

    return docs.mapInArrow(run, docs.schema)
