"""Toxicity by weak supervision.

Voters are lexicon entries (words) and patterns (word beginnings, shouting, exclamations). Lexicon and beginnings are
mined from a bounded sample of labelled rows: those found far more often in toxic texts. A voter fires on a text or
abstains. A generative label model has, per class, the rate at which each voter fires (its accuracy) and, within classes,
the covariance of the voters (their correlations: a word and its own beginnings fire together and count once; those that
fire on the very same texts of the sample are one voter). It is fitted by expectation maximisation and gives each text of the sample a posterior label; a linear classifier is trained on
those, with one weight per voter. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.labelled import MAX_ROWS, held_out, labelled_texts
from screenloom.llm.scan import Words, mix, owner, pieces, scan, word_hashes

BEGINNINGS = (4, 5, 6, 7)  # bytes of a word beginning
STYLE = ["shouting", "exclamations", "marks"]
# Word characters: letters and digits of ASCII, and all else beyond it.
_BREAKS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))


def _voter_keys(texts: pa.Array) -> tuple[Words, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For whole words and for each beginning: (word numbers, keys, lengths in bytes)."""
    w = scan(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), _BREAKS)
    length = w.ends - w.starts
    every = np.arange(len(length))
    found = [(every, mix(word_hashes(w) + np.uint64(1)), length)]
    for size in BEGINNINGS:
        after = np.append(w.data, 0)[np.minimum(w.starts + size, len(w.data))]
        some = np.flatnonzero((length > size) & ((after & 0xC0) != 0x80))  # never inside a character
        part = Words(w.data, w.offsets, w.starts[some], w.starts[some] + size, w.first)
        found.append((some, mix(word_hashes(part) + np.uint64(2)), np.full(len(some), size)))
    return w, found


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, example, toxic, clean): in how many texts of each label a possible voter stands."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            toxic = piece.column("label").to_numpy(zero_copy_only=False) > 0
            w, found = _voter_keys(piece.column("text"))
            text = owner(w.first)
            for kind, (some, keys, length) in enumerate(found):
                pairs = np.unique(np.rec.fromarrays([keys, text[some]], names="key,text"), return_index=True)
                key, where, at = pairs[0]["key"], pairs[0]["text"], pairs[1]
                heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                hits = np.add.reduceat(toxic[where].astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
                size = np.diff(np.append(heads, len(key)))
                start = w.starts[some[at[heads]]]
                data = w.data.tobytes()
                names = [
                    data[s : s + n].decode("utf-8", "replace") + ("" if kind == 0 else "*") if h else ""
                    for s, n, h in zip(start.tolist(), length[at[heads]].tolist(), hits.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[heads].view(np.int64)), pa.array(names, pa.string()), pa.array(hits), pa.array(size - hits)],
                    names=["key", "example", "toxic", "clean"],
                )


def _style(w: Words) -> np.ndarray:
    """Per text whether it shouts, exclaims or strings marks together; the texts as they are."""
    n = len(w.offsets) - 1
    share = np.zeros((n, 3))
    for d in range(n):
        c = np.bincount(w.data[w.offsets[d] : w.offsets[d + 1]], minlength=128)
        letters = max(1, c[65:91].sum() + c[97:123].sum())
        share[d] = c[65:91].sum() / letters > 0.5, c[33] > 0.02 * max(1, c.sum()), c[35:39].sum() > 0.02 * max(1, c.sum())
    return share


def counts(texts: pa.Array, keys: np.ndarray, voter: np.ndarray) -> np.ndarray:
    """How often each voter fires per text: the mined ones (``keys``, ascending, each with its ``voter``), then the style voters.
    A voter of several keys fires as often as the most frequent of them."""
    w, found = _voter_keys(texts)
    n = len(w.first) - 1
    text = owner(w.first)
    mined = int(voter.max()) + 1 if len(voter) else 0
    total = np.zeros((n, mined + len(STYLE)), np.float32)
    for some, key, _ in found:
        if len(keys) and len(key):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == key)
            place, many = np.unique(text[some[hit]] * len(keys) + at[hit], return_counts=True)
            np.maximum.at(total, (place // len(keys), voter[place % len(keys)]), many)
    total[:, mined:] = _style(scan(texts))
    return total


# ---- label model and classifier ---------------------------------------------------------------------------------


@dataclass
class Sparse:
    """A matrix by its entries (row, column, value), of which few are not zero."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, rows: np.ndarray) -> Sparse:
        row, column = np.nonzero(rows)
        return cls(row, column, rows[row, column].astype(float), rows.shape)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.column], minlength=self.shape[0])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Of each column, rows weighted."""
        return np.bincount(self.column, self.value * weights[self.row], minlength=self.shape[1])

    def products(self, weights: np.ndarray, step: int = 2048) -> np.ndarray:
        """The sum of ``weight * row' row``, a block of rows at a time; entries stand in the order of rows."""
        total = np.zeros((self.shape[1],) * 2)
        for at in range(0, self.shape[0], step):
            low, high = np.searchsorted(self.row, (at, at + step))
            part = np.zeros((min(step, self.shape[0] - at), self.shape[1]))
            part[self.row[low:high] - at, self.column[low:high]] = self.value[low:high]
            total += (part * weights[at : at + step, None]).T @ part
        return total


def together(row: np.ndarray, key: np.ndarray, keys: int) -> np.ndarray:
    """The voter of each mined key, given the entries (text, key) where it fires: keys that fire on the same texts are one."""
    order = np.lexsort((row, key))
    cuts = np.searchsorted(key[order], np.arange(1, keys))
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(texts.tobytes(), len(known)) for texts in np.split(row[order], cuts)][:keys], np.int64)


def label_model(votes: Sparse | np.ndarray, labels: np.ndarray, rounds: int = 20, ridge: float = 0.02) -> np.ndarray:
    """Posterior probability of label 1 per row.

    The first step takes the labels; later ones the posteriors. Rounds end when the labels become less likely, so that
    the mixture cannot drift to another split of the texts, such as by language.

    The covariance within classes follows from the products of all votes, which are summed once: with the rates r and the
    sums s of a class of n rows, it takes away s r' + r s' - n r r'.
    """
    votes = votes if isinstance(votes, Sparse) else Sparse.of(votes)
    count, width = votes.shape
    posterior = np.clip(labels, 0.02, 0.98)
    best, best_fit = posterior, -np.inf
    products = votes.products(np.ones(count))
    mean = votes.sums(np.ones(count)) / count
    for _ in range(rounds):
        share = posterior.mean()
        rates = [(votes.sums(p) + 0.5 * mean) / (p.sum() + 0.5) for p in (1 - posterior, posterior)]
        within = products.copy()
        for rate, member in zip(rates, (posterior <= 0.5, posterior > 0.5), strict=True):
            cross = np.outer(votes.sums(member.astype(float)), rate)
            within -= cross + cross.T - member.sum() * np.outer(rate, rate)
        weights = np.linalg.solve(within / count + ridge * np.eye(width), rates[1] - rates[0])
        margin = votes.times(weights) - (rates[0] + rates[1]) @ weights / 2 + np.log(share / (1 - share))
        posterior = np.clip(1 / (1 + np.exp(-np.clip(margin, -30, 30))), 1e-4, 1 - 1e-4)
        fit = float(np.mean(labels * np.log(posterior) + (1 - labels) * np.log(1 - posterior)))
        if fit <= best_fit + 1e-5:
            break
        best, best_fit = posterior, fit
    return best


def linear_classifier(rows: Sparse | np.ndarray, targets: np.ndarray, penalty: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Logistic weights and intercept (last) on soft targets, by Newton steps with an L2 penalty."""
    rows = rows if isinstance(rows, Sparse) else Sparse.of(rows)
    width = rows.shape[1]
    weights = np.zeros(width + 1)
    ridge = np.full(width + 1, penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows.times(weights[:-1]) + weights[-1], -30, 30)))
        curvature = p * (1 - p) + 1e-6
        curve = np.diag(ridge)
        curve[:-1, :-1] += rows.products(curvature)
        curve[-1, :-1] = curve[:-1, -1] = rows.sums(curvature)
        curve[-1, -1] += curvature.sum()
        step = np.linalg.solve(curve, np.append(rows.sums(targets - p), (targets - p).sum()) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-4:
            break
    return weights


@dataclass
class ToxicityModel:
    keys: np.ndarray  # of words and beginnings, ascending
    names: list[str]
    voter: np.ndarray  # the voter of each key
    weights: np.ndarray  # of voters, of style voters, and the intercept

    def score(self, texts: pa.Array) -> np.ndarray:
        rows = np.log1p(counts(texts, self.keys, self.voter))
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights[:-1] + self.weights[-1], -30, 30)))


# ---- on Spark ---------------------------------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled texts that are not held out. Without labels of both kinds the score is their
    mean, or one half without any."""
    sample = labelled_texts(docs, labels, "toxic", modulus, remainder, max_rows)
    found = sample.mapInArrow(_mine, "key long, example string, toxic long, clean long")
    total = found.groupBy("key").agg(F.max("example").alias("example"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    size = sample.agg(F.count("*"), F.sum(F.when(F.col("label") > 0, 1).otherwise(0))).first()
    base = max(size[1] or 0, 1) / max(size[0], 1)
    precise = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    voters = (
        total.where(F.col("toxic") >= 3).where(precise >= min(0.9, max(0.6, 3 * base)))
        .select("key", "example").collect()
    )  # fmt: skip  # no more than the sample has words
    names = {np.uint64(r["key"] & (1 << 64) - 1): r["example"] for r in voters}
    keys = np.array(sorted(names), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text the voters that fire and how often, as pairs of numbers."""
        for batch in batches:
            for piece in pieces(batch, "text"):
                votes = Sparse.of(counts(piece.column("text"), keys, np.arange(len(keys))))
                pairs = np.stack([votes.column, votes.value], axis=1).astype("<u4")
                cuts = np.searchsorted(votes.row, np.arange(1, len(piece)))
                fired = pa.array([some.tobytes() for some in np.split(pairs, cuts)], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), fired], names=["doc_id", "label", "votes"])

    rows = sample.mapInArrow(run, "doc_id long, label int, votes binary").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    target = (rows["label"].to_numpy()[order] > 0).astype(float)
    blobs = rows["votes"].take(pa.array(order)).to_pylist()
    pairs = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2).astype(np.int64)
    row = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
    mined = pairs[:, 0] < len(keys)
    voter = together(row[mined], pairs[mined, 0], len(keys))
    voters = int(voter.max()) + 1 if len(voter) else 0
    width = voters + len(STYLE)
    named = [names[k] for k in keys]
    if not 0 < target.sum() < len(target):
        mean = (target.sum() + 1) / (len(target) + 2)
        return ToxicityModel(keys, named, voter, np.append(np.zeros(width), np.log(mean / (1 - mean))))
    column = np.append(voter, voters + np.arange(len(STYLE)))[pairs[:, 0]]
    place, where = np.unique(row * width + column, return_inverse=True)
    fired = np.zeros(len(place))
    np.maximum.at(fired, where, pairs[:, 1])
    # A voter of n keys counts as n equal columns would: scaled by sqrt(n) it bears the ridge of one.
    scale = np.sqrt(np.append(np.bincount(voter, minlength=voters), np.ones(len(STYLE))))
    row, column, shape = place // width, place % width, (len(target), width)
    posterior = label_model(Sparse(row, column, scale[column], shape), target)
    weights = linear_classifier(Sparse(row, column, np.log1p(fired) * scale[column], shape), posterior)
    weights[:-1] *= scale
    return ToxicityModel(keys, named, voter, weights)


def score(docs: DataFrame, model: ToxicityModel, modulus: int = 5, remainder: int = 0, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (score >= threshold).

    A null or empty text fires no voter and gets the score of the intercept alone. Rows are judged one by one, so repeated
    rows and ids give repeated results; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                columns = [piece.column("doc_id"), piece.column("held_out"), pa.array(model.score(piece.column("text")))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score"])

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out("doc_id", modulus, remainder).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    scored = texts.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
