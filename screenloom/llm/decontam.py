"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts and test items are compared as words: lower-cased runs of letters and digits. The n-grams of all items are a table, and
those that stand in texts meet it by an equi-join on the n-gram. Rarity is the number of texts that hold an n-gram. Each text
chooses its seeds for itself: of the item's n-grams that it really holds, the rarest one for every stretch along which a copy of
the item could begin. So a copy is a candidate as long as one run of ``GRAM`` words outlived its edits, however common that run
is elsewhere. A seed marks the passage that the whole item would cover there; item and passage are aligned word by word (edits,
insertions and omissions cost), and the alignment's score is set against a perfect copy.

Texts are read once. A bitmap of bounded size of all item n-grams tells which texts can hold one; only their words, as
hashes, go on. Neither items nor texts pass the driver, and the plan does not grow with the benchmark. Passages that many
texts share meet one item by a join that the adaptive skew join splits; nothing else gathers rows by item or n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.scan import Words, gram_starts, owner, pieces, release, run_hashes, scan, word_hashes
from screenloom.session import stage

GRAM = 4
THRESHOLD = 0.5  # of the score of a perfect copy
FILTER_BITS = 25  # the bitmap of n-grams has 2 to this power bits, 4 MB, whatever the benchmark
BROADCAST_ROWS = 1 << 18  # leaking texts, 16 bytes each, that go to every task; more of them are joined
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
FOUND = "doc_id long, item_id long, score double, first_word long, end_word long"
_BITMAP = 1 << 15  # bits of one bitmap of Spark's
_BREAKS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))


def _words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    w = scan(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), _BREAKS)
    return w, word_hashes(w)


def _grams(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return run_hashes(hashes, at, at + size).view(np.int64)


def slack(size: int | Column) -> int | Column:
    """Words by which edits may move a passage."""
    return F.floor(size / 4).cast("int") + 2 if isinstance(size, Column) else size // 4 + 2


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman score of two word sequences, and the stretch of ``text`` the best alignment covers.

    One row per item word. Gaps along the text are resolved with a running maximum, as their cost is linear.
    """
    n = len(text)
    steps = GAP * np.arange(n + 1)
    above, above_from = np.zeros(n + 1), np.arange(n + 1)
    best, best_at = 0.0, (0, 0)
    for word in item:
        step = np.where(text == word, MATCH, MISMATCH)
        down, diagonal = above + GAP, np.concatenate([[0.0], above[:-1] + step])
        here = np.maximum(np.maximum(down, diagonal), 0.0)
        origin = np.where(diagonal >= down, np.concatenate([[0], above_from[:-1]]), above_from)
        origin = np.where(here > 0, origin, np.arange(n + 1))
        lifted = here - steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= top, np.arange(n + 1), 0))
        above = np.maximum(top + steps, 0.0)
        above_from = np.where(above > 0, origin[source], np.arange(n + 1))
        end = int(above.argmax())
        if above[end] > best:
            best, best_at = float(above[end]), (int(above_from[end]), end)
    return best, *best_at


# ---- items and n-grams ------------------------------------------------------------------------------------------


def _items(benchmark: DataFrame) -> DataFrame:
    """Rows (item, item_id, size, words); ``item`` tells rows apart that share an id. Items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                w, hashes = _words(piece.column("text"))
                words = [part.tobytes() for part in np.split(hashes, w.first[1:-1])] if len(piece) else []
                columns = [piece.column("item_id"), pa.array(np.diff(w.first).astype(np.int32)), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "size", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = rows.where("text is not null").mapInArrow(run, "item_id long, size int, words binary").where("size > 0")
    return stage(found.select(F.monotonically_increasing_id().alias("item"), "*"), "items")


def _item_grams(items: DataFrame, gram: int) -> DataFrame:
    """Rows (key, item, place, size): every n-gram of an item; an item of fewer words is one n-gram of its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, size, words in zip(*(batch.column(c) for c in ("item", "size", "words")), strict=True):
                own = np.frombuffer(words.as_py(), np.uint64)
                at = np.arange(len(own) - min(gram, len(own)) + 1)
                repeated = [pa.array(np.full(len(at), v.as_py(), t)) for v, t in ((item, np.int64), (size, np.int32))]
                columns = [pa.array(_grams(own, at, min(gram, len(own)))), repeated[0], pa.array(at.astype(np.int32)), repeated[1]]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "item", "place", "size"])

    return stage(items.mapInArrow(run, "key long, item long, place int, size int"), "grams")


def _positions(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << bits) - 1
    return keys & mask, (keys >> 32) & mask


def bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits, two of them set for each key. Tasks build them; the driver puts them in a row, 4 MB at 25 bits."""
    mask = F.lit((1 << bits) - 1)
    both = F.array(F.col("key").bitwiseAND(mask), F.shiftright("key", 32).bitwiseAND(mask))
    placed = grams.select(F.explode(both).alias("p")).select(F.expr(f"p div {_BITMAP}").alias("part"), (F.col("p") % _BITMAP).alias("bit"))
    whole = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for row in placed.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        begin = row["part"] * (_BITMAP // 8)
        part = np.frombuffer(row["bits"], np.uint8)[: len(whole) - begin]
        whole[begin : begin + len(part)] = part
    return whole


def _held(texts: DataFrame, known: np.ndarray, bits: int, sizes: list[int]) -> DataFrame:
    """Texts that can hold an n-gram of ``sizes`` words: text (a number), doc_id, mark_a, mark_b (of its characters), words,
    and the n-grams as keys and places. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                w, hashes = _words(piece.column("text"))
                found = []
                for size in sizes:
                    at = gram_starts(w.first, size)
                    key = _grams(hashes, at, size)
                    hit = np.ones(len(key), bool)
                    for p in _positions(key, bits):
                        hit &= (known[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
                    found.append((at[hit], key[hit]))
                at, key = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
                text = owner(w.first)[at]
                order = np.argsort(text, kind="stable")
                at, key, text = at[order], key[order], text[order]
                some = np.unique(text)
                cuts = np.searchsorted(text, some)
                lists = pa.array(np.append(cuts, len(text)).astype(np.int32))
                words = [hashes[w.first[t] : w.first[t + 1]].tobytes() for t in some.tolist()]
                chosen = pa.array(some)
                columns = [piece.column(c).take(chosen) for c in ("doc_id", "mark_a", "mark_b")]
                places = pa.array((at - w.first[text]).astype(np.int32))
                columns += [pa.array(words, pa.binary()), *(pa.ListArray.from_arrays(lists, v) for v in (pa.array(key), places))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark_a", "mark_b", "words", "keys", "places"])

    schema = "doc_id long, mark_a long, mark_b long, words binary, keys array<long>, places array<int>"
    return stage(texts.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("text"), "*"), "held")


def _seeds(held: DataFrame, grams: DataFrame) -> DataFrame:
    """Rows (text, item, at, place, size): for each text and item the rarest n-gram of every stretch. A stretch is as long as
    the slack by which a passage is widened, so a copy lies within the passage of any seed of its stretch."""
    rarity = held.select("text", F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("texts"))
    known = grams.join(rarity, "key")
    hits = held.select("text", F.explode(F.arrays_zip("keys", "places")).alias("h")).select("text", F.col("h.keys").alias("key"), F.col("h.places").alias("at"))
    met = hits.join(known, "key")
    stretch = F.floor((F.col("at") - F.col("place")) / slack(F.col("size"))).alias("stretch")
    rarest = F.min(F.struct("texts", "at", "place", "size")).alias("seed")
    return met.groupBy("text", "item", stretch).agg(rarest).select("text", "item", "seed.at", "seed.place", "seed.size")


def passages(seeds: list[tuple[int, int, int]], words: int) -> list[tuple[int, int]]:
    """Word ranges of a text of ``words`` words that a copy of an item around a seed (at, place, size) can cover, merged."""
    ranges: list[list[int]] = []
    for at, place, size in sorted(seeds, key=lambda s: s[0] - s[1]):
        low = max(0, at - place - 2 * slack(size))
        high = min(words, at - place + size + 2 * slack(size))
        if ranges and low <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], high)
        else:
            ranges.append([low, high])
    return [(low, high) for low, high in ranges]


def _cut(held: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows (text, item, low, passage): the words of each passage, cut from its text in one join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = []
                for row in batch.slice(at, 64).to_pylist():
                    own, by = row["words"], {}
                    for seed in row["seeds"]:
                        by.setdefault(seed["item"], []).append((seed["at"], seed["place"], seed["size"]))
                    for item, some in by.items():
                        for low, high in passages(some, len(own) // 8):
                            rows.append((row["text"], item, low, own[8 * low : 8 * high]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["text", "item", "low", "passage"])
            release()

    lists = seeds.groupBy("text").agg(F.collect_list(F.struct("item", "at", "place", "size")).alias("seeds"))  # of one text
    cut = held.select("text", "words").join(lists, "text").mapInArrow(run, "text long, item long, low long, passage binary")
    return stage(cut, "passages")  # so that a task of the next step needs one Python worker, not two


def _scored(cut: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Rows (text, item, item_id, score, first_word, end_word) of the passages that align at or above the threshold."""
    names = ["text", "item", "item_id", "score", "first_word", "end_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, item, low, passage, item_id, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, there = np.frombuffer(words, np.uint64), np.frombuffer(passage, np.uint64)
                perfect = MATCH * len(own)
                # no alignment scores more than a match for every item word that stands in the passage
                if MATCH * np.isin(own, there).sum() < threshold * perfect:
                    continue
                score, a, b = align(own, there)
                if score >= threshold * perfect:
                    rows.append((text, item, item_id, score / perfect, low + a, low + b))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            release()

    met = cut.join(items.select("item", "item_id", "words"), "item").select("text", "item", "low", "passage", "item_id", "words")
    schema = "text long, item long, item_id long, score double, first_word long, end_word long"
    best = F.max(F.struct("score", (-F.col("first_word")).alias("back"), "end_word", "item_id")).alias("best")
    return met.mapInArrow(run, schema).groupBy("text", "item").agg(best).select(
        "text", "best.item_id", "best.score", (-F.col("best.back")).alias("first_word"), "best.end_word"
    )


# ---- on Spark ---------------------------------------------------------------------------------------------------


def _marks(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("mark_a"), F.xxhash64(F.lit(1), text).alias("mark_b")]


def _leaks(docs: DataFrame, benchmark: DataFrame, threshold: float, gram: int, bits: int) -> DataFrame | None:
    """Rows (doc_id, mark_a, mark_b, item_id, score, first_word, end_word); None without items."""
    if not 3 <= bits <= 32:
        raise ValueError("filter_bits must lie between 3 and 32")
    items = _items(benchmark)
    grams = _item_grams(items, gram)
    sizes = sorted(r["n"] for r in items.select(F.least("size", F.lit(gram)).alias("n")).distinct().collect())  # ``gram`` at most
    if not sizes:
        return None
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_marks(text), text.alias("text"))
    held = _held(texts, bitmap(grams, bits), bits, sizes)
    found = _scored(_cut(held, _seeds(held, grams)), items, threshold)
    return found.join(held.select("text", "doc_id", "mark_a", "mark_b"), "text")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """Rows (doc_id, item_id, score, first_word, end_word): the best passage of each document for each item whose
    alignment scores ``threshold`` of a perfect copy or more; of equal ones the first.

    Null texts and items, and those without words, match nothing. Rows are judged one by one, so repeated rows and ids give
    repeated results; a row without id is reported with a null id. Empty tables give an empty result; other columns are
    ignored. ``filter_bits`` (up to 32, a byte for eight) changes what is looked up, never the result.
    """
    found = _leaks(docs, benchmark, threshold, gram, filter_bits)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    return found.select("doc_id", "item_id", "score", "first_word", "end_word")


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """The rows of ``docs`` without a leak of any item, all columns. Whether a row has one follows from its text alone, so rows
    are matched with the texts that leak by two 64-bit hashes of the text, and repeated rows stay or go together."""
    found = _leaks(docs, benchmark, threshold, gram, filter_bits)
    if found is None:
        return docs
    leaking = stage(found.select(F.col("mark_a").alias("_mark_a"), F.col("mark_b").alias("_mark_b")).distinct(), "leaking")
    if leaking.count() <= BROADCAST_ROWS:  # so few that documents need not move
        leaking = F.broadcast(leaking)
    a, b = (F.xxhash64(F.col("text").cast("string")), F.xxhash64(F.lit(1), F.col("text").cast("string")))
    return docs.join(leaking, (a == F.col("_mark_a")) & (b == F.col("_mark_b")), "left_anti")
