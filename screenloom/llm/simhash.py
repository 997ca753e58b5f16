"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is a 64-bit majority vote over the XXH64 values of a text's word shingles. Fingerprints are cut into a
ring of four 16-bit segments. When two of them differ in at most ``distance`` bits, some segment starts a chain whose
first 1, 2, 3, ... segments differ in at most 1/4, 2/4, 3/4, ... of that distance. For a distance of 3 the first segment
of the chain is equal, the first two differ in at most 1 bit, the first three in at most 2: pairs meet on the first
segment and the chain prunes them before the full Hamming check.

A group that shares a segment and grows beyond ``group_rows`` is dealt out again by the chain itself: each fingerprint
is sent to all second segments its budget allows (17 of them), then to all third ones. A group of the third level shares
48 bits up to the budget and holds at most 2^16 fingerprints, whatever the size of the corpus. Each group returns a
spanning forest of its links, so a group never emits pairs; equal fingerprints are one vertex.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenloom.llm.components import components
from screenloom.llm.scan import pieces, text_bytes
from screenloom.session import stage

SEGMENTS, WIDTH = 4, 16
PAIR_ROWS = 64  # groups up to this size are joined row by row, larger ones settled by a spanning forest
GROUP_ROWS = 2048  # groups beyond this size are dealt out again by their next segment
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash of one text (UTF-8): A-Z lower-cased, words joined by one space, a bit set in over half the hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) > size:
        spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    else:
        spans = [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in spans], dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a long text votes in parts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with a column ``_fingerprint`` (the 64 bits as a signed long). A null or blank text gets zero."""
    kept = [c for c in docs.columns if c != "_fingerprint"]
    source = docs.select(*kept, F.col(text).cast("string").alias("_simhash_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_simhash_text"):
                data, at = text_bytes(piece.column("_simhash_text"))
                bits = [fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                signed = pa.array(np.array(bits, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + [signed], names=[*kept, "_fingerprint"])

    fields = docs.select(*kept).schema.add("_fingerprint", "long")
    return source.mapInArrow(run, fields)


def _turned(bits: np.ndarray, start: int) -> np.ndarray:
    """The ring turned so that segment ``start`` fills the highest bits."""
    turn = np.uint64(start * WIDTH)
    return (bits << turn) | (bits >> (np.uint64(64) - turn)) if start else bits


def _forest(bits: np.ndarray, own: np.ndarray, start: int, distance: int) -> list[tuple[int, int]]:
    """Edges that connect whatever is linked in a group. Rows that stand at their own key meet all others; two rows
    that were both sent here meet at their own keys instead."""
    turned = _turned(bits, start)
    parent = list(range(len(bits)))
    signed = bits.view(np.int64)
    edges = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.flatnonzero(own).tolist():
        near = _chained(turned ^ turned[i], distance)
        for j in near[near != i].tolist():
            here, there = root(i), root(j)
            if here != there:
                parent[there] = here
                edges.append((int(signed[i]), int(signed[j])))
    return edges


def _chained(differ: np.ndarray, distance: int) -> np.ndarray:
    """Places whose differences keep every chain in budget; the whole ring is the full Hamming check."""
    at = np.arange(len(differ))
    for links in range(1, SEGMENTS + 1):
        fits = np.bitwise_count(differ >> np.uint64(64 - links * WIDTH)) <= distance * links // SEGMENTS
        differ, at = differ[fits], at[fits]
    return at


def _flips(limit: int) -> list[int]:
    """All 16-bit masks with at most ``limit`` bits."""
    return [sum(1 << b for b in some) for n in range(limit + 1) for some in combinations(range(WIDTH), n)]


def _segment(start: int, step: int) -> F.Column:
    """Segment ``start + step`` of the ring, from the high end, as an integer."""
    place = (start + step) % SEGMENTS
    return F.shiftrightunsigned("bits", 64 - (place + 1) * WIDTH).bitwiseAND((1 << WIDTH) - 1).cast("int")


def _first_level(vertices: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(s).alias("start"), _segment(s, 0).cast("long").alias("key")) for s in range(SEGMENTS)]
    sent = vertices.select("bits", F.explode(F.array(*rows)).alias("_k"))
    return sent.select("bits", "_k.*", F.lit(0).alias("spent"))


def _next_level(rows: DataFrame, level: int, distance: int) -> DataFrame:
    """Send each row to every value of its next segment that keeps the chain in budget.

    The row stands at its own values (mask 0) and, to be met, at its neighbours' values. Two linked rows meet at the
    values of either of them.
    """
    budget = distance * (level + 1) // SEGMENTS
    segment = F.when(F.col("start") == 0, _segment(0, level))
    for s in range(1, SEGMENTS):
        segment = segment.when(F.col("start") == s, _segment(s, level))
    masks = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(m.bit_count()).alias("cost")) for m in _flips(budget)])
    flipped = rows.withColumn("_own", segment).withColumn("_m", F.explode(masks))
    return flipped.where(F.col("spent") + F.col("_m.cost") <= budget).select(
        "bits",
        "start",
        (F.col("key") * (1 << WIDTH) + F.col("_own").bitwiseXOR(F.col("_m.mask"))).alias("key"),
        (F.col("spent") + F.col("_m.cost")).alias("spent"),
    )


def links(vertices: DataFrame, distance: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column bits) that connect all pairs within ``distance`` bits.

    ``distance`` must be below the number of segments, so that the first segment of a chain is equal.
    """
    if not 0 <= distance < SEGMENTS:
        raise ValueError(f"distance must lie between 0 and {SEGMENTS - 1}")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bits = group["bits"].to_numpy(dtype=np.int64).view(np.uint64)
        edges = _forest(bits, (group["spent"] == 0).to_numpy(), int(group["start"].iloc[0]), distance)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    rows, found = _first_level(vertices), []
    for level in range(1, SEGMENTS):
        sizes = rows.groupBy("start", "key").agg(F.count("*").alias("_n"), F.min("spent").alias("_least"))
        met = sizes.where("_n > 1 and _least = 0").drop("_least")
        sized = stage(rows.join(met, ["start", "key"]), "segments")
        last = level == SEGMENTS - 1
        found.append(_pairs(sized.where(F.col("_n") <= PAIR_ROWS), distance))
        middle = sized.where(F.col("_n") > PAIR_ROWS)
        middle = middle if last else middle.where(F.col("_n") <= group_rows)
        found.append(middle.select("bits", "start", "key", "spent").groupBy("start", "key").applyInPandas(run, "a long, b long"))
        large = sized.where(F.col("_n") > group_rows)
        if last or large.isEmpty():
            break
        rows = _next_level(large.drop("_n"), level, distance)
    return reduce(DataFrame.union, found)


def _pairs(rows: DataFrame, distance: int) -> DataFrame:
    """Linked pairs of small groups, by an equi-join whose condition is the chain."""
    turned = F.col("bits")
    for s in range(1, SEGMENTS):
        ring = F.shiftleft("bits", s * WIDTH).bitwiseOR(F.shiftrightunsigned("bits", 64 - s * WIDTH))
        turned = F.when(F.col("start") == s, ring).otherwise(turned)
    here = rows.select("start", "key", F.col("bits").alias("a"), turned.alias("_a")).where("spent = 0")
    there = rows.select("start", "key", F.col("bits").alias("b"), turned.alias("_b"), F.col("spent").alias("_s"))
    differ = F.col("_a").bitwiseXOR(F.col("_b"))
    met = (F.col("_s") > 0) | (F.col("a") < F.col("b"))
    for links in range(1, SEGMENTS + 1):
        met &= F.bit_count(F.shiftrightunsigned(differ, 64 - links * WIDTH)) <= distance * links // SEGMENTS
    return here.join(there, ["start", "key"]).where(met).select("a", "b")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): the least doc_id reachable over links of ``distance`` bits or fewer.

    Texts without words have fingerprint zero and link like any other. Rows that share an id keep a row each; their
    fingerprints are linked by nothing but their bits. A row without id gets a fingerprint and the component of the
    others with it (null if it stands alone). An empty table gives an empty result; other columns are ignored.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked = stage(fingerprints(ids, shingle).select("doc_id", F.col("_fingerprint").alias("bits")), "fingerprints")
    vertices = marked.groupBy("bits").agg(F.min("doc_id").alias("least"))
    parts = components(links(vertices.select("bits"), distance))
    rooted = vertices.join(parts.withColumnRenamed("vertex", "bits"), "bits", "left")
    rooted = rooted.withColumn("root", F.coalesce("component", "bits"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("bits", "root").join(least, "root").select("bits", "component_id")
    return marked.join(named, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The documents whose doc_id names their component; all columns. Rows without id stay, and of rows that repeat an
    id one stays, chosen by a hash of its columns."""
    found = near_duplicates(docs, shingle, distance)
    head, copy = "_head", "_copy"
    while {head, copy} & {c.lower() for c in docs.columns}:
        head, copy = f"_{head}", f"_{copy}"
    heads = found.where("doc_id = component_id").select(F.col("doc_id").alias(head)).distinct()
    kept = docs.where("doc_id is not null").join(heads, F.col("doc_id") == F.col(head), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    single = kept.withColumn(copy, F.row_number().over(order)).where(F.col(copy) == 1).drop(copy)
    return single.union(docs.where("doc_id is null"))
