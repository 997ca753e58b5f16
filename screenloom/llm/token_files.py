"""Token-id files in patched frame-of-reference blocks.

A shard file holds the ids of consecutive documents (ascending doc_id), cut into blocks of 1,024 ids. A block keeps its
minimum, the width in bits that a chosen percentile of the differences needs, the differences packed at that width (high
bits of the outliers cut off), and an exception list with the places and high bits of the outliers. A shard file is:

    header   magic "PFR1", then u32 block size, u64 ids, u64 blocks, u64 documents
    index    u64 per block: byte offset of the block after the index and the table, and one more for the end
    table    i64 doc_id (least value: null), u64 first id of the document in the shard
    blocks   u32 minimum, u8 width, u8 0, u16 exceptions, packed words, u16 places, u32 high bits

All numbers are little-endian. Shards are ranges of doc_id; each is written to a name of its own and then moved into
place, so a task that runs twice leaves the same file. They are read back with Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenloom.llm.scan import pieces
from screenloom.session import new_path, stage

MAGIC = b"PFR1"
BLOCK = 1024
NO_ID = -(1 << 63)
SHARD_ROWS = 2048  # documents in a shard, about


# ---- one block, one shard ---------------------------------------------------------------------------------------


def pack_block(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """At most 65,535 ids below 2^32 as one block."""
    least = ids.min()
    rest = (ids - least).astype(np.uint32)
    top = int(np.percentile(rest, percentile, method="higher"))
    width = top.bit_length()
    outliers = np.flatnonzero(rest >> width) if width < 32 else np.zeros(0, np.int64)
    bits = (rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    head = np.array([least], "<u4").tobytes() + bytes([width, 0]) + np.array([len(outliers)], "<u2").tobytes()
    high = (rest[outliers] >> width).astype("<u4") if len(outliers) else np.zeros(0, "<u4")
    return head + packed + outliers.astype("<u2").tobytes() + high.tobytes()


def unpack_block(data: bytes, count: int) -> np.ndarray:
    least, width = int.from_bytes(data[:4], "little"), data[4]
    outliers = int.from_bytes(data[6:8], "little")
    size = (count * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, 8), bitorder="little")[: count * width]
    rest = (bits.reshape(count, width).astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    places = np.frombuffer(data, "<u2", outliers, 8 + size)
    high = np.frombuffer(data, "<u4", outliers, 8 + size + 2 * outliers)
    rest[places] |= high << np.uint32(width)
    return rest + np.uint32(least)


def _pack_full(rows: np.ndarray, percentile: float) -> list[bytes]:
    """``pack_block`` for many full blocks at once, grouped by width."""
    least = rows.min(axis=1)
    rest = (rows - least[:, None]).astype(np.uint32)
    place = int(np.ceil(percentile / 100 * (BLOCK - 1)))
    top = np.partition(rest, place, axis=1)[:, place]
    widths = np.ceil(np.log2(top.astype(np.float64) + 1)).astype(int)
    result: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        kind, room = ("<u2", 16) if width <= 16 else ("<u4", 32)
        group = np.flatnonzero(widths == width)
        for some in np.array_split(group, -(-len(group) // 256)):
            low = (rest[some] & np.uint32((1 << width) - 1)).astype(kind)
            bits = np.unpackbits(low.view(np.uint8), axis=1, bitorder="little").reshape(len(some), BLOCK, room)
            packed = np.packbits(bits[:, :, :width].reshape(len(some), -1), axis=1, bitorder="little")
            above = rest[some] >> width if width < 32 else np.zeros_like(rest[some])
            row, column = np.nonzero(above)
            high, cuts = above[row, column].astype("<u4"), np.searchsorted(row, np.arange(len(some) + 1)).tolist()
            column = column.astype("<u2")
            for k, b in enumerate(some.tolist()):
                i, j = cuts[k], cuts[k + 1]
                head = int(least[b]).to_bytes(4, "little") + bytes([width, 0]) + (j - i).to_bytes(2, "little")
                result[b] = head + packed[k].tobytes() + column[i:j].tobytes() + high[i:j].tobytes()
    return result


def pack_shard(doc_ids: np.ndarray, firsts: np.ndarray, ids: np.ndarray, percentile: float = 90.0) -> bytes:
    full = len(ids) // BLOCK * BLOCK
    blocks = _pack_full(ids[:full].reshape(-1, BLOCK), percentile) if full else []
    if full < len(ids):
        blocks.append(pack_block(ids[full:], percentile))
    index = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    table = np.stack([doc_ids.astype("<i8").view("<u8"), firsts.astype("<u8")], axis=1)
    head = MAGIC + np.array([BLOCK], "<u4").tobytes()
    head += np.array([len(ids), len(blocks), len(doc_ids)], "<u8").tobytes()
    return b"".join([head, index.tobytes(), table.tobytes(), *blocks])


def unpack_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, first id of each document, and all ids of a shard file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    size = int(np.frombuffer(data, "<u4", 1, 4)[0])
    n_ids, n_blocks, n_docs = np.frombuffer(data, "<u8", 3, 8).astype(np.int64).tolist()
    index = np.frombuffer(data, "<u8", n_blocks + 1, 32).astype(np.int64)
    table = np.frombuffer(data, "<u8", 2 * n_docs, 32 + index.nbytes).reshape(n_docs, 2)
    base = 32 + index.nbytes + table.nbytes
    ids = np.empty(n_ids, np.uint32)
    at = index[:-1] + base
    raw = np.frombuffer(data, np.uint8)
    full = n_ids // size
    widths = raw[at[:full] + 4]
    for width in np.unique(widths).tolist():
        kind, room = ("<u2", 16) if width <= 16 else ("<u4", 32)
        group = np.flatnonzero(widths == width)
        for some in np.array_split(group, -(-len(group) // 256)):
            packed = raw[(at[some] + 8)[:, None] + np.arange(size * width // 8)]
            bits = np.zeros((len(some), size, room), np.uint8)
            bits[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(some), size, width)
            low = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little").view(kind).astype(np.uint32)
            for k, b in enumerate(some.tolist()):
                here = int(at[b])
                outliers = int.from_bytes(data[here + 6 : here + 8], "little")
                if outliers:
                    ends = here + 8 + size * width // 8
                    places = np.frombuffer(data, "<u2", outliers, ends)
                    low[k, places] |= np.frombuffer(data, "<u4", outliers, ends + 2 * outliers) << np.uint32(width)
                low[k] += np.uint32(int.from_bytes(data[here : here + 4], "little"))
                ids[b * size : (b + 1) * size] = low[k]
    for b in range(full, n_blocks):
        ids[b * size :] = unpack_block(data[at[b] : base + index[b + 1]], n_ids - b * size)
    return table[:, 0].view("<i8"), table[:, 1].astype(np.int64), ids


# ---- encoding ---------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# The kind of tokenizer whose words of Latin-1 letters may go to its merge table without the steps before it: composing
# and lower-casing leave nothing to do, such a word is one piece, and its bytes map to characters one by one.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ffA-Z\u00c0-\u00d6\u00d8-\u00de"
_MARKS = """!"#$%&()*+,-./:;=?@[\\]^_`{|}~"""  # a run of them behind a word is one piece of its own; no quotes or <, >
_PLAIN = f"^[{_LETTERS}]+[{re.escape(_MARKS)}]*$"
_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])


class _Words:
    """Ids of many texts at once, word by word (words end at blanks), each different word once.

    Exact for tokenizers that drop white space and split at it, as checked by ``splits_at_blanks``: no token,
    normalisation or merge then reaches across a blank.
    """

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.limit, self.known = _tokenizer(path), limit, {}
        shape = json.loads(self.tokenizer.to_str())
        steps = [
            [s["type"] for s in ((shape.get(kind) or {}).get(f"{kind.replace('_', '')}s") or [])]
            for kind in ("normalizer", "pre_tokenizer")
        ]
        self.direct = steps == list(_STEPS) and "[\\p{L}]+|" in json.dumps(shape["pre_tokenizer"]["pretokenizers"][0]).replace("\\\\", "\\")
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def _full(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known = {}
        known, tokenize, table = self.known, self.model.tokenize, self.bytes
        for s in stems:
            if s not in known:
                ids = tokenize(s if s.isascii() else s.translate(table))
                known[s] = struct.pack(f"<{len(ids)}I", *[t.id for t in ids])
        return [known[s] for s in stems]

    def _different(self, words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """For each word the numbers of its two parts (a word and the marks behind it, or all and nothing), and the ids
        of all parts."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False) if self.direct else np.zeros(len(words), bool)
        parts = np.zeros((len(words), 2), np.int32)  # part 0 is nothing
        rest = np.flatnonzero(~plain)
        ids = [b"", *self._full(words.take(pa.array(rest)).to_pylist())]
        parts[rest, 0] = np.arange(1, len(ids))
        some = words.filter(pa.array(plain))
        if len(some):
            stems = pc.utf8_lower(pc.utf8_rtrim(some, _MARKS)).dictionary_encode()
            marks = pc.replace_substring_regex(some, f"^[{_LETTERS}]+", "").dictionary_encode()
            parts[plain, 0] = stems.indices.to_numpy() + len(ids)
            ids += self._stems(stems.dictionary.to_pylist())
            parts[plain, 1] = marks.indices.to_numpy() + len(ids)
            ids += self._full(marks.dictionary.to_pylist())
        return parts, ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        plain = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.direct:
            plain = pc.replace_substring(plain, "\n", " ")  # as the tokenizer does with all white space
        words = pc.split_pattern(plain, " ")
        coded = words.flatten().dictionary_encode()
        parts, pieces_of = self._different(coded.dictionary)
        flat = np.frombuffer(b"".join(pieces_of), "<u4")
        size = np.fromiter(map(len, pieces_of), np.int64, len(pieces_of)) // 4
        place = parts[coded.indices.to_numpy()].ravel()
        many = size[place]
        ends = np.cumsum(many)
        first = (np.cumsum(size) - size)[place] - (ends - many)
        at = np.arange(int(ends[-1]))
        at += np.repeat(first, many)
        ids = flat[at]
        last = words.offsets.to_numpy()
        return np.split(ids, ends[2 * (last[1:-1] - last[0]) - 1])


def splits_at_blanks(path: str) -> bool:
    """Whether a blank always ends a token and leaves none itself."""
    tokenizer = _tokenizer(path)
    probes = ["a b", "don 't", "x  \n y", "1 2", "a .b", ". .", "l ' s", "é ́ e", "<|endoftext|> a", "ß ﬁ Ⅷ", "a  b"]
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    return not encode(" ") and all(encode(p) == [i for w in p.split(" ") for i in encode(w)] for p in probes)


def _encoder(path: str, end_id: int, cuts: list[int]):
    """Rows (doc_id, shard, small, ids); ids below 2^16 take two bytes each on their way to the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(path) if splits_at_blanks(path) else None
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                texts = piece.column("text")
                if words is not None:
                    ids = words.encode(texts)
                else:
                    plain = pc.fill_null(texts, "").to_pylist()
                    ids = [np.array(e.ids, np.uint32) for e in _tokenizer(path).encode_batch(plain, add_special_tokens=False)]
                ends = np.array([end_id], np.uint32)
                keys = pc.fill_null(piece.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)
                full = [np.concatenate([i, ends]) for i in ids]
                small = [f.astype("<u2") if f.max() < 1 << 16 else f.astype("<u4") for f in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(np.searchsorted(cuts, keys, side="right"), pa.int32()),
                        pa.array([s.itemsize == 2 for s in small]),
                        pa.array([s.tobytes() for s in small], pa.binary()),
                    ],
                    names=["doc_id", "shard", "small", "ids"],
                )

    return run


# ---- writing and reading ----------------------------------------------------------------------------------------


def _bounds(ids: DataFrame, shard_rows: int) -> list[int]:
    """Ascending doc_ids that cut the table into shards of about ``shard_rows`` rows; as many as shards at most."""
    rows = ids.count()
    shards = max(1, -(-rows // shard_rows))
    if shards == 1:
        return []
    cuts = ids.select(F.expr(f"approx_percentile(doc_id, array({', '.join(f'{k / shards}D' for k in range(1, shards))}), {20 * shards})"))
    return sorted(set(cuts.first()[0] or []))


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    percentile: float = 90.0,
    shard_rows: int = SHARD_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode ``docs`` and write them to ``folder`` as shard files; returns rows (shard, n_ids, start), written once.

    Nothing but ids is shuffled, once. ``shard_rows`` sets the size of a file, and so the number of shards, whose bounds and
    starts (8 bytes each) every task gets: raise it with the table.

    Documents stand in ascending doc_id, a null id first; rows that share an id follow each other in the order of
    their ids' bytes. A null text is empty: its end id stands alone. An empty table writes no file.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    cuts = _bounds(texts.select("doc_id"), shard_rows)
    dealt = texts.mapInArrow(_encoder(tokenizer, end_id, cuts), "doc_id long, shard int, small boolean, ids binary")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import pyarrow.fs as pafs

        rows = group.sort_values(["doc_id", "ids"], na_position="first", kind="stable")
        parts = [np.frombuffer(b, "<u2" if s else "<u4") for b, s in zip(rows["ids"], rows["small"], strict=True)]
        ids = np.concatenate(parts).astype(np.uint32)
        firsts = np.cumsum([0, *map(len, parts)])[:-1]
        number = int(rows["shard"].iloc[0])
        keys = np.array([NO_ID if v is None or v != v else int(v) for v in rows["doc_id"].tolist()], np.int64)
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/shard-{number:08d}.pfr"
        with store.open_output_stream(draft := f"{name}.{uuid.uuid4().hex}.part") as out:
            out.write(pack_shard(keys, firsts, ids, percentile))
        store.move(draft, name)
        return pd.DataFrame({"shard": [number], "n_ids": [len(ids)]})

    counts = stage(dealt.groupBy("shard").applyInPandas(run, "shard int, n_ids long"), "shards")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("start", F.coalesce(before, F.lit(0)))


def read_shards(spark, folder: str, starts: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, ids) from the shard files; ids is little-endian unsigned 32-bit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(folder)
    number = F.regexp_extract("path", r"shard-(\d+)\.pfr$", 1).cast("int")
    named = files.select(number.alias("shard"), "content").join(F.broadcast(starts.select("shard", "start")), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column("content"), batch.column("start"), strict=True):
                keys, firsts, ids = unpack_shard(content.as_py())
                raw = [i.astype("<u4").tobytes() for i in np.split(ids, firsts[1:])] if len(firsts) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, mask=keys == NO_ID),
                        pa.array(firsts + start.as_py()),
                        pa.array([len(r) // 4 for r in raw], pa.int64()),
                        pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                        pa.array(raw, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return named.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` below the shared folder and read them back: rows (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    folder = _as_uri(spark, new_path(spark, "tokens"))
    starts = write_shards(docs, folder, tokenizer, end_id)
    if starts.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, starts).drop("ids")


def _as_uri(spark: SparkSession, path: str) -> str:
    """``path`` with the file system that Spark itself resolves it on, so that all executors write to the same one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole
