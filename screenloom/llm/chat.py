r"""Chat formatting into windows of a token budget.

A turn is written as ``### role: text``, a line break and ``</turn>``. Inside a text each ``### `` and ``</turn>`` gets one
backslash before it, which reading takes away again, so no text can end a turn or begin one; roles are percent-encoded. Every
turn ends with a line break at which byte-pair tokenizers split, so the tokens of a window are the sum of those of its turns.

Prefix sums of turn tokens choose the windows: each takes as many new turns as the budget allows, whole ones only, after the
conversation's system turn and a limited number of tokens of the turns just before. The loss mask covers the assistant texts
among the new turns alone: repeated ones were targets of an earlier window.

Windows also end wherever the prefix sum passes a multiple of ``block`` tokens. So the windows of a block follow from its own
turns, a few before it and the system turn. Conversations of ordinary size are formatted in one task each. Longer ones are
dealt out by ranges of turns, their prefix sums put together from a sum per range, and formatted block by block: no
conversation meets in one task, and both ways give the same windows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom.llm.scan import pieces
from screenloom.operators.positions import same_keys_join
from screenloom.session import stage

BUDGET = 2048  # tokens of a window
HISTORY = 512  # tokens of turns repeated before the new ones, at most
BLOCK = 1 << 16  # tokens between forced ends of windows
LONG = 1 << 20  # bytes of text beyond which a conversation is formatted block by block
WINDOW = "first_turn long, n_turns long, n_tokens long, text string, fresh_from long, loss array<struct<start: long, end: long>>"
_END = "\n</turn>\n"
_CONTROL = re.compile(r"(### |</turn>)")
_ESCAPED = re.compile(r"\\(### |</turn>)")
_OUT = 1 << 22  # characters of windows handed on at once

Counter = Callable[[list[str]], Sequence[int]]


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text begins and ends."""
    head = f"### {quote(role, safe='')}: "
    body = escape(text)
    return head + body + _END, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted text."""
    turns = []
    for part in formatted.split(_END)[:-1]:
        role, _, body = part[4:].partition(": ")
        turns.append((unquote(role), unescape(body)))
    return turns


@functools.lru_cache(maxsize=2)
def _ranked(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class RankedTokens:
    """Counts the tokens of texts with a file of ranked byte pairs, which every executor must have at ``path``."""

    path: str
    pattern: str

    def __call__(self, texts: list[str]) -> list[int]:
        encode = _ranked(self.path, self.pattern).encode_ordinary
        return [len(encode(text)) for text in texts]


# ---- windows ----------------------------------------------------------------------------------------------------


@dataclass
class Turns:
    """Turns in a row of one conversation. ``begin`` are prefix sums of ``tokens`` over the whole conversation, ``index`` the
    place of the first turn in it; turns before ``own`` only serve as history."""

    begin: list[int]
    tokens: list[int]
    texts: list[tuple[str, int, int]]
    roles: list[str]
    index: int
    own: int

    def window(self, system: tuple[str, int] | None, back: int, first: int, end: int) -> tuple:
        """A row of the result: the system turn, turns from ``back`` as history, new ones from ``first`` to before ``end``."""
        head = system[0] if system else ""
        head += "".join(self.texts[k][0] for k in range(back, first))
        at, loss, parts = len(head), [], [head]
        for k in range(first, end):
            whole, a, b = self.texts[k]
            if self.roles[k] == "assistant" and b > a:
                loss.append({"start": at + a, "end": at + b})
            parts.append(whole)
            at += len(whole)
        total = self.begin[end - 1] + self.tokens[end - 1] - self.begin[back] + (system[1] if system else 0)
        return self.index + first, end - first, total, "".join(parts), len(head), loss


def spans(turns: Turns, given: tuple[str, int] | None, budget: int, history: int, block: int) -> Iterator[tuple]:
    """Windows of the new turns. ``given`` is the text and the tokens of a system turn that stands before all of ``turns``;
    without it their first system turn of at most half the budget counts."""
    begin, tokens, n = turns.begin, turns.tokens, len(turns.begin)
    ends = [b + t for b, t in zip(begin, tokens, strict=True)]
    found = None if given else next((k for k in range(n) if turns.roles[k] == "system" and 2 * tokens[k] <= budget), None)
    first = turns.own
    while first < n:
        system, back = given, bisect.bisect_left(begin, begin[first] - history)
        if found is not None and found < first:
            system, back = (turns.texts[found][0], tokens[found]), max(back, found + 1)
        kept = system[1] if system else 0
        if kept + tokens[first] > budget:
            system, kept, back = None, 0, first
        while ends[first] - begin[back] + kept > budget and back < first:
            back += 1
        border = bisect.bisect_left(begin, (begin[first] // block + 1) * block)
        end = min(border, max(first + 1, bisect.bisect_right(ends, budget - kept + begin[back])))
        yield turns.window(system, back, first, end)
        first = end


def _flush(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "first_turn", "n_turns", "n_tokens", "text", "fresh_from", "loss"]
    ids, *columns = (list(c) for c in zip(*rows, strict=True))
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pair]
    arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids), *arrays], names=names)


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for runs of rows, as Python tuples, that share the first ``keys`` columns."""
    rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns), strict=True) for batch in batches)
    for key, group in itertools.groupby(rows, key=lambda row: row[:keys]):
        yield key, [row[keys:] for row in group]


def _format(batches: Iterator[pa.RecordBatch], turns_of: Callable, limits: tuple[int, int, int], keys: int, kind: pa.DataType):
    """Windows of each group of rows; ``turns_of`` makes (turns, system turn) of the rows of one."""
    done, size = [], 0
    for key, rows in _by_group(batches, keys):
        turns, given = turns_of(rows)
        for row in spans(turns, given, *limits):
            done.append((key[0], *row))
            size += len(row[3])
            if size > _OUT:
                yield _typed(_flush(done), kind)
                done, size = [], 0
    if done:
        yield _typed(_flush(done), kind)


def _typed(batch: pa.RecordBatch, kind: pa.DataType) -> pa.RecordBatch:
    return batch.set_column(0, "conv_id", batch.column("conv_id").cast(kind))


# ---- on Spark ---------------------------------------------------------------------------------------------------


def _short(rows: DataFrame, order: list[str], count: Counter, limits: tuple[int, int, int], schema: str) -> DataFrame:
    """Conversations of ordinary size: one shuffle brings the turns of each together."""

    def turns_of(some: list[tuple]) -> tuple[Turns, None]:
        texts = [write_turn(role, text) for _, role, text in some]
        tokens = list(count([t[0] for t in texts]))
        begin = list(itertools.accumulate(tokens, initial=0))[:-1]
        return Turns(begin, tokens, texts, [role for _, role, _ in some], 0, 0), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _format(itertools.chain([first], batches), turns_of, limits, 1, first.schema.field(0).type)

    sorted_rows = rows.select(*order).repartition("conv_id").sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(run, schema)


def _measured(rows: DataFrame, order: list[str], count: Counter) -> DataFrame:
    """Long conversations dealt out by ranges of turns: with ``tokens``, ``begin`` (tokens before) and ``index`` (turns before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, place = object(), 0, 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, roles, texts = (piece.column(c).to_pylist() for c in ("conv_id", "role", "text"))
                tokens = list(count([write_turn(r, t)[0] for r, t in zip(roles, texts, strict=True)]))
                begins, places = [], []
                for own, size in zip(ids, tokens, strict=True):
                    if own != last:
                        last, at, place = own, 0, 0
                    begins.append(at)
                    places.append(place)
                    at, place = at + size, place + 1
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *(pa.array(c, pa.int64()) for c in (tokens, begins, places))],
                    names=[*piece.schema.names, "tokens", "at", "place"],
                )

    near = F.substring("text", 1, 64)  # in the order of the whole text
    dealt = rows.repartitionByRange("conv_id", "turn", "role", near).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    staged = stage(dealt.mapInArrow(run, f"{fields}, tokens long, at long, place long"), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged.groupBy("conv_id", "part").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("turns"))
    bases = sums.select(
        "conv_id", "part", F.sum("tokens").over(before).alias("base"), F.sum("turns").over(before).alias("earlier")
    ).where("earlier > 0")
    # Of a range only the first conversation can have begun in an earlier one, so there is one row a range at most.
    placed = same_keys_join(staged, F.broadcast(bases), ["conv_id", "part"], "left")
    begin = (F.col("at") + F.coalesce("base", F.lit(0))).alias("begin")
    index = (F.col("place") + F.coalesce("earlier", F.lit(0))).alias("index")
    return placed.select("conv_id", "role", "text", "tokens", begin, index)


def _long(rows: DataFrame, order: list[str], count: Counter, limits: tuple[int, int, int], schema: str) -> DataFrame:
    """Long conversations block by block."""
    budget, history, block = limits
    turns = _measured(rows, order, count).withColumn("block", F.floor(F.col("begin") / block))
    own = turns.select("conv_id", "block", F.lit(2).alias("kind"), "index", "begin", "tokens", "role", "text")
    reach = F.floor((F.col("begin") + history) / block)
    past = own.withColumn("kind", F.lit(1)).withColumn("block", reach).where(F.floor(F.col("begin") / block) < F.col("block"))
    leading = own.where((F.col("role") == "system") & (2 * F.col("tokens") <= budget))
    least = leading.groupBy("conv_id").agg(F.min("index").alias("index"))
    last = turns.groupBy("conv_id").agg(F.max("block").alias("last"))
    system = same_keys_join(same_keys_join(leading, least, ["conv_id", "index"]), last, ["conv_id"]).where("last > block")
    system = system.withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("last")))).withColumn("kind", F.lit(0)).drop("last")

    def turns_of(some: list[tuple]) -> tuple[Turns, tuple[str, int] | None]:
        lead = some[0] if some[0][0] == 0 else None
        given = (write_turn(*lead[4:])[0], lead[3]) if lead else None
        some = [row for row in some if not lead or row[1] > lead[1]]
        texts = [write_turn(role, text) for *_, role, text in some]
        before = sum(row[0] == 1 for row in some)
        begin, tokens, roles = ([row[k] for row in some] for k in (2, 3, 4))
        return Turns(begin, tokens, texts, roles, some[0][1] if some else 0, before), given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _format(itertools.chain([first], batches), turns_of, limits, 2, first.schema.field(0).type)

    blocks = own.unionByName(past).unionByName(system).repartition("conv_id", "block")
    return blocks.sortWithinPartitions("conv_id", "block", "kind", "index").mapInArrow(run, schema)


def format_windows(
    turns: DataFrame,
    count: Counter,
    budget: int = BUDGET,
    history: int = HISTORY,
    block: int = BLOCK,
    long: int = LONG,
    conv_id: str | Column = "conv_id",
) -> DataFrame:
    """Windows of each conversation: conv_id, first_turn (place of the first new turn, from 0), n_turns (new ones), n_tokens,
    text, fresh_from (where the new turns begin) and loss (spans of the texts to learn); places are code points.

    Turns are ordered by turn, role and text, nulls first; repeated rows are turns of their own. Null texts and roles are empty;
    rows with a null conv_id form one conversation. A window exceeds ``budget`` only if it is a single longer turn, which then
    stands alone; the system turn is the first of at most half the budget and, like any history, gives way to a new turn that
    would not fit beside it. ``history`` must be less than ``block``. An empty table gives an empty result; other columns are
    ignored.
    """
    if not 0 <= history < block:
        raise ValueError("history must be less than a block")
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "role"))
    key = (F.col(conv_id) if isinstance(conv_id, str) else conv_id).alias("conv_id")
    rows = turns.select(key, F.col("turn").cast("long").alias("turn"), role, text)
    sizes = rows.groupBy("conv_id").agg(F.sum(F.octet_length("text") + 16).alias("bytes"))
    longer = stage(sizes.where(F.col("bytes") > long).select("conv_id", F.lit(True).alias("longer")), "long")
    marked = same_keys_join(rows, longer, ["conv_id"], "left")
    order, limits = ["conv_id", "turn", "role", "text"], (budget, history, block)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {WINDOW}"
    short = _short(marked.where("longer is null").drop("longer"), order, count, limits, schema)
    if longer.isEmpty():
        return short
    return short.union(_long(marked.where("longer").drop("longer"), order, count, limits, schema))


# ---- reading back -----------------------------------------------------------------------------------------------


def read_back(windows: DataFrame) -> DataFrame:
    """What each window adds to its conversation: conv_id, first_turn, turns (role, line break, text, line break for each new
    one), n_turns, loss (all text under the mask), loss_chars, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                turns, loss = [], []
                rows = zip(*(piece.column(c).to_pylist() for c in ("text", "fresh_from", "loss")), strict=True)
                for text, fresh, spans_ in rows:
                    turns.append(read_turns(text[fresh:]))
                    loss.append("".join(unescape(text[s["start"] : s["end"]]) for s in spans_))
                joined = ["".join(f"{role}\n{text}\n" for role, text in some) for some in turns]
                counts = [list(map(len, c)) for c in (turns, loss, piece.column("text").to_pylist())]
                columns = [piece.column("conv_id"), piece.column("first_turn"), pa.array(joined, pa.string()), pa.array(loss, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(c, pa.int64()) for c in counts)],
                    names=["conv_id", "first_turn", "turns", "loss", "n_turns", "loss_chars", "formatted_chars"],
                )

    kind = windows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, first_turn long, turns string, loss string, n_turns long, loss_chars long, formatted_chars long"
    return windows.mapInArrow(run, schema)


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation of ``read_back``: sums of its counts, and sha256 of all turns and of all text under the mask.

    A digest needs its text in order, so a conversation passes one task; it streams through and is never held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kind = None
        ids, rows = [], []
        for batch in batches:
            kind = batch.schema.field(0).type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turns", "loss", "n_turns", "loss_chars", "formatted_chars")]
            for own, turns, loss, n, chars, formatted in zip(*columns, strict=True):
                if not ids or ids[-1] != own:
                    ids.append(own)
                    rows.append([0, hashlib.sha256(), 0, hashlib.sha256(), 0])
                row = rows[-1]
                row[0], row[2], row[4] = row[0] + n, row[2] + chars, row[4] + formatted
                row[1].update(turns.encode())
                row[3].update(loss.encode())
            if len(ids) > 1:
                yield out(ids[:-1], rows[:-1], kind, names)
                ids, rows = ids[-1:], rows[-1:]
        if ids:
            yield out(ids, rows, kind, names)

    def out(ids: list, rows: list[list], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        plain = [[x.hexdigest() if k in (1, 3) else x for k, x in enumerate(row)] for row in rows]
        columns = [pa.array(c) for c in zip(*plain, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], names=names)

    kind = parts.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn").mapInArrow(run, schema)
