"""Sums of arrays over all rows of a table: the step that iterative fits repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.session import stage

_FAN = 16  # arrays added up by one task of the tree
ROWS_PER_PART = 20_000
BYTES_PER_PART = 1 << 26  # of blocks

Work = Callable[[Iterator[pa.RecordBatch]], np.ndarray]


@dataclass(frozen=True)
class Held:
    """A table kept in memory for many passes, and the number of its partitions."""

    rows: DataFrame
    parts: int

    def release(self) -> None:
        self.rows.unpersist()


def held(rows: DataFrame, name: str) -> Held:
    """``rows`` written once and kept in memory, small tables in few partitions. A lost executor's part is read again from the
    table."""
    staged = stage(rows, name)
    parts, fit = staged.rdd.getNumPartitions(), max(1, -(-staged.count() // ROWS_PER_PART))
    if parts > fit:
        staged, parts = staged.coalesce(fit), fit
    return Held(staged.persist(), parts)


def packed(rows: DataFrame, name: str, arrays: Callable[[pa.RecordBatch], dict[str, np.ndarray]], columns: list[str], block: int) -> Held:
    """``rows`` as blocks of up to ``block``, written once and kept in memory. A block is one row: its ``arrays``, an array a name
    of ``columns``, as bytes, so that a pass copies buffers and no single values. Blocks are dealt out evenly, as many partitions as
    cores or a multiple of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), block):
                found = arrays(batch.slice(at, block))
                yield pa.RecordBatch.from_arrays([pa.array([found[c].tobytes()], pa.binary()) for c in columns], names=columns)

    staged = stage(rows.mapInArrow(run, ", ".join(f"{c} binary" for c in columns)), name)
    size = staged.agg(F.count("*").alias("n"), sum(F.sum(F.octet_length(c)) for c in columns).alias("bytes")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(size["n"], cores * -(-(size["bytes"] or 0) // (cores * BYTES_PER_PART))))
    return Held(staged.repartition(parts).persist(), parts)


def unpacked(batches: Iterator[pa.RecordBatch], types: dict[str, str]) -> Iterator[list[np.ndarray]]:
    """The arrays of each block, flat, to be read only; ``types`` in the order wanted."""
    for batch in batches:
        for k in range(len(batch)):
            yield [np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in types.items()]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column("sums"):
            part = np.frombuffer(value.as_py(), "<f8")
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def total(table: Held, work: Work, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of what ``work`` returns for each partition, an array of ``shape``. Each task sends one array; many are added
    up by tasks first, ``_FAN`` at a time, so the driver adds few, whatever the number of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.ascontiguousarray(work(batches), "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([value.tobytes()], pa.binary())], names=["sums"])

    parts, sums = table.parts, table.rows.mapInArrow(run, "sums binary")
    while parts > _FAN:
        parts = -(-parts // _FAN)
        sums = sums.repartition(parts).mapInArrow(_added, "sums binary")
    result = np.zeros(shape)
    for row in sums.collect():
        result += np.frombuffer(row["sums"], "<f8").reshape(shape)
    return result
