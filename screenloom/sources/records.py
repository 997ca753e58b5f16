"""CSV files whose quoted fields hold line breaks, read by as many tasks as their size asks for.

Spark reads such a file in one task, as a line break may or may not end a record. Here files are read as lines, in byte ranges
like any text. A line break ends a record if the quotes before it in the file are even in number. So each range counts its
quotes, a prefix sum over the ranges of a file (a row each) says whether a range begins inside quotes, and each task puts the
lines of its range together to records. Only what crosses a border is put together afterwards: at most two pieces a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PIECES = "file string, start long, seq int, place int, whole boolean, first boolean, opens boolean, text string"


_LAST = 2**31 - 1  # a record that crosses the end of a range is the last that begins in it


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range, and its pieces: ``place`` 0 for lines that go on with the record of an earlier range, 1 for lines
    of a record that goes on in a later one (``opens``). ``first`` marks the first record of a file."""
    now, lines, inside, head, fresh, seq = None, [], False, False, False, 0
    rows: list[tuple] = []

    def closed() -> None:
        """What is left at the end of a range goes on in the next one, if there is any."""
        if now is not None and lines:
            rows.append((*now, _LAST, 0 if head else 1, False, fresh, not head, "\n".join(lines)))

    for batch in batches:
        for file, start, odd, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "odd", "value")), strict=True):
            if (file, start) != now:
                closed()
                now, lines, inside, head, fresh, seq = (file, start), [], bool(odd), bool(odd), start == 0, 0
            lines.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                rows.append((*now, seq, 0, not head, fresh, False, "\n".join(lines)))
                lines, head, fresh, seq = [], False, False, seq + 1
        if rows:
            yield _batch(rows)
            rows.clear()
    closed()
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
    names = ["file", "start", "seq", "place", "whole", "first", "opens", "text"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, seq, first, text): the records of CSV files, quotes and line breaks kept. (start, seq) orders those of a
    file, and ``first`` is the first of them.

    Quotes are doubled inside quoted fields. A quote that is never closed makes the rest of its file one record. Empty lines
    between records are empty records.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begins = odd.select("file", "start", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("odd"))
    # A row for each range of bytes that a task reads; the lines stay where they are.
    pieces = lines.join(F.broadcast(begins), ["file", "start"]).select("file", "start", "odd", "value").mapInArrow(_put_together, _PIECES)
    whole = pieces.where("whole").select("file", "start", "seq", "first", "text")
    # A record that crosses borders is an opening piece and all pieces up to the next opening one.
    order = Window.partitionBy("file").orderBy("start", "place")
    cut = pieces.where("not whole").withColumn("record", F.sum(F.col("opens").cast("int")).over(order))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "text"))), lambda p: p["text"])
    begin = F.min("start").alias("start"), F.lit(_LAST).alias("seq")
    mended = cut.groupBy("file", "record").agg(*begin, F.bool_or("first").alias("first"), F.array_join(listed, "\n").alias("text"))
    return whole.unionByName(mended.drop("record"))


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, placed: bool = False) -> DataFrame:
    """The rows that Spark's own reader gives for these files with ``header``, ``multiLine`` and doubled quotes, columns by
    position. A header with other names, upper or lower case alike, is an error. ``placed`` adds _file, _start and _seq, which
    order the rows as they stand in the files.
    """
    records = read_records(spark, path).withColumn("text", F.regexp_replace("text", "\r$", ""))
    options = {"escape": '"', "multiLine": "true"}
    names = ", ".join(f"`c{k}` string" for k in range(len(schema)))
    found = F.array(*[F.lower(F.from_csv("text", names, options)[f"c{k}"]) for k in range(len(schema))])
    same = found.eqNullSafe(F.array(*[F.lit(f.name.lower()) for f in schema]))
    wrong = F.raise_error(F.concat(F.lit("another header than expected in "), F.col("file"))).cast("boolean")
    rows = records.where("text <> ''").where(F.when(~F.col("first"), F.lit(True)).when(same, F.lit(False)).otherwise(wrong))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    order = [F.col(c).alias(f"_{c}") for c in ("file", "start", "seq")] if placed else []
    return rows.select(F.from_csv("text", kinds, options).alias("_row"), *order).select("_row.*", *[f"_{c}" for c in ("file", "start", "seq")][: len(order)])
