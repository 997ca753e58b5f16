"""Labelled rows for fitting, without the held-out ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.session import stage

MAX_ROWS = 20_000  # labelled rows a model is fitted on, at most


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id counts as crc32 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0)) % modulus == remainder


def labelled_texts(
    docs: DataFrame, labels: DataFrame, column: str, modulus: int, remainder: int, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Rows (doc_id, text, label) to fit on, written once: ``max_rows`` of those not held out, chosen by a hash of the id.

    The chosen ids, 16 bytes each and ``max_rows`` at most, are broadcast, so no text is shuffled. A null label or id is no
    label; of labels that share an id the greatest counts; a label without a document is ignored.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(column).cast("int").alias("label"))
    known = rows.where("_id is not null and label is not null").where(~held_out("_id", modulus, remainder))
    chosen = known.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
    return stage(joined, "labelled")
