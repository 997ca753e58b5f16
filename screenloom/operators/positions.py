"""Positions and running totals that hold when one key owns a large share of the rows.

A window over a key sends all rows of that key to one task. Here rows are first counted per (key, level values),
the small counts are accumulated, and only the rows that share every level value are numbered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Level = tuple[str, bool]  # column name, ascending


def same_keys_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null meets null, so that rows with null keys stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def _ordered(level: Level) -> Column:
    name, ascending = level
    return F.col(name).asc() if ascending else F.col(name).desc()


def running_totals(df: DataFrame, keys: list[str], levels: list[Level], measures: dict[str, Column]) -> DataFrame:
    """One row per (keys, levels) with the sums of ``measures`` and, as ``<name>_before``, their sums over all
    earlier level values of the same keys."""
    names = [name for name, _ in levels]
    counts = df.groupBy(*keys, *names).agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    result = counts
    parts: dict[str, list[Column]] = {m: [] for m in measures}
    for depth, level in enumerate(levels):
        outer, inner = keys + names[:depth], keys + names[: depth + 1]
        window = Window.partitionBy(*outer).orderBy(_ordered(level)).rowsBetween(Window.unboundedPreceding, -1)
        last = depth == len(levels) - 1
        at_level = counts if last else counts.groupBy(*inner).agg(*[F.sum(m).alias(m) for m in measures])
        before = [F.coalesce(F.sum(m).over(window), F.lit(0)).alias(f"_{m}_{depth}") for m in measures]
        result = same_keys_join(result, at_level.select(*inner, *before), inner)
        for m in measures:
            parts[m].append(F.col(f"_{m}_{depth}"))
    totals = [sum(columns[1:], columns[0]).alias(f"{m}_before") for m, columns in parts.items()]
    return result.select(*keys, *names, *measures, *totals)


def with_position(df: DataFrame, keys: list[str], levels: list[Level], order: list[Column], name: str) -> DataFrame:
    """Add the 1-based position of each row within ``keys`` ordered by ``levels`` and then ``order``.

    Choose levels so that rows sharing all level values are few. ``df`` is read twice: stage it when it is costly.
    Rows with null keys or level values are numbered like any other; null is a key of its own and the least value.
    """
    names = [n for n, _ in levels]
    before = running_totals(df, keys, levels, {"_rows": F.lit(1)}).drop("_rows")
    window = Window.partitionBy(*keys, *names).orderBy(*order)
    numbered = df.withColumn("_local", F.row_number().over(window))
    return (
        same_keys_join(numbered, before, keys + names)
        .withColumn(name, (F.col("_local") + F.col("_rows_before")).cast("long"))
        .drop("_local", "_rows_before")
    )
