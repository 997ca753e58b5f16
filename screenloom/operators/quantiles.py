"""Exact quantiles and moments of many columns, without sorting and without gathering values.

Every pass reads all columns side by side, in Arrow batches; a task returns sums or bin counts, never a row per value.
A quantile pass counts values in equal bins of the interval that holds a wanted rank and keeps the bin's own minimum
and maximum as the next interval. Only bin counts reach the driver; their number depends on columns and bins alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 2048


@dataclass(frozen=True)
class Quantile:
    """The two order statistics around a quantile and the weight of the upper one."""

    lower: float
    upper: float
    weight: float

    @property
    def value(self) -> float:
        if self.lower == self.upper or not self.weight:
            return self.lower
        return self.lower * (1 - self.weight) + self.upper * self.weight if math.isinf(self.upper - self.lower) else (
            self.lower + (self.upper - self.lower) * self.weight
        )


@dataclass(frozen=True)
class ColumnStats:
    """Of the present values (not null, not NaN): how many, how many of them infinite either way, and of the finite
    ones mean, population deviation, least and greatest (None without any)."""

    n: int
    negative_infinite: int
    positive_infinite: int
    mean: float | None
    deviation: float | None
    low: float | None
    high: float | None


@dataclass(frozen=True)
class _Interval:
    column: int
    low: float
    high: float
    below: int  # finite values smaller than ``low``


def _numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])


def column_stats(df: DataFrame, columns: list[str]) -> dict[str, ColumnStats]:
    """All columns in one pass."""
    width = len(columns)

    def partial(batches):
        import numpy as np
        import pandas as pd

        total = np.zeros((width, 5))  # n, -inf, +inf, mean, squares around it
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            for i in range(width):
                v = x[:, i]
                v = v[~np.isnan(v)]
                finite = v[np.isfinite(v)]
                total[i, 1] += (v == -np.inf).sum()
                total[i, 2] += (v == np.inf).sum()
                if finite.size:
                    mean, before, n = finite.mean(), total[i, 0], total[i, 0] + finite.size
                    step = mean - total[i, 3]
                    total[i, 4] += ((finite - mean) ** 2).sum() + step * step * before * finite.size / n
                    total[i, 3] += step * finite.size / n
                    total[i, 0] = n
                    low[i], high[i] = min(low[i], finite.min()), max(high[i], finite.max())
        yield pd.DataFrame(
            {"i": range(width), "n": total[:, 0], "neg": total[:, 1], "pos": total[:, 2], "mean": total[:, 3],
             "square": total[:, 4], "low": low, "high": high}
        )

    schema = "i int, n double, neg double, pos double, mean double, square double, low double, high double"
    parts = _numbered(df, columns).mapInPandas(partial, schema)
    n, used = F.sum("n"), F.when(F.col("n") > 0, F.col("n") * F.col("mean")).otherwise(0.0)
    mean = F.sum(used) / n
    between = F.sum(used * F.col("mean")) / n - mean * mean
    merged = parts.groupBy("i").agg(
        n.alias("n"), F.sum("neg").alias("neg"), F.sum("pos").alias("pos"), F.try_divide(F.sum(used), n).alias("mean"),
        F.when(n > 0, F.sqrt(F.sum("square") / n + F.greatest(between, F.lit(0.0)))).alias("deviation"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    found = {r["i"]: r for r in merged.collect()}  # a row per column
    result = {}
    for i, c in enumerate(columns):
        r = found.get(i)
        if r is None or not r["n"]:
            neg, pos = (int(r["neg"]), int(r["pos"])) if r is not None else (0, 0)
            result[c] = ColumnStats(neg + pos, neg, pos, None, None, None, None)
        else:
            # equal values have no deviation, whatever rounding says
            deviation = 0.0 if r["low"] == r["high"] else r["deviation"]
            neg, pos = int(r["neg"]), int(r["pos"])
            result[c] = ColumnStats(int(r["n"]) + neg + pos, neg, pos, r["mean"], deviation, r["low"], r["high"])
    return result


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    bins: int = BINS,
    stats: dict[str, ColumnStats] | None = None,
) -> dict[str, list[Quantile]]:
    """Quantiles with linear interpolation; columns without values are left out. Infinite values are the extremes.

    ``stats`` saves a pass where the column statistics are known. The input must not change between passes.
    """
    stats = stats or column_stats(df, columns)
    where: dict[tuple[str, int], _Interval] = {}
    for i, c in enumerate(columns):
        s = stats[c]
        for p in probabilities if s.n else ():
            for rank in (math.floor((s.n - 1) * p), math.ceil((s.n - 1) * p)):
                if rank < s.negative_infinite:
                    where[(c, rank)] = _Interval(i, -math.inf, -math.inf, 0)
                elif rank >= s.n - s.positive_infinite:
                    where[(c, rank)] = _Interval(i, math.inf, math.inf, 0)
                else:
                    where[(c, rank)] = _Interval(i, s.low, s.high, 0)
    values = _numbered(df, columns)
    while wide := sorted({i for i in where.values() if i.low < i.high}, key=lambda i: (i.column, i.low, i.high)):
        counted = _count_bins(values, wide, bins)
        for (c, rank), interval in where.items():
            if interval.low < interval.high:
                rows = counted[wide.index(interval)]
                where[(c, rank)] = _narrow(interval, rank - stats[c].negative_infinite, rows, c)
    result = {}
    for c in (c for c in columns if stats[c].n):
        result[c] = []
        for p in probabilities:
            h = (stats[c].n - 1) * p
            lower, upper = where[(c, math.floor(h))].low, where[(c, math.ceil(h))].low
            result[c].append(Quantile(lower, upper, h - math.floor(h)))
    return result


def _count_bins(values: DataFrame, intervals: list[_Interval], bins: int) -> list[list]:
    def partial(batches):
        import numpy as np
        import pandas as pd

        count = np.zeros((len(intervals), bins), np.int64)
        low, high = np.full((len(intervals), bins), np.inf), np.full((len(intervals), bins), -np.inf)
        for batch in batches:
            for k, interval in enumerate(intervals):
                x = batch[f"x{interval.column}"].to_numpy(dtype=float)
                x = np.sort(x[(x >= interval.low) & (x <= interval.high)])
                if not x.size:
                    continue
                # halves, so that the width of an interval cannot overflow
                share = (x / 2 - interval.low / 2) / (interval.high / 2 - interval.low / 2)
                at = np.clip(np.nan_to_num(share * bins), 0, bins - 1).astype(np.int64)
                heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                tails = np.append(heads[1:], len(at)) - 1
                count[k, at[heads]] += tails - heads + 1
                low[k, at[heads]] = np.minimum(low[k, at[heads]], x[heads])
                high[k, at[heads]] = np.maximum(high[k, at[heads]], x[tails])
        k, b = np.nonzero(count)
        yield pd.DataFrame({"k": k, "bin": b, "n": count[k, b], "lo": low[k, b], "hi": high[k, b]})

    used = sorted({i.column for i in intervals})
    parts = values.select(*[f"x{i}" for i in used]).mapInPandas(partial, "k int, bin int, n long, lo double, hi double")
    merged = parts.groupBy("k", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    by_interval: list[list] = [[] for _ in intervals]
    for row in sorted(merged.collect(), key=lambda x: x["bin"]):  # at most intervals x bins rows
        by_interval[row["k"]].append(row)
    return by_interval


def _narrow(interval: _Interval, rank: int, rows: list, name: str) -> _Interval:
    below = interval.below
    for row in rows:
        if rank < below + row["n"]:
            narrowed = _Interval(interval.column, row["lo"], row["hi"], below)
            if narrowed == interval:
                raise ArithmeticError(f"quantiles of {name}: no progress between {interval.low} and {interval.high}")
            return narrowed
        below += row["n"]
    raise ValueError(f"rank {rank} of {name} not found: did the input change between passes?")
