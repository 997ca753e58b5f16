"""Fitted preprocessing: every statistic is a small table, every transformation a column expression."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom import __version__
from screenloom.config import PreprocessConfig
from screenloom.dims.domain import CLASS_NAMES
from screenloom.operators.features import noisy, quoted
from screenloom.operators.quantiles import column_stats, exact_quantiles
from screenloom.session import stage

GRID = 65
START_RANGE, LAMBDA_BOUND, LAMBDA_WIDTH = (-2.0, 2.0), 24.0, 1e-3
MIN_VARIANCE = 1e-300


# ---- single steps ----------------------------------------------------------------------------------------------


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and population deviation of every column, in one pass; missing values do not count."""
    return {c: (s.mean, s.deviation) for c, s in column_stats(df, columns).items()}


def clip(value: Column, low: float | None, high: float | None) -> Column:
    """Clip, keeping missing values missing."""
    if low is None or high is None:
        return value
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def yeo_johnson(x: Column, lam: float | Column) -> Column:
    """Yeo-Johnson transformation of one value."""
    lam = F.lit(lam) if isinstance(lam, float) else lam
    positive = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    mirrored = 2 - lam
    negative = F.when(F.abs(mirrored) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, mirrored) - 1) / mirrored)
    return F.when(x >= 0, positive).otherwise(negative)


def yeo_johnson_value(x: float, lam: float) -> float:
    """The same for a single number on the driver, for fitted order statistics."""
    if x >= 0:
        return math.log1p(x) if abs(lam) < 1e-12 else (math.pow(x + 1, lam) - 1) / lam
    return -math.log1p(-x) if abs(2 - lam) < 1e-12 else -(math.pow(1 - x, 2 - lam) - 1) / (2 - lam)


def fit_yeo_johnson(
    df: DataFrame,
    columns: list[str],
    spread: dict[str, tuple[float | None, float | None]] | None = None,
    width: float = LAMBDA_WIDTH,
    bound: float = LAMBDA_BOUND,
) -> dict[str, float]:
    """Maximum-likelihood lambda of every column; constant columns keep 1 (identity).

    All columns share each pass: one aggregation gives the likelihood on a grid, then the grid moves (no further than
    ``bound`` either way) or shrinks around the best value, down to ``width``; the top of the parabola through the best
    point and its neighbours is the result. ``spread`` saves a pass where the moments are known.
    """
    spread = spread or moments(df, columns)
    active = [c for c in columns if spread[c][1]]
    result = dict.fromkeys(columns, 1.0)
    ranges = dict.fromkeys(active, START_RANGE)
    values = df.select(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(active)])
    while wide := [c for c in active if ranges[c][1] - ranges[c][0] > width]:
        index = {active.index(c): c for c in wide}
        grids = {}
        for i, c in index.items():
            low, high = ranges[c]
            grids[i] = [low + (high - low) * j / (GRID - 1) for j in range(GRID)]
        scores: dict[int, list[float]] = {i: [-math.inf] * GRID for i in grids}
        for row in _likelihoods(values, grids).collect():  # columns x grid rows
            scores[row["i"]][row["j"]] = _log_likelihood(row, grids[row["i"]][row["j"]])
        for i, column in index.items():
            best = max(range(GRID), key=scores[i].__getitem__)
            ranges[column] = _next_range(grids[i], best, bound)
            result[column] = _top(grids[i], scores[i], best)
    return result


def _top(grid: list[float], scores: list[float], best: int) -> float:
    """The top of the parabola through the best grid point and its neighbours."""
    if not 0 < best < len(grid) - 1 or not math.isfinite(scores[best - 1] + scores[best + 1]):
        return grid[best]
    left, right = scores[best] - scores[best - 1], scores[best] - scores[best + 1]
    return grid[best] + (grid[1] - grid[0]) * (left - right) / (2 * (left + right)) if left + right > 0 else grid[best]


def _likelihoods(values: DataFrame, grids: dict[int, list[float]]) -> DataFrame:
    """Variance of the transformed values per column and grid point.

    Powers of the different values of whole Arrow batches, weighed by how often each stands there: flags, counts and products
    of counts have few. A task returns one row per column and grid point, and Spark merges them.
    """

    def partial(batches):
        import numpy as np
        import pandas as pd

        def power(x, lam):
            safe = np.where(np.abs(lam) < 1e-12, 1.0, lam)
            raised = ((x + 1)[:, None] ** safe - 1) / safe
            return np.where(np.abs(lam) < 1e-12, np.log1p(x)[:, None], raised)

        count, logs = dict.fromkeys(grids, 0), dict.fromkeys(grids, 0.0)
        mean = {i: np.zeros(len(g)) for i, g in grids.items()}
        square = {i: np.zeros(len(g)) for i, g in grids.items()}
        for batch in batches:
            for i, grid in grids.items():
                x = batch[f"x{i}"].to_numpy(dtype=float)
                x = x[~np.isnan(x)]
                if not x.size:
                    continue
                n = x.size
                x, times = np.unique(x, return_counts=True)
                signed = np.sign(x) * np.log1p(np.abs(x))
                lam = np.array(grid)
                y = power(np.maximum(x, 0.0), lam)
                if x.min() < 0:
                    y = y - power(np.maximum(-x, 0.0), 2 - lam)
                m = (y * times[:, None]).sum(axis=0) / n
                step, all_ = m - mean[i], count[i] + n
                square[i] += ((y - m) ** 2 * times[:, None]).sum(axis=0) + step * step * count[i] * n / all_
                mean[i] += step * n / all_
                count[i] = all_
                logs[i] += (signed * times).sum()
        rows = [(i, j, count[i], logs[i], mean[i][j], square[i][j]) for i, g in grids.items() for j in range(len(g))]
        yield pd.DataFrame([r for r in rows if r[2]], columns=["i", "j", "n", "logs", "mean", "square"])

    schema = "i int, j int, n long, logs double, mean double, square double"
    parts = values.select(*[f"x{i}" for i in grids]).mapInPandas(partial, schema)
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) / n - mean * mean
    variance = F.sum("square") / n + F.greatest(between, F.lit(0.0))
    return parts.groupBy("i", "j").agg(n.alias("n"), F.sum("logs").alias("logs"), variance.alias("variance"))


def _log_likelihood(row, lam: float) -> float:
    variance = row["variance"]
    if variance is None or not variance > MIN_VARIANCE or math.isinf(variance):
        return -math.inf
    return -row["n"] / 2 * math.log(variance) + (lam - 1) * row["logs"]


def _next_range(grid: list[float], best: int, bound: float) -> tuple[float, float]:
    width = grid[-1] - grid[0]
    if best == 0 and grid[0] > -bound:
        return grid[0] - 2 * width, grid[1]
    if best == len(grid) - 1 and grid[-1] < bound:
        return grid[-2], grid[-1] + 2 * width
    return grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]


# ---- the fitted chain ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnFit:
    name: str
    low: float | None = None
    high: float | None = None
    fill: float = 0.0
    lam: float | None = None
    center: float = 0.0
    scale: float = 1.0
    keep: bool = True


FIT_SCHEMA = (
    "name string, low double, high double, fill double, lam double, center double, scale double, keep boolean"
)


@dataclass(frozen=True)
class FittedPreprocessor:
    config: PreprocessConfig
    columns: tuple[ColumnFit, ...]

    @property
    def names_in(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def names_out(self) -> list[str]:
        return [c.name for c in self.columns if c.keep]

    def expressions(self, winsorize: bool = True) -> dict[str, Column]:
        out = {}
        for c in self.columns:
            if c.keep:
                value = clip(quoted(c.name), c.low, c.high) if winsorize else quoted(c.name)
                value = F.coalesce(value, F.lit(c.fill))
                if c.lam is not None:
                    value = yeo_johnson(value, c.lam)
                out[c.name] = (value - c.center) / c.scale
        return out

    def transform(self, df: DataFrame, others: list[str], winsorize: bool = True) -> DataFrame:
        """``others`` and the processed features."""
        processed = [column.alias(name) for name, column in self.expressions(winsorize).items()]
        return df.select(*others, *processed)

    def vectors(self, df: DataFrame, others: list[str], winsorize: bool = True) -> DataFrame:
        """``others`` and one ``features`` vector, for MLlib."""
        plain = {name: f"f{i}" for i, name in enumerate(self.names_out)}
        processed = [c.alias(plain[n]) for n, c in self.expressions(winsorize).items()]
        assembler = VectorAssembler(inputCols=list(plain.values()), outputCol="features")
        return assembler.transform(df.select(*others, *processed)).select(*others, "features")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(c).values()) for c in self.columns], FIT_SCHEMA)

    def metadata(self) -> dict:
        return {
            "version": __version__,
            "config": asdict(self.config),
            "n_features_in": len(self.columns),
            "n_features_out": len(self.names_out),
            "class_names": CLASS_NAMES,
        }

    def save(self, spark: SparkSession, path: str) -> None:
        numbered = [(i, *asdict(c).values()) for i, c in enumerate(self.columns)]
        spark.createDataFrame(numbered, f"position int, {FIT_SCHEMA}").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/columns"
        )
        meta = spark.createDataFrame([(json.dumps(self.metadata()),)], "value string")
        meta.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedPreprocessor:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        rows = spark.read.parquet(f"{path}/columns").orderBy("position").drop("position").collect()
        return FittedPreprocessor(PreprocessConfig(**meta["config"]), tuple(ColumnFit(**r.asDict()) for r in rows))


def fit(features: DataFrame, columns: list[str], key: str, cfg: PreprocessConfig, noise: bool = True) -> FittedPreprocessor:
    """Fit on ``features``, which is read several times and should be a table.

    Bounds and scales come from the noisy values, as the training rows carry noise.
    """
    if noise and cfg.noise_std:
        features = stage(features.withColumns(noisy(columns, key, cfg)), "noisy")
    stats = column_stats(features, columns)
    if endless := [c for c in columns if stats[c].negative_infinite or stats[c].positive_infinite]:
        raise ValueError(f"infinite values in {', '.join(endless)}: replace them or make them missing")
    rows = features.count()
    gaps = [c for c in columns if stats[c].n < rows]
    edge = cfg.winsorize_clip
    bounds = {
        c: (s.mean - edge * s.deviation, s.mean + edge * s.deviation) if s.n else (None, None) for c, s in stats.items()
    }

    def clipped(c: str, value: float) -> float:
        low, high = bounds[c]
        return value if low is None else min(max(value, low), high)

    # Clipping keeps the order, so order statistics of the clipped values are clipped order statistics.
    quartiles = {
        c: [replace(q, lower=clipped(c, q.lower), upper=clipped(c, q.upper)) for q in qs]
        for c, qs in exact_quantiles(features, columns, [0.25, 0.5, 0.75], stats=stats).items()
    }
    fills = {c: quartiles[c][1].value for c in gaps if c in quartiles}
    filled = stage(
        features.select(
            *[F.coalesce(clip(quoted(c), *bounds[c]), F.lit(fills.get(c, 0.0))).alias(c) for c in columns]
        ),
        "filled",
    )
    if gaps:
        quartiles |= exact_quantiles(filled.select(*[quoted(c) for c in gaps]), gaps, [0.25, 0.5, 0.75])
    lams = fit_yeo_johnson(filled, columns) if cfg.use_power_transform else {}
    medians = {c: q[1].value for c, q in quartiles.items()}
    fits = []
    for c in columns:
        low, high = bounds[c]
        base = ColumnFit(c, low, high, fills.get(c, medians.get(c, 0.0)), lams.get(c))
        fits.append(base)
    powered = {
        f.name: yeo_johnson(quoted(f.name), f.lam) if f.lam is not None else quoted(f.name) for f in fits
    }
    spread = moments(filled.select(*[x.alias(c) for c, x in powered.items()]), columns)
    if cfg.scaler_type == "robust":
        # The transformation is increasing, so it maps order statistics to order statistics.
        fits = [_robust(f, quartiles[f.name]) for f in fits]
    else:
        fits = [replace(f, center=spread[f.name][0], scale=spread[f.name][1] or 1.0) for f in fits]
    kept = [replace(f, keep=(spread[f.name][1] / f.scale) ** 2 > cfg.variance_threshold) for f in fits]
    return FittedPreprocessor(cfg, tuple(kept))


def _robust(fitted: ColumnFit, quartiles: list) -> ColumnFit:
    def at(q) -> float:
        if fitted.lam is None:
            return q.value
        low, high = yeo_johnson_value(q.lower, fitted.lam), yeo_johnson_value(q.upper, fitted.lam)
        return low + (high - low) * q.weight

    q25, median, q75 = (at(q) for q in quartiles)
    return replace(fitted, center=median, scale=(q75 - q25) or 1.0)
