"""Connected components of a large graph by alternating stars, in DataFrame operations only.

Each round hooks every vertex to the least vertex it touches (large star) and then the neighbours of each vertex to
the least of them (small star). Rounds are written below ``spark.checkpoint.dir``, so a lost executor costs one round.
Least neighbours are pre-aggregated before the shuffle, and the joins are plain equi-joins that the adaptive skew join
can split, so a hub with a large share of all edges does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    hooked = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hooked.union(least.select("a", F.col("least").alias("b"))).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """Rows (vertex, component) for every vertex of ``edges`` (columns a, b); component is its least vertex.

    Repeated edges and loops change nothing; a vertex without an edge to another one does not appear; rows with a
    null end are ignored; no edges give an empty result.
    """
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = stage(now.distinct(), "edges")
    seen = None
    while True:
        after = stage(_small_star(_large_star(now)).distinct(), "edges")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen or sums[0] == 0:
            break
        now, seen = after, sums
    roots = after.groupBy("b").agg(F.lit(1)).select(F.col("b").alias("vertex"), F.col("b").alias("component"))
    return after.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(roots)
