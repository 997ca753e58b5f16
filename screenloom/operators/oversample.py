"""Oversampling of the smaller classes by points between neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.functions.hashing import hash32, hash_uniform
from screenloom.operators.neighbors import nearest_neighbors
from screenloom.operators.positions import with_position
from screenloom.session import stage

COPY_BLOCK = 1024
HASH_BLOCK = 1 << 16


def smote(rows: DataFrame, seed: int = 42, max_neighbors: int = 5, max_points: int | None = None) -> DataFrame:
    """Fill every class up to the largest one. ``rows`` carry (id bigint, label int, vec array<double>); it is read
    several times.

    Every row of a smaller class is a base equally often (the remainder goes to rows chosen by hash). Each new point
    lies on the segment from its base to one of the base's nearest neighbours in its class, or among ``max_points`` rows
    of it. A class without a neighbour, or with nothing missing, is left as it is; so are rows without a label.
    """
    rows = rows.select("id", "label", "vec").withColumn("synthetic", F.lit(False))
    counts = {r["label"]: r["n"] for r in rows.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    most = max(counts.values(), default=0)
    smaller = sorted(label for label, n in counts.items() if 2 <= n < most)
    made = [_between(rows, label, counts[label], most - counts[label], seed, max_neighbors, max_points) for label in smaller]
    return reduce(DataFrame.unionByName, made, rows)


def _between(rows: DataFrame, label: int, size: int, missing: int, seed: int, max_neighbors: int, max_points: int | None) -> DataFrame:
    """``missing`` new rows of one class of ``size`` rows."""
    base = rows.where(F.col("label") == label).select("id", "vec", F.monotonically_increasing_id().alias("_point"))
    base = stage(base, "bases")  # which fixes the number of each point
    neighbors = max(1, min(max_neighbors, size - 1))
    # Neighbours are known by their numbers; only the vectors that are chosen move, once.
    near = nearest_neighbors(base, base, neighbors, True, ["_point"], max_points)
    around = near.groupBy(F.col("query_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "_point"))).alias("around")  # at most max_neighbors entries
    )
    hashed = base.drop("_point").withColumn("_hash", hash32("id", seed=f"{seed}-smote"))
    hashed = hashed.withColumn("_block", F.floor(F.col("_hash") / HASH_BLOCK)).withColumn("_all", F.lit(0))
    placed = with_position(hashed, ["_all"], [("_block", True)], [F.col("_hash"), F.col("id")], "_position")
    copies = F.lit(missing // size) + (F.col("_position") <= missing % size).cast("long")
    wanted = placed.select("id", "vec", copies.alias("copies")).where(F.col("copies") > 0).join(around, "id")
    # Few bases may need very many copies: spread blocks of copies over tasks before making them.
    blocks = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPY_BLOCK))))
    first = F.col("block") * COPY_BLOCK
    last = F.least(first + COPY_BLOCK, F.col("copies")) - 1
    copied = blocks.repartition("id", "block").withColumn("copy", F.explode(F.sequence(first, last)))
    pick = (hash32("id", "copy", seed=f"{seed}-near") % F.size("around") + 1).cast("int")
    made = copied.withColumns(
        {"_point": F.element_at("around", pick)["_point"], "u": hash_uniform("id", "copy", seed=f"{seed}-u")}
    )
    made = made.drop("around").join(base.select("_point", F.col("vec").alias("chosen")), "_point")
    between = F.zip_with("vec", "chosen", lambda x, y: x + F.col("u") * (y - x))
    return made.select(
        "id", F.lit(label).cast(rows.schema["label"].dataType).alias("label"), between.alias("vec"),
        F.lit(True).alias("synthetic"),
    )
