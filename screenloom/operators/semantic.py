"""Skills implied by the similarity of given vectors. Vectors come from the caller; none means exact skills only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.42  # fixed value
BLOCK_SKILLS = 10_000  # skill vectors compared at once
BLOCK_TEXTS = 50_000


def centroids(vectors: DataFrame, group: str, prefix: str) -> DataFrame:
    """(skill, vec): the mean vector per group, combined before the shuffle."""
    entries = vectors.select(group, F.posexplode("embedding").alias("pos", "x"))
    means = entries.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec")
    return means.groupBy(group).agg(vec).select(
        F.concat(F.lit(prefix), F.col(group).cast("string")).alias("skill"), "vec"
    )


def implied_skills(
    texts: DataFrame,
    skill_vectors: DataFrame,
    id_column: str,
    vector: str,
    found: str,
    threshold: float = THRESHOLD,
    block_skills: int | None = None,
    block_texts: int = BLOCK_TEXTS,
) -> DataFrame:
    """(id, implied_skill, similarity) for skills at least ``threshold`` close and not among the ``found`` ones.

    Skill vectors that fit into one block, which is counted first, go to every task. More of them are dealt into blocks by a
    hash, as are the texts, and each pair of a skill block and a text block meets in a task of its own; nothing passes the
    driver. A block of texts and one of skills are one matrix product, so no pairs are formed.
    """
    block_skills = block_skills or BLOCK_SKILLS
    schema = f"{id_column} {texts.schema[id_column].dataType.simpleString()}, implied_skill string, similarity double"
    wanted = texts.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vec"), F.col(found).alias("found"))
    skills = skill_vectors.select("skill", F.col("vec").cast("array<double>").alias("vec"))
    some = skills.limit(block_skills + 1).toArrow().to_pandas()
    if len(some) <= block_skills:
        def near_all(batches):
            for batch in batches:
                yield _implied(batch, some, id_column, threshold)

        return wanted.mapInPandas(near_all, schema)
    down = math.ceil(skills.count() / block_skills)
    across = max(1, math.ceil(texts.count() / block_texts))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.withColumn("_t", F.pmod(F.xxhash64("id"), F.lit(across)).cast("int")).withColumn("_s", every(down))
    right = skills.withColumn("_s", F.pmod(F.xxhash64("skill"), F.lit(down)).cast("int")).withColumn("_t", every(across))

    def near(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return _implied(own, known, id_column, threshold)

    return left.groupBy("_t", "_s").cogroup(right.groupBy("_t", "_s")).applyInPandas(near, schema)


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(float)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _implied(texts: pd.DataFrame, skills: pd.DataFrame, id_column: str, threshold: float) -> pd.DataFrame:
    """Rows of the result for some texts (id, vec, found) and some skills."""
    names = np.array(skills["skill"].tolist(), dtype=object)
    hits, cols, close = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if len(texts) and len(skills):
        similarity = _unit(texts["vec"]) @ _unit(skills["vec"]).T
        hits, cols = (similarity >= threshold).nonzero()
        close = similarity[hits, cols]
    known = texts["found"].to_numpy()[hits]
    new = np.array([s not in k for s, k in zip(names[cols], known, strict=True)], bool)
    columns = {"implied_skill": names[cols[new]], "similarity": close[new]}
    return pd.DataFrame({id_column: np.array(texts["id"].tolist(), dtype=object)[hits[new]], **columns})
