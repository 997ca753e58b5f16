"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent and normalised. The exponent is bisected until the weights reach a
target entropy, or until no source repeats more often than allowed. The weights become token budgets, and a budget is
realised in block permutations: documents fall into blocks by a hash, each epoch runs through the blocks in an order of
its own, and the last epoch of a source stops where its budget ends.

Only sums per source and per block are shuffled. A source is described by one row (whole epochs, and where the last one
stops, as hashes), so that each document can tell by itself how often it is used: texts are never shuffled, however large
one source is. Nothing per source or block reaches the driver; each round of the bisection returns two numbers for each
of 32 exponents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom.operators.positions import running_totals
from screenloom.session import stage

BLOCK_TOKENS = 65_536
_POINTS = 32


def word_count(text: str = "text") -> Column:
    """Words of a text; none in a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    """The source as text that tells null from every name."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _unit(value: Column) -> Column:
    """A hash as a number from 0 up to, not including, 1."""
    return F.shiftrightunsigned(value, 11).cast("double") / float(1 << 53)


# ---- the exponent -----------------------------------------------------------------------------------------------


def _measures(shares: DataFrame, exponents: list[float], tokens_ratio: float) -> list[tuple[float, float]]:
    """(entropy, most repeats) of the weights for each exponent."""
    columns = []
    for k, x in enumerate(exponents):
        power = F.exp(F.lit(x) * F.col("log_share"))
        columns += [F.sum(power).alias(f"s{k}"), F.sum(power * F.col("log_share")).alias(f"m{k}")]
        columns.append(F.max(F.lit(x - 1.0) * F.col("log_share")).alias(f"r{k}"))
    row = shares.agg(*columns).first()
    found = []
    for k, x in enumerate(exponents):
        total = row[f"s{k}"]
        found.append((math.log(total) - x * row[f"m{k}"] / total, math.exp(row[f"r{k}"]) / total * tokens_ratio))
    return found


def find_exponent(shares: DataFrame, tokens_ratio: float, entropy_share: float | None, max_repeats: float | None) -> float:
    """The exponent between 0 (all sources equal) and 1 (as they come).

    ``entropy_share`` asks for that part of the way from the entropy at 1 to the entropy at 0. ``max_repeats`` asks for
    the least exponent that repeats no source more often; with both, the greater exponent wins.
    """
    ends = _measures(shares, [0.0, 1.0], tokens_ratio)
    if max_repeats is not None and ends[1][1] > max_repeats * (1 + 1e-9):
        raise ValueError(f"the budget repeats every source {ends[1][1]:.3g} times; max_repeats is {max_repeats:g}")
    tests = []
    if entropy_share is not None:
        goal = ends[1][0] + entropy_share * (ends[0][0] - ends[1][0])
        tests.append((0, goal))
    if max_repeats is not None:
        tests.append((1, max_repeats))
    best = 0.0 if tests else 1.0
    for which, goal in tests:
        low, high = 0.0, 1.0  # both measures fall as the exponent grows
        if ends[0][which] <= goal * (1 + 1e-12):
            high = 0.0
        while high - low > 1e-9:
            points = [low + (high - low) * (k + 1) / (_POINTS + 1) for k in range(_POINTS)]
            over = [m[which] > goal for m in _measures(shares, points, tokens_ratio)]
            firm = over.index(False) if False in over else _POINTS
            low, high = ([low, *points][firm], [*points, high][firm])
        best = max(best, high)
    return best


# ---- the plan ---------------------------------------------------------------------------------------------------


@dataclass
class Mixture:
    """``sources``: one row per source (columns named below); ``exponent``, ``budget`` in tokens, ``seed``.

    _key, tokens, weight, budget, blocks, epochs (whole ones), cut_place, cut_block and cut_doc (hash places at which the
    last epoch stops).
    """

    sources: DataFrame
    exponent: float
    budget: int
    seed: int


def _block(seed: int, doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.col("blocks"))


def _place(seed: int, epoch: Column) -> Column:
    """Where a block stands in the permutation of an epoch."""
    return F.xxhash64(F.lit(seed), F.lit("block"), "_key", epoch, "_block")


def _within(seed: int, epoch: Column, doc_id: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("document"), epoch, F.col(doc_id))


def plan(
    docs: DataFrame,
    tokens: Column | None = None,
    budget: int | None = None,
    entropy_share: float | None = 0.5,
    max_repeats: float | None = 4.0,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 17,
    doc_id: str = "doc_id",
    source: str = "source",
) -> Mixture:
    """Weights and budgets of all sources. ``tokens`` defaults to the words of ``text``, ``budget`` to all tokens.

    A null source is a source of its own. A source without tokens gets no weight. Budgets are rounded down.
    """
    measured = docs.select(_key(source).alias("_key"), F.col(doc_id).alias("doc_id"), (word_count() if tokens is None else tokens).alias("n"))
    sizes = stage(measured, "mix_sizes")
    totals = stage(sizes.groupBy("_key").agg(F.sum("n").alias("tokens")), "mix_totals")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        none = ["0L as weight", "0L as budget", "1L as blocks", "0L as epochs", "0L as cut_place", "0L as cut_block", "0L as cut_doc"]
        return Mixture(totals.selectExpr("_key", "tokens", *none).limit(0), 1.0, 0, seed)  # nothing to use
    budget = total if budget is None else budget
    shares = totals.where("tokens > 0").withColumn("log_share", F.log(F.col("tokens") / F.lit(float(total))))
    exponent = find_exponent(shares, budget / total, entropy_share, max_repeats)
    scale = shares.agg(F.sum(F.exp(F.lit(exponent) * F.col("log_share")))).first()[0]
    weighed = shares.withColumn("weight", F.exp(F.lit(exponent) * F.col("log_share")) / F.lit(scale))
    weighed = weighed.withColumn("budget", F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(1e-6)).cast("long"))
    weighed = weighed.withColumn("blocks", F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long"))
    weighed = weighed.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
    weighed = stage(weighed.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("log_share"), "mix_weights")
    return Mixture(_cuts(sizes, weighed, seed), exponent, budget, seed)


def _cuts(sizes: DataFrame, weighed: DataFrame, seed: int) -> DataFrame:
    """Add where the last epoch of each source stops: at the first block that does not fit the rest of the budget, and
    in it at the first document that does not."""
    last = F.col("epochs")
    narrow = weighed.select("_key", "blocks", "epochs", "rest")
    placed = sizes.join(narrow, "_key").withColumn("_block", _block(seed, "doc_id"))
    blocks = placed.groupBy("_key", "_block", "epochs", "rest").agg(F.sum("n").alias("n"))
    blocks = stage(blocks.withColumn("_place", _place(seed, last)).withColumn("_super", F.shiftright("_place", 44)), "mix_blocks")
    before = running_totals(blocks, ["_key"], [("_super", True), ("_place", True)], {"n": F.col("n")})
    edge = blocks.drop("n").join(before, ["_key", "_super", "_place"])
    edge = edge.where((F.col("n_before") <= F.col("rest")) & (F.col("n_before") + F.col("n") > F.col("rest")))
    edge = edge.groupBy("_key").agg(F.min(F.struct("_place", "_block", "n_before", "rest")).alias("_e")).select("_key", "_e.*")
    at_edge = placed.drop("rest").join(edge, ["_key", "_block"]).withColumn("_doc", _within(seed, last, "doc_id"))
    same = at_edge.groupBy("_key", "_doc").agg(F.sum("n").alias("n"), F.first("n_before").alias("n_before"), F.first("rest").alias("rest"))
    order = Window.partitionBy("_key").orderBy("_doc").rowsBetween(Window.unboundedPreceding, 0)  # one block a source
    over = same.withColumn("_until", F.col("n_before") + F.sum("n").over(order)).where("_until > rest")
    stop = over.groupBy("_key").agg(F.min("_doc").alias("cut_doc"))
    cut = edge.select("_key", F.col("_place").alias("cut_place"), F.col("_block").alias("cut_block"))
    return stage(weighed.drop("rest").join(cut, "_key", "left").join(stop, "_key", "left"), "mix_sources")


def realise(docs: DataFrame, mixture: Mixture, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with a row per use, and the columns _mix_epoch, _mix_block, _mix_key and _mix_weight.

    Sorting by _mix_key (0 to 1) interleaves the sources at their weights: blocks in their order of the epoch,
    documents in theirs within the block. No text is shuffled; the sources, one short row each, are joined by their
    size. Rows that share an id are used equally often. An empty table gives an empty result. If ``docs`` has columns
    that begin with _mix, the added ones begin with one more underscore.
    """
    seed, names = mixture.seed, docs.columns
    pre = "_mix"
    while any(c.lower().startswith(pre) for c in names):
        pre = f"_{pre}"
    own = lambda c: F.col(f"{pre}_{c}")
    kept = ["tokens", "weight", "budget", "blocks", "epochs", "cut_place", "cut_block", "cut_doc"]
    rows = mixture.sources.select(F.col("_key").alias(f"{pre}_of"), *[F.col(c).alias(f"{pre}_{c}") for c in kept])
    joined = docs.withColumn(f"{pre}_own", _key(source)).join(rows, own("own") == own("of"))
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), own("blocks"))
    place = lambda epoch: F.xxhash64(F.lit(seed), F.lit("block"), own("of"), epoch, own("block"))
    last = own("epochs")
    at = joined.withColumn(f"{pre}_block", block)
    inside = place(last) < own("cut_place")
    edge = (place(last) == own("cut_place")) & (own("block") == own("cut_block"))
    edge &= own("cut_doc").isNull() | (_within(seed, last, doc_id) < own("cut_doc"))
    used = at.withColumn(f"{pre}_uses", last + F.when(inside | edge, 1).otherwise(0)).where(own("uses") > 0)
    used = used.withColumn(f"{pre}_epoch", F.explode(F.sequence(F.lit(0).cast("long"), own("uses") - 1)))
    turn = _unit(place(own("epoch")).bitwiseXOR(F.lit(-(1 << 63))))
    fine = _unit(_within(seed, own("epoch"), doc_id))
    length = F.greatest(own("budget") / own("tokens"), F.lit(1e-12))
    along = (own("epoch") + (turn * (own("blocks") - 1) + fine) / own("blocks")) / length
    return used.select(
        *[F.col(f"`{c}`") for c in names],
        own("epoch"),
        own("block"),
        F.least(along, F.lit(1.0)).alias(f"{pre}_key"),
        own("weight").cast("double").alias(f"{pre}_weight"),
    )
