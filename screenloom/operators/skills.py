"""Taxonomy tables, dictionary extraction of skills, and what follows from a skill list."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.dims.taxonomy import STARTER_TAXONOMY
from screenloom.functions.scores import breadth_bonus, jd_coverage
from screenloom.functions.text import normalize_text, strip
from screenloom.operators.dictionary import Dictionary

# ``ord`` is a path (source, file, category, place ...), compared part by part, so nothing is packed or overflows.
ENTRY_SCHEMA = "ord array<long>, category string, canonical string, aliases array<string>"
BLOCK_VARIANTS = 100_000  # variants that one matcher column holds


# ---- taxonomy tables -------------------------------------------------------------------------------------------


def starter_entries(spark: SparkSession) -> DataFrame:
    """The starter taxonomy, one row per registration."""
    flat = [(c, s, a) for c, skills in STARTER_TAXONOMY.items() for s, a in skills.items()]
    return spark.createDataFrame([([i], *row) for i, row in enumerate(flat)], ENTRY_SCHEMA)


def merge_entries(base: DataFrame, *extra: DataFrame) -> DataFrame:
    """Register ``extra`` after ``base``; the order of each input is kept, also of inputs that were merged before."""
    merged = [
        e.withColumn("ord", F.concat(F.array(F.lit(i).cast("long")), F.col("ord"))) for i, e in enumerate([base, *extra])
    ]
    return reduce(DataFrame.unionByName, merged)


def entries_table(entries: DataFrame) -> DataFrame:
    """(category, canonical, alias position, alias); the last registration of a pair replaces its aliases."""
    latest = entries.groupBy("category", "canonical").agg(
        F.max_by("aliases", "ord").alias("aliases"), F.min("ord").alias("ord")
    )
    return latest.select("ord", "category", "canonical", F.posexplode_outer("aliases").alias("alias_ord", "alias"))


def canonical_table(entries: DataFrame) -> DataFrame:
    """One row per canonical: registration position, latest category and its aliases."""
    per_name = entries.groupBy("canonical").agg(
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
        F.max_by("category", "ord").alias("category"),
        F.max_by("aliases", "ord").alias("aliases"),
    )
    # Names that differ only in case share one slot: the first position, the latest spelling.
    return (
        per_name.groupBy(F.lower("canonical").alias("canonical_lower"))
        .agg(F.min("first_ord").alias("ord"), F.max_by(F.struct("canonical", "category", "aliases"), "last_ord").alias("c"))
        .select("ord", "canonical_lower", "c.canonical", "c.category", "c.aliases")
    )


def alias_table(entries: DataFrame) -> DataFrame:
    """alias -> canonical for resolving a token; the first registration of an alias keeps it."""
    aliases = entries.select("ord", "canonical", F.posexplode("aliases").alias("alias_ord", "alias"))
    clean = aliases.withColumn("alias", strip(F.lower("alias"))).where("alias <> ''")
    owner = F.min_by("canonical", F.struct("ord", "alias_ord")).alias("canonical")
    return clean.groupBy("alias").agg(owner)


def variant_table(entries: DataFrame) -> DataFrame:
    """variant -> canonical for matching text; a variant belongs to the first canonical that lists it."""
    names = canonical_table(entries)
    variants = names.select(
        "ord",
        "canonical",
        F.posexplode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array()))).alias("pos", "variant"),
    )
    clean = variants.withColumn("variant", F.lower("variant")).where(strip(F.col("variant")) != "")
    return clean.groupBy("variant").agg(F.min_by("canonical", F.struct("ord", "pos")).alias("canonical"))


# ---- extraction ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Matcher:
    """Compiled variants, in blocks of bounded size. A taxonomy of any size is matched by the same map-only plan, in
    batches and streams: one column of found skills per block, united per row."""

    blocks: tuple[Dictionary, ...]

    @staticmethod
    def build(entries: DataFrame, block_variants: int = BLOCK_VARIANTS) -> Matcher:
        rows = variant_table(entries).orderBy("variant").toLocalIterator()
        blocks = []
        while some := list(islice(rows, block_variants)):
            blocks.append(Dictionary([r["variant"] for r in some], [r["canonical"] for r in some]))
        return Matcher(tuple(blocks))

    def skills(self, df: DataFrame, text: str, out: str = "skills") -> DataFrame:
        """Add the sorted canonical skills found in ``text``; a null text has none."""
        none = F.array().cast("array<string>")
        found = [_finder(block)(normalize_text(F.col(text))) for block in self.blocks]
        return df.withColumn(out, F.array_sort(reduce(F.array_union, found, none)))


def _finder(block: Dictionary):
    def find(texts: pa.Array) -> pa.Array:
        return block.find(texts)

    return F.arrow_udf(find, "array<string>")


def add_implied(df: DataFrame, implied: DataFrame, id_column: str, skills: str = "skills") -> DataFrame:
    """Union of found skills and implied ones (id, implied_skill), sorted."""
    extra = implied.groupBy(id_column).agg(F.collect_set("implied_skill").alias("_implied"))
    merged = F.array_union(skills, F.coalesce("_implied", F.array().cast("array<string>")))
    return df.join(extra, id_column, "left").withColumn(skills, F.array_sort(merged)).drop("_implied")


# ---- what follows from skill lists -----------------------------------------------------------------------------


def resolve_tokens(tokens: DataFrame, entries: DataFrame, token: str = "token") -> DataFrame:
    """Canonical of a token: a canonical name first, an alias second, else null."""
    names = canonical_table(entries).select(F.col("canonical_lower").alias("_key"), F.col("canonical").alias("_name"))
    aliases = alias_table(entries).select(F.col("alias").alias("_key"), F.col("canonical").alias("_alias"))
    keyed = tokens.withColumn("_key", F.lower(strip(F.col(token))))
    joined = keyed.join(names, "_key", "left").join(aliases, "_key", "left")
    return joined.withColumn("canonical", F.coalesce("_name", "_alias")).drop("_key", "_name", "_alias")


def with_category(df: DataFrame, entries: DataFrame, skill: str = "skill") -> DataFrame:
    categories = canonical_table(entries).select(F.col("canonical").alias(skill), "category")
    return df.join(categories, skill, "left").withColumn("category", F.coalesce("category", F.lit("Unknown")))


def skills_by_category(df: DataFrame, entries: DataFrame, id_column: str) -> DataFrame:
    """Sorted skills of each (id, category); groups are bounded by the taxonomy."""
    exploded = df.select(id_column, F.explode("skills").alias("skill"))
    grouped = with_category(exploded, entries).groupBy(id_column, "category")
    return grouped.agg(F.array_sort(F.collect_set("skill")).alias("skills"))


def coverage_columns(skills: str, jd_skills: str) -> dict[str, Column]:
    """Coverage report of two skill lists; an empty job gives 0.5 and no bonus here."""
    has, wants = F.array_distinct(skills), F.array_distinct(jd_skills)
    matched, extra = F.array_intersect(has, wants), F.array_except(has, wants)
    empty = F.size(wants) == 0
    return {
        "jd_coverage": jd_coverage(F.size(matched), F.size(wants), when_empty=0.5),
        "breadth_bonus": F.when(empty, F.lit(0.0)).otherwise(breadth_bonus(F.size(extra))),
        "matched": F.array_sort(matched),
        "missing": F.array_sort(F.array_except(wants, has)),
        "extra": F.array_sort(extra),
    }
