"""Interview questions for candidate profiles (candidate_id, skills, experience_years)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom.dims import question_bank as qb
from screenloom.functions.hashing import hash32_digits
from screenloom.functions.text import seniority_tier
from screenloom.operators.backends import Backend, answered
from screenloom.session import dealt, stage

SEED = 42


def question_mix(n_per_skill: int) -> dict[str, list[int]]:
    """Questions per tier and type, rounded half to even."""
    return {tier: [max(0, round(w * (n_per_skill / (sum(ws) or 1)))) for w in ws] for tier, ws in qb.MIX.items()}


def _by_tier(values: dict[str, list], position: int) -> Column:
    pairs = [x for tier, row in values.items() for x in (F.lit(tier), F.lit(row[position]))]
    return F.element_at(F.create_map(*pairs), F.col("tier"))


def _render(template: Column, item: Column | None = None) -> Column:
    text = F.replace(template, F.lit("{skill}"), F.col("skill"))
    return text if item is None else F.replace(text, F.lit("{item}"), item)


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _shuffled(items: Column, kind: str) -> Column:
    """Items in an order drawn per candidate, skill and kind."""
    drawn = F.transform(
        items,
        lambda x, i: F.struct(
            hash32_digits("candidate_id", "skill", F.lit(kind), i, seed=SEED).alias("h"), i.alias("i"), x.alias("x")
        ),
    )
    return F.transform(F.array_sort(drawn), lambda s: s["x"])


def candidate_skills(profiles: DataFrame) -> DataFrame:
    """The first skills of each profile with their position and the seniority tier."""
    tier = seniority_tier(F.coalesce("experience_years", F.lit(0.0)))
    first = F.slice("skills", 1, qb.MAX_SKILLS)
    return profiles.select("candidate_id", tier.alias("tier"), F.posexplode(first).alias("skill_position", "skill"))


def question_pool(profiles: DataFrame, bank: DataFrame) -> DataFrame:
    """Bank entries of every (candidate, skill); skills without an entry get the generic ones."""
    known = stage(bank, "bank")  # read once; its size decides how it is joined
    joined = candidate_skills(profiles).join(known, ["skill", "tier"], "left")
    generic = qb.GENERIC_BANK
    concepts = F.create_map(
        *[x for tier, items in generic["concepts"].items() for x in (F.lit(tier), _literals(items))]
    )
    fallback = {
        "concepts": F.element_at(concepts, F.col("tier")),
        "coding": _literals(generic["coding_patterns"]),
        "scenarios": _literals(generic["scenarios"]),
        "design": _literals(generic["design_topics"]),
    }
    return joined.withColumns(
        {name: F.coalesce(name, F.transform(items, lambda x: _render(x))) for name, items in fallback.items()}
    )


def pool_rows(pool: DataFrame) -> DataFrame:
    """The pool in long form (candidate_id, skill, kind, position, item)."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("items")) for k in ("concepts", "coding", "scenarios", "design")]
    long = pool.select("candidate_id", "skill", F.inline(F.array(*kinds)))
    return long.select("candidate_id", "skill", "kind", F.posexplode("items").alias("position", "item"))


def _typed(position: int, mix: dict[str, list[int]], items: Column, text) -> Column:
    """Question structs of one type; ``text`` maps (item, index) to the question."""
    chosen = F.slice(items, 1, _by_tier(mix, position))
    return F.transform(
        chosen,
        lambda x, i: F.struct(F.lit(position).alias("type_position"), i.alias("i"), text(x, i).alias("question"), x.alias("item")),
    )


def _of_type(values: list[Column]) -> Column:
    """The value of the row's type."""
    first, *rest = [(F.col("type_position") == k, v) for k, v in enumerate(values)]
    found = F.when(*first)
    for known, value in rest:
        found = found.when(known, value)
    return found


def generate_questions(profiles: DataFrame, bank: DataFrame, n_per_skill: int = 3) -> DataFrame:
    """Questions per candidate in emission order; a repeated question of a candidate is asked once.

    Profiles, which are narrow, are dealt out by candidate before they become questions: a table of few files keeps all tasks
    busy, and questions need no shuffle of their own. What follows from type, tier and item is added when repeats are gone.
    """
    mix = question_mix(n_per_skill)
    pool = question_pool(dealt(profiles.select("candidate_id", "skills", "experience_years"), "candidate_id"), bank).withColumns(
        {
            "concepts": _shuffled(F.col("concepts"), "conceptual"),
            "coding": _shuffled(F.col("coding"), "coding"),
            "scenarios": _shuffled(F.col("scenarios"), "scenario"),
            "design": _shuffled(F.col("design"), "system_design"),
            "behavioral": _shuffled(_literals(qb.BEHAVIORAL_FORMATS), "behavioral"),
            "concept_formats": _shuffled(_literals(qb.CONCEPT_FORMATS), "conceptual-format"),
            "coding_formats": _shuffled(_literals(qb.CODING_FORMATS), "coding-format"),
        }
    )

    def cycled(formats: str, size: int):
        return lambda x, i: _render(F.get(F.col(formats), i % size), x)

    junior_design = F.lit(qb.JUNIOR_DESIGN_FORMAT)
    asked = F.concat(
        _typed(0, mix, F.col("concepts"), cycled("concept_formats", len(qb.CONCEPT_FORMATS))),
        _typed(1, mix, F.col("coding"), cycled("coding_formats", len(qb.CODING_FORMATS))),
        _typed(2, mix, F.col("scenarios"), lambda x, i: x),
        _typed(
            3, mix, F.col("design"),
            lambda x, i: F.when(F.col("tier") == "junior", F.replace(junior_design, F.lit("{item}"), x)).otherwise(x),
        ),
        _typed(4, mix, F.col("behavioral"), lambda x, i: _render(x)),
    )
    rows = pool.select("candidate_id", "skill_position", "skill", "tier", F.inline(asked))
    # One candidate has few questions, and only equal texts of one candidate meet here.
    window = Window.partitionBy("candidate_id", "question").orderBy("skill_position", "type_position", "i")
    first = rows.withColumn("_n", F.row_number().over(window)).where("_n = 1")

    def about(formats: list[str]) -> Column:
        return _of_type([F.replace(F.lit(f), F.lit("{item}"), F.col("item")) if "{item}" in f else F.lit(f) for f in formats])

    return first.select(
        "candidate_id", "skill_position", "type_position", "i", "skill", _of_type([F.lit(t) for t in qb.TYPES]).alias("type"),
        _of_type([_by_tier(qb.DIFFICULTY, k) for k in range(len(qb.TYPES))]).alias("difficulty"), "question",
        about(qb.HINTS).alias("hint"), about(qb.FOLLOW_UPS).alias("follow_up"),
    )


def of_types(questions: DataFrame, types: list[str]) -> DataFrame:
    return questions.where(F.col("type").isin(*types))


def from_backends(questions: DataFrame, chain: Sequence[Backend], store: str | None = None, kind: str = "") -> DataFrame:
    """``questions`` worded by a chain of back-ends, with the column ``origin``: the back-end, or "bank" where none answered
    and the bank's own wording stays. A request names skill, type and difficulty and gives the bank's question; equal ones of
    all candidates are asked once, see ``backends.answered``."""
    wanted = F.concat_ws("\n", F.concat_ws(" | ", "skill", "type", "difficulty"), "question")
    found = answered(questions.withColumn("_request", wanted), chain, "_request", store, kind)
    worded = found.withColumn("question", F.coalesce("answer", "question")).withColumn("origin", F.coalesce("backend", F.lit("bank")))
    return worded.drop("_request", "answer", "backend")
