"""Score formulas and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenloom.functions.text import strip

# Score weights and limits.
COVERAGE_WEIGHT, KEYWORD_WEIGHT, BREADTH_WEIGHT, EXPERIENCE_WEIGHT = 0.55, 0.10, 0.10, 0.25
BREADTH_STEP, BREADTH_CAP = 0.04, 0.20
EXPERIENCE_BASE, EXPERIENCE_STEP, EXPERIENCE_SHORTFALL = 0.7, 0.06, 0.5


def rounded(value: Column, digits: int = 4) -> Column:
    """Round half up with plain double arithmetic, which any engine repeats exactly."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def jd_coverage(matched: Column, wanted: Column, when_empty: float = 0.0) -> Column:
    return F.when(wanted == 0, F.lit(when_empty)).otherwise(rounded(matched / wanted))


def breadth_bonus(extra: Column) -> Column:
    return F.least(F.lit(BREADTH_CAP), rounded(extra * BREADTH_STEP))


def keyword_similarity(matched: Column, wanted: Column) -> Column:
    return F.when(wanted == 0, F.lit(0.0)).otherwise(matched / wanted)


def experience_score(years: Column, required: Column) -> Column:
    above = F.least(F.lit(1.0), EXPERIENCE_BASE + EXPERIENCE_STEP * (years - required))
    below = F.greatest(F.lit(0.0), EXPERIENCE_SHORTFALL * years / required)
    return F.when(required == 0, F.lit(EXPERIENCE_BASE)).when(years >= required, above).otherwise(below)


def match_score(coverage: Column, keyword: Column, breadth: Column, experience: Column) -> Column:
    return rounded(
        COVERAGE_WEIGHT * coverage
        + KEYWORD_WEIGHT * keyword
        + BREADTH_WEIGHT * breadth
        + EXPERIENCE_WEIGHT * experience
    )


def score_badge(score: Column) -> Column:
    return (
        F.when(score >= 0.75, "🟢 Excellent")
        .when(score >= 0.50, "🟡 Good")
        .when(score >= 0.30, "🟠 Fair")
        .otherwise("🔴 Poor")
    )


def percent(score: Column) -> Column:
    """Whole percent, cut off."""
    return (score * 100).cast("int")


def percent_badge(score: Column) -> Column:
    pct = percent(score)
    return F.when(pct >= 75, "Excellent").when(pct >= 55, "Good").when(pct >= 35, "Fair").otherwise("Poor")


def label_of(key: Column, labels: dict[str, str]) -> Column:
    """Look a label up; unknown keys pass through."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)


def lookup(key: Column, scores: dict[str, float], default: float) -> Column:
    """Score of a trimmed key, with a default."""
    pairs = [F.lit(x) for k, v in scores.items() for x in (k, float(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), strip(key)), F.lit(float(default)))


def safe_json(text: Column, schema: str) -> Column:
    """Parse JSON; null where it cannot be parsed."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def pretty_json(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})
