"""Features, quality score and label of candidate profiles, as column expressions on one pass over the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.config import PreprocessConfig
from screenloom.dims import domain as d
from screenloom.functions.hashing import hash_normal, hash_uniform
from screenloom.functions.scores import lookup
from screenloom.functions.text import parse_skills, strip

# Names of the features that receive noise, in order.
CORE = [
    "age", "experience_years", "experience_log", "education_level", "skill_count", "field_relevance_score",
    "title_relevance_score", "has_certification", "skill_breadth", "best_cluster_score", "skill_density",
    "edu_field_alignment",
]
LOG_PLATEAU = math.log1p(12)


def _number(column: str, when_zero: float) -> Column:
    """A number; not-a-number counts as missing, zero as the default."""
    value = F.when(~F.isnan(column), F.col(column))
    return F.when(value == 0, F.lit(when_zero)).otherwise(value)


def _lowered(values: list[str]) -> Column:
    return F.array(*[F.lit(v.lower()) for v in values])


def one_hot_name(skill: str) -> str:
    return f"skill_{skill.replace(' ', '_').lower()}"


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def with_basics(profiles: DataFrame) -> DataFrame:
    """Parsed inputs that features and score share, in columns starting with an underscore."""
    certificate = strip(F.coalesce("certifications", F.lit("")))
    parsed = profiles.withColumns(
        {
            "_skills": parse_skills(F.col("skills_text")),
            "_exp": _number("experience_years", 0.0),
            "_age": _number("age", 30.0),
            "_edu": lookup(F.col("education_level"), d.EDUCATION_LEVEL, d.EDUCATION_DEFAULT),
            "_field": lookup(F.col("field_of_study"), d.FIELD_SCORE, d.FIELD_DEFAULT),
            "_title": lookup(F.col("current_job_title"), d.TITLE_SCORE, d.TITLE_DEFAULT),
            "_cert": (~certificate.isin("None", "nan", "")).cast("double"),
        }
    )
    with_set = parsed.withColumn("_set", F.array_distinct(F.transform("_skills", lambda s: F.lower(s))))
    clusters = {
        f"cluster_{name}": F.size(F.array_intersect("_set", _lowered(members))) / F.lit(float(len(members)))
        for name, members in d.SKILL_CLUSTERS.items()
    }
    scored = with_set.withColumns(clusters)
    covered = [F.col(c) for c in clusters]
    return scored.withColumns(
        {
            "_n": F.size("_skills").cast("double"),
            "_best": F.greatest(*covered),
            "_breadth": sum([(c > 0).cast("int") for c in covered[1:]], (covered[0] > 0).cast("int")),
            "_exp_norm": F.log1p("_exp") / LOG_PLATEAU,
            "_edu_norm": (F.col("_edu") - 1) / 5.0,
            "_skill_norm": F.least(F.size("_skills") / 10.0, F.lit(1.0)),
        }
    )


def hr_score() -> Column:
    """The weights of the quality score, on the columns of ``with_basics``."""
    c = F.col
    return (
        2.60 * c("_exp_norm")
        + 2.10 * c("_edu_norm")
        + 1.60 * c("_skill_norm")
        + 1.10 * c("_cert")
        + 0.90 * c("_field")
        + 0.80 * c("_title")
        + 0.70 * c("_best")
        + 0.50 * (c("_exp_norm") * c("_edu_norm"))
        + 0.40 * (c("_skill_norm") * c("_cert"))
        + 0.30 * (c("_field") * c("_edu_norm"))
        - 0.25 * F.greatest(F.lit(0.0), (c("_age") - 45) / 5.0)
    )


def label(score: Column, key: str, cfg: PreprocessConfig) -> Column:
    """Suitable or not; labels flip at random, more often close to the threshold."""
    clean = F.coalesce((score >= cfg.hr_threshold).cast("int"), F.lit(0))
    near = F.abs(score - cfg.hr_threshold) < cfg.border_margin
    probability = F.when(near, cfg.flip_rate_base + cfg.flip_rate_border).otherwise(cfg.flip_rate_base)
    flipped = hash_uniform(key, seed=f"{cfg.random_state}-flip") < probability
    return F.when(flipped, 1 - clean).otherwise(clean)


def core_columns() -> dict[str, Column]:
    c = F.col
    return {
        "age": c("_age"),
        "experience_years": c("_exp"),
        "experience_log": F.log1p("_exp"),
        "education_level": c("_edu"),
        "skill_count": c("_n"),
        "field_relevance_score": c("_field"),
        "title_relevance_score": c("_title"),
        "has_certification": c("_cert"),
        "skill_breadth": c("_breadth").cast("double"),
        "best_cluster_score": c("_best"),
        "skill_density": c("_n") / F.when(c("_exp") < 1.0, 1.0).otherwise(c("_exp")),
        "edu_field_alignment": c("_edu_norm") * c("_field"),
    }


def interaction_columns() -> dict[str, Column]:
    c = F.col
    return {
        "exp_squared": c("_exp") * c("_exp"),
        "edu_cert_product": c("_edu") * c("_cert"),
        "exp_edu_product": c("_exp") * c("_edu"),
        "skill_cert_product": c("_n") * c("_cert"),
        "exp_field_product": c("_exp_norm") * c("_field"),
        "exp_title_product": c("_exp_norm") * c("_title"),
        "edu_title_product": c("_edu_norm") * c("_title"),
        "skill_field_product": c("_skill_norm") * c("_field"),
    }


def flag_columns() -> dict[str, Column]:
    """Skill flags compare exact spelling; unknown experience sets no flag."""
    gender, exp = F.lower("gender"), F.col("_exp")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition.cast("double"), F.lit(0.0))

    flags = {
        "gender_encoded": F.when(gender == "male", 1.0).when(gender == "female", 2.0).otherwise(0.0),
        "is_junior": flag(exp < 2),
        "is_experienced": flag(exp >= 3),
        "is_senior": flag(exp >= 7),
        "is_expert": flag(exp >= 10),
        "high_edu_flag": flag(F.col("_edu") >= 5),
        "high_skill_flag": flag(F.col("_n") >= 5),
    }
    for name, skills in d.SKILL_FLAGS.items():
        flags[name] = flag(F.arrays_overlap("_skills", F.array(*[F.lit(s) for s in skills])))
    return flags


def one_hot_columns() -> dict[str, Column]:
    return {one_hot_name(s): F.array_contains("_set", s.lower()).cast("double") for s in d.SKILL_VOCABULARY}


def cluster_columns() -> dict[str, Column]:
    return {f"cluster_{name}": F.col(f"cluster_{name}") for name in d.SKILL_CLUSTERS}


def feature_columns() -> dict[str, Column]:
    """All features in order."""
    return core_columns() | interaction_columns() | cluster_columns() | flag_columns() | one_hot_columns()


FEATURES = [
    *CORE,
    "exp_squared", "edu_cert_product", "exp_edu_product", "skill_cert_product", "exp_field_product",
    "exp_title_product", "edu_title_product", "skill_field_product",
    *[f"cluster_{name}" for name in d.SKILL_CLUSTERS],
    "gender_encoded", "is_junior", "is_experienced", "is_senior", "is_expert", "high_edu_flag", "high_skill_flag",
    *d.SKILL_FLAGS,
    *[one_hot_name(s) for s in d.SKILL_VOCABULARY],
]


def build_features(profiles: DataFrame, key: str, cfg: PreprocessConfig) -> DataFrame:
    """(key, label, hr_score, features ...)."""
    basics = with_basics(profiles).withColumn("hr_score", hr_score())
    features = [column.alias(name) for name, column in feature_columns().items()]
    return basics.select(key, label(F.col("hr_score"), key, cfg).alias("label"), "hr_score", *features)


def noisy(columns: list[str], key: str, cfg: PreprocessConfig) -> dict[str, Column]:
    """Gaussian noise on the core features among ``columns``."""
    return {
        c: quoted(c) + cfg.noise_std * hash_normal(key, seed=f"{cfg.random_state}-{c}")
        for c in columns
        if c in CORE
    }
