"""Queries on interview questions and the whole screening run."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from screenloom.dims import question_bank as qb
from screenloom.operators import questions as qs
from screenloom.operators import reports as rp
from screenloom.operators import screening as sg
from screenloom.operators.backends import Backend
from screenloom.plans import fixtures as fx
from screenloom.plans.hiring import current_states, jd_schedule
from screenloom.plans.oracle_inputs import CTES, NEEDS, items, lit, with_inputs
from screenloom.plans.registry import query
from screenloom.plans.screening import ranked
from screenloom.sources.question_bank import starter_bank

N_PER_SKILL = 3

# ---- checking SQL ----------------------------------------------------------------------------------------------


def _bank_rows() -> str:
    """VALUES of (skill, kind, tier, position, item); kind * marks the generic bank."""
    rows = []
    banks = {**qb.STARTER_BANK, "*": qb.GENERIC_BANK}
    for skill, topic in banks.items():
        for tier in qb.TIERS:
            lists = {
                "concepts": topic["concepts"][tier],
                "coding": topic["coding_patterns"],
                "scenarios": topic["scenarios"],
                "design": topic["design_topics"],
            }
            for kind, entries in lists.items():
                rows += [f"({lit(skill)}, {lit(kind)}, {lit(tier)}, {i}, {lit(x)})" for i, x in enumerate(entries)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(bank_skill, kind, tier, position, item)"


def _mix_rows() -> str:
    rows = []
    for tier, weights in qb.MIX.items():
        for i, w in enumerate(weights):
            n = f"greatest(0, round_even({w} * ({N_PER_SKILL} / {sum(weights)}), 0))::INTEGER"
            rows.append(f"({lit(tier)}, {lit(qb.TYPES[i])}, {i}, {n}, {lit(qb.DIFFICULTY[tier][i])})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(tier, type, type_position, n, difficulty)"


_HASH = "('0x' || substr(md5(candidate_id || '|' || skill || '|{kind}|' || {i} || '|42'), 1, 8))::BIGINT"
_KIND_TYPE = (
    "CASE kind WHEN 'concepts' THEN 'conceptual' WHEN 'coding' THEN 'coding' WHEN 'scenarios' THEN 'scenario' "
    "ELSE 'system_design' END"
)


def _formats(name: str, values: list[str]) -> str:
    """Formats in the drawn order of each (candidate, skill)."""
    order = _HASH.format(kind=name, i="f.i")
    return f"""SELECT candidate_id, skill, f.t AS format, row_number() OVER (PARTITION BY candidate_id, skill
  ORDER BY {order}, f.i) - 1 AS place FROM cskills, (SELECT unnest({items(values)}) AS t,
  unnest(range({len(values)})) AS i) f"""


_ITEM_ORDER = "('0x' || substr(md5(candidate_id || '|' || skill || '|' || type || '|' || position || '|42'), 1, 8))::BIGINT"
CTES |= {
    "cskills": """SELECT DISTINCT candidate_id, tier, unnest(skills[1:8]) AS skill,
  generate_subscripts(skills[1:8], 1) - 1 AS skill_position FROM (SELECT candidate_id, skills,
  CASE WHEN experience_years < 2 THEN 'junior' WHEN experience_years < 5 THEN 'mid' ELSE 'senior' END AS tier
  FROM profile)""",
    "bank": _bank_rows(),
    "mix": _mix_rows(),
    "pool": """SELECT c.candidate_id, c.tier, c.skill, c.skill_position, b.kind, b.position,
  replace(b.item, '{skill}', CASE WHEN b.bank_skill = '*' THEN c.skill ELSE '{skill}' END) AS item
 FROM cskills c JOIN bank b ON b.tier = c.tier AND b.bank_skill = CASE WHEN c.skill IN (SELECT bank_skill FROM bank)
  THEN c.skill ELSE '*' END""",
    "placed": f"""SELECT *, row_number() OVER (PARTITION BY candidate_id, skill, kind ORDER BY {_ITEM_ORDER}, position) - 1
  AS place FROM (SELECT *, {_KIND_TYPE} AS type FROM pool)""",
    "concept_formats": _formats("conceptual-format", qb.CONCEPT_FORMATS),
    "coding_formats": _formats("coding-format", qb.CODING_FORMATS),
    "behavioral": _formats("behavioral", qb.BEHAVIORAL_FORMATS),
    "asked": f"""SELECT p.candidate_id, p.skill, p.skill_position, m.type, m.type_position, m.difficulty, p.place AS i,
  p.item, CASE p.type WHEN 'conceptual' THEN replace(replace(cf.format, '{{skill}}', p.skill), '{{item}}', p.item)
   WHEN 'coding' THEN replace(replace(df.format, '{{skill}}', p.skill), '{{item}}', p.item)
   WHEN 'system_design' THEN CASE WHEN p.tier = 'junior' THEN replace({lit(qb.JUNIOR_DESIGN_FORMAT)}, '{{item}}', p.item)
    ELSE p.item END ELSE p.item END AS question
 FROM placed p JOIN mix m ON m.tier = p.tier AND m.type = p.type AND p.place < m.n
 LEFT JOIN concept_formats cf ON cf.candidate_id = p.candidate_id AND cf.skill = p.skill AND cf.place = p.place%7
 LEFT JOIN coding_formats df ON df.candidate_id = p.candidate_id AND df.skill = p.skill AND df.place = p.place%5
 UNION ALL
 SELECT b.candidate_id, b.skill, c.skill_position, m.type, m.type_position, m.difficulty, b.place,
  replace(b.format, '{{skill}}', b.skill), replace(b.format, '{{skill}}', b.skill)
 FROM behavioral b JOIN cskills c USING (candidate_id, skill) JOIN mix m ON m.tier = c.tier AND m.type = 'behavioral'
 WHERE b.place < m.n""",
    "questions": f"""SELECT candidate_id, skill_position, type_position, i, skill, type, difficulty, question,
  replace(({items(qb.HINTS)})[type_position+1], '{{item}}', item) AS hint,
  replace(({items(qb.FOLLOW_UPS)})[type_position+1], '{{item}}', item) AS follow_up
 FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, question ORDER BY skill_position, type_position, i)
  AS rn FROM asked) WHERE rn = 1""",
}
NEEDS |= {
    "cskills": ["profile"],
    "pool": ["cskills", "bank"],
    "placed": ["pool"],
    "concept_formats": ["cskills"],
    "coding_formats": ["cskills"],
    "behavioral": ["cskills"],
    "asked": ["placed", "mix", "concept_formats", "coding_formats", "behavioral"],
    "questions": ["asked"],
}


def questions(spark, d):
    return qs.generate_questions(fx.profiles(spark, d), starter_bank(spark), N_PER_SKILL)


@query(
    "question_pool",
    with_inputs("pool", "SELECT candidate_id, skill, kind, position, item FROM pool"),
)
def question_pool(spark, d):
    return qs.pool_rows(qs.question_pool(fx.profiles(spark, d), starter_bank(spark)))


_QUESTION = "candidate_id, skill_position, type_position, i, skill, type, difficulty, question, hint, follow_up"


@query("questions", with_inputs("questions", f"SELECT {_QUESTION} FROM questions"))
def all_questions(spark, d):
    return questions(spark, d)


def _rephrased(requests: pa.Array) -> pa.Array:
    """Words coding questions anew, and knows nothing of others."""
    return pa.array([f"Write code: {r.split(chr(10), 1)[1]}" if " | coding | " in r else None for r in requests.to_pylist()], pa.string())


def _shortened(requests: pa.Array) -> pa.Array:
    """Fails on every batch with a question on design, as a service that is down does."""
    if any(" | system_design | " in r for r in requests.to_pylist()):
        raise ConnectionError("no answer")
    return pa.array([None] * len(requests), pa.string())


@query(
    "backend_questions",
    with_inputs(
        "questions",
        """SELECT candidate_id, skill, type, i, CASE WHEN type = 'coding' THEN 'Write code: ' || question ELSE question END AS question,
            CASE WHEN type = 'coding' THEN 'rephrased' ELSE 'bank' END AS origin FROM questions""",
    ),
)
def backend_questions(spark, d):
    """All questions through a chain of two back-ends, the first of which fails; the bank answers what both leave open."""
    chain = [Backend("shortened", _shortened), Backend("rephrased", _rephrased)]
    found = qs.from_backends(questions(spark, d), chain)
    return found.select("candidate_id", "skill", "type", "i", "question", "origin")


@query(
    "questions_by_type",
    with_inputs(
        "questions",
        "SELECT candidate_id, skill, type, question FROM questions WHERE type IN ('conceptual', 'scenario')",
    ),
)
def questions_by_type(spark, d):
    shown = qs.of_types(questions(spark, d), ["conceptual", "scenario"])
    return shown.select("candidate_id", "skill", "type", "question")


@query(
    "question_mix",
    with_inputs(
        "cskills mix",
        """SELECT candidate_id, type, sum(n)::BIGINT AS wanted FROM cskills JOIN mix USING (tier)
 GROUP BY 1, 2""",
    ),
)
def question_mix(spark, d):
    """Questions wanted per candidate and type, before repeated ones are dropped."""
    mix = qs.question_mix(N_PER_SKILL)
    counts = F.create_map(
        *[x for tier, row in mix.items() for x in (F.lit(tier), F.array(*[F.lit(n) for n in row]))]
    )
    wanted = qs.candidate_skills(fx.profiles(spark, d)).select(
        "candidate_id", F.posexplode(F.element_at(counts, F.col("tier"))).alias("t", "n")
    )
    named = wanted.select("candidate_id", fx.pick(qb.TYPES, F.col("t")).alias("type"), "n")
    return named.groupBy("candidate_id", "type").agg(F.sum("n").alias("wanted"))


@query(
    "kpis",
    with_inputs(
        "schedule questions",
        """SELECT 'Candidates Ranked' AS kpi, (SELECT count(*) FROM ranked) AS value
 UNION ALL SELECT 'Interviews Scheduled', (SELECT count(*) FROM schedule WHERE NOT conflict)
 UNION ALL SELECT 'Questions Generated', (SELECT count(*) FROM questions)""",
    ),
)
def kpis(spark, d):
    ranking = ranked(spark, d)
    scheduled = jd_schedule(spark, d, ranking).where(~F.col("conflict"))
    tables = {"Candidates Ranked": ranking, "Interviews Scheduled": scheduled, "Questions Generated": questions(spark, d)}
    return rp.kpis(tables)


_FULL = {
    "top5": """SELECT k.jd_id, k.candidate_id, k.rank, strftime(s.slot, '%Y-%m-%d %H:%M') AS slot FROM ranked k
  JOIN numbered_slots s ON s.calendar_id = k.jd_id AND s.position = k.rank WHERE k.rank <= 5""",
}


@query(
    "full_screening",
    with_inputs(
        "ranked numbered_slots states",
        """SELECT k.jd_id, k.candidate_id, k.rank, t.slot, CASE WHEN t.slot IS NOT NULL THEN 'interview_scheduled'
  WHEN s.state IS NULL OR s.state IN ('applied', 'shortlisted') THEN 'rejected' ELSE s.state END AS state
 FROM ranked k LEFT JOIN top5 t USING (jd_id, candidate_id) LEFT JOIN states s ON s.candidate_id = k.candidate_id""",
        _FULL,
    ),
)
def full_screening(spark, d):
    """Rank, schedule the best five of each job, and move everyone's stage."""
    run = sg.run(
        ranked(spark, d), fx.jobs(spark, d), current_states(spark, d), fx.AS_OF, starter_bank(spark)
    )
    return run.states.select("jd_id", "candidate_id", "rank", "slot", "state")



_LEADERS = {
    "profile": "SELECT jd_id || '/' || candidate_id AS candidate_id, experience_years, skills FROM ranked WHERE rank = 1",
} | {
    name: CTES[name]
    for name in (
        "cskills", "bank", "mix", "pool", "placed", "concept_formats", "coding_formats", "behavioral", "asked", "questions",
    )
}


@query("full_screening_questions", with_inputs("ranked", f"SELECT {_QUESTION} FROM questions", _LEADERS))
def full_screening_questions(spark, d):
    """What the best candidate of each job is asked at the end of the full run."""
    run = sg.run(
        ranked(spark, d), fx.jobs(spark, d), current_states(spark, d), fx.AS_OF, starter_bank(spark)
    )
    return run.questions.select(*_QUESTION.split(", "))
