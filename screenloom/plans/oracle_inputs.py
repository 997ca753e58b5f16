"""SQL of the same inputs for the checking engine."""

from __future__ import annotations

import re

from screenloom.dims.domain import SKILL_VOCABULARY
from screenloom.dims.taxonomy import STARTER_TAXONOMY
from screenloom.plans import fixtures as fx


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def r(expr: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


def skill_list(k: str) -> str:
    return (
        f"CASE WHEN {k}*5%11 > 0 THEN array_to_string(list_transform(range({k}*5%11), "
        f"lambda i: ({items(SKILL_VOCABULARY)})[({k}*3+i*7)%40+1]), ', ') END"
    )


def norm(text: str) -> str:
    """Normalisation by protecting tokens, cleaning, and restoring them."""
    t = f"lower({text})"
    tokens = [("c++", "__CPP__"), ("c#", "__CSH__"), (".net", "__NET__"), ("f#", "__FSH__")]
    for raw, mark in tokens:
        t = f"replace({t}, '{raw}', '{mark}')"
    t = rf"regexp_replace({t}, 'https?://\S+|www\.\S+', ' ', 'g')"
    t = rf"regexp_replace({t}, '[•·|/\\]', ' ', 'g')"
    t = rf"regexp_replace({t}, '''s\b', '', 'g')"
    t = rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"
    for raw, mark in tokens:
        t = f"replace({t}, '{mark}', '{raw}')"
    return t


def starter_variants() -> list[tuple[str, str]]:
    """(variant, canonical) of the starter taxonomy, first owner wins."""
    latest: dict[str, list[str]] = {}
    for skills in STARTER_TAXONOMY.values():
        for canonical, aliases in skills.items():
            latest[canonical] = aliases
    owners: dict[str, str] = {}
    for canonical, aliases in latest.items():
        for variant in [canonical, *aliases]:
            owners.setdefault(variant.lower(), canonical)
    return list(owners.items())


def _variants_sql() -> str:
    rows = ", ".join(
        f"({lit(v)}, {lit('(^|[^a-z0-9_])' + re.escape(v) + '($|[^a-z0-9_])')}, {lit(c)})"
        for v, c in starter_variants()
    )
    return f"SELECT * FROM (VALUES {rows}) t(variant, pattern, canonical)"


def _entries_sql() -> str:
    flat = [(c, s, a) for c, skills in STARTER_TAXONOMY.items() for s, a in skills.items()]
    rows = ", ".join(
        f"({i}::BIGINT, {lit(c)}, {lit(s)}, {items(a)}::VARCHAR[])" for i, (c, s, a) in enumerate(flat)
    )
    return f"SELECT * FROM (VALUES {rows}) t(ord, category, canonical, aliases)"


def hits_sql(source: str, id_column: str, text: str) -> str:
    """Plain words meet the distinct words of a text; only other variants are searched in it."""
    normal = f"(SELECT {id_column}, {norm(text)} AS t FROM {source})"
    return f"""
 SELECT DISTINCT {id_column}, canonical FROM (
  SELECT n.{id_column}, v.canonical FROM (
   SELECT {id_column}, unnest(list_distinct(regexp_extract_all(t, '[a-z0-9_]+'))) AS w FROM {normal}) n
  JOIN variants v ON v.variant = n.w
  UNION ALL
  SELECT n.{id_column}, v.canonical FROM {normal} n JOIN variants v
  ON NOT regexp_full_match(v.variant, '[a-z0-9_]+') AND contains(n.t, v.variant) AND regexp_matches(n.t, v.pattern))"""


CAND = f"""
 SELECT k::VARCHAR AS candidate_id, k AS ord, c_name AS name,
  CASE WHEN k%97 <> 0 THEN (21 + k*7%45)::DOUBLE END AS age,
  (['Male','Female','Other'])[k%3+1] AS gender,
  ({items(fx.EDUCATION)})[k%7+1] AS education_level,
  ({items(fx.FIELDS)})[k%17+1] AS field_of_study,
  (k*13%41)::DOUBLE / 2 AS experience_years,
  coalesce({skill_list('k')}, CASE WHEN k%2=1 THEN 'None' END) AS skills_text,
  CASE k%4 WHEN 0 THEN NULL WHEN 1 THEN 'None' ELSE 'AWS Certified' END AS certifications,
  ({items(fx.TITLES)})[k%16+1] AS current_job_title,
  'Seeking ' || ({items(fx.TITLES)})[k%16+1] || ' role' AS target_job_description
 FROM (SELECT c_custkey AS k, c_name FROM customer)"""

RESUME = """
 SELECT candidate_id, ord, name, experience_years, 'Name: ' || name || '. Education: ' || education_level || ' in '
  || field_of_study || '. Experience: ' || experience_years::VARCHAR || ' years. Current role: ' || current_job_title
  || '. Skills: ' || coalesce(skills_text, '') || '. Certifications: ' || coalesce(certifications, '')
  || '. Objective: ' || target_job_description AS resume_text
 FROM cand"""

_CLAUSE = items(fx.CLAUSES)
_WANTED = " || ', ' || ".join(f"({items(SKILL_VOCABULARY)})[(k*5+{i * 11})%40+1]" for i in range(4))
JD = f"""
 SELECT k::VARCHAR AS jd_id, CASE k WHEN 23 THEN '   ' WHEN 24 THEN 'Friendly people wanted.' ELSE
  'Looking for a ' || ({items(fx.TITLES)})[k%16+1] || ' with ' || {_WANTED} || '. ' ||
  replace(({_CLAUSE})[k%5+1], '{{r}}', (k%6+1)::VARCHAR || CASE WHEN k%4=3 THEN '.5' ELSE '' END) END AS jd_text
 FROM (SELECT n_nationkey::BIGINT AS k FROM nation)"""

DOCS = f"""
 SELECT doc_id, ({items(fx.RESUME_HEADS)})[doc_id%4+1] || text || ' Skills: ' ||
  coalesce({skill_list('doc_id')}, '') || CASE WHEN doc_id%10=0 THEN {lit(fx.RESUME_EXTRAS)} ELSE '' END AS text
 FROM documents"""

_REQ = [
    r"([0-9]+(?:\.[0-9]+)?)\+?\s*years?\s*of\s*experience",
    r"minimum\s+([0-9]+(?:\.[0-9]+)?)\s+years?",
    r"at\s+least\s+([0-9]+(?:\.[0-9]+)?)\s+years?",
    r"([0-9]+(?:\.[0-9]+)?)\+?\s*years?\s*(?:of\s*)?(?:work|professional|industry|relevant)",
]
REQUIRED = "coalesce({}, 0.0)".format(
    ", ".join(f"TRY_CAST(nullif(regexp_extract(lower(jd_text), '{p}', 1), '') AS DOUBLE)" for p in _REQ)
)

SCORED = f"""
 SELECT a.jd_id, a.candidate_id, c.ord, c.name, c.experience_years, j.required_years, j.n_jd,
  coalesce(cs.skills, []) AS skills, j.jd_skills,
  len(list_intersect(coalesce(cs.skills, []), j.jd_skills)) AS matched,
  len(coalesce(cs.skills, [])) AS n_skills
 FROM applications a JOIN (
  SELECT jd.jd_id, {REQUIRED} AS required_years, count(*) AS n_jd, list(canonical ORDER BY canonical) AS jd_skills
  FROM jd JOIN jd_hits USING (jd_id) GROUP BY jd.jd_id, jd.jd_text) j USING (jd_id)
 JOIN resume c USING (candidate_id)
 LEFT JOIN (SELECT candidate_id, list(canonical ORDER BY canonical) AS skills FROM cand_hits GROUP BY 1) cs
  USING (candidate_id)"""

SCORES = f"""
 SELECT *, {r('0.55*jd_coverage + 0.1*keyword_sim + 0.1*breadth_bonus + 0.25*experience_score', 4)} AS match_score
 FROM (SELECT *, {r('matched::DOUBLE / n_jd', 4)} AS jd_coverage, matched::DOUBLE / n_jd AS keyword_sim,
  least(0.2::DOUBLE, {r('(n_skills - matched) * 0.04::DOUBLE', 4)}) AS breadth_bonus,
  CASE WHEN required_years = 0 THEN 0.7::DOUBLE
   WHEN experience_years >= required_years
    THEN least(1.0::DOUBLE, 0.7::DOUBLE + 0.06::DOUBLE * (experience_years - required_years))
   ELSE greatest(0.0::DOUBLE, 0.5::DOUBLE * experience_years / required_years) END AS experience_score
  FROM scored_pairs)"""

RANKED = "SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY match_score DESC, ord) AS rank FROM scores"

_STAGE_CASE = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fx.EVENT_STAGE.items())
PEV = f"""
 SELECT user_id::VARCHAR AS candidate_id, event_id, ts, CASE event_type {_STAGE_CASE} END AS new_state,
  event_id%50 = 0 AS forced FROM events"""

PREDICTIONS = """
 SELECT l.doc_id, 'model_' || m AS model, l.quality AS y, (d.n_chars*m%1000)/1000.0::DOUBLE AS score,
  CASE WHEN (d.n_chars*m%1000)/1000.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS yhat
 FROM labels l JOIN documents d USING (doc_id), (SELECT unnest([37,53,71]) AS m)"""

APPLICATIONS = f"""
 SELECT DISTINCT o_custkey::VARCHAR AS candidate_id, (o_orderkey%{fx.JOBS})::VARCHAR AS jd_id FROM orders"""

PART_ENTRIES = """
 SELECT p_partkey AS ord, p_type AS category, p_name AS canonical,
  [p_brand, p_name || ' ' || p_size::VARCHAR] AS aliases FROM part"""

PROFILE = """
 SELECT candidate_id, ord, name, experience_years, CASE WHEN skills_text IS NULL OR skills_text = 'None'
  THEN [] ELSE list_transform(string_split(skills_text, ','), lambda x: trim(x)) END AS skills FROM cand"""

CTES = {
    "cand": CAND,
    "resume": RESUME,
    "profile": PROFILE,
    "jd": JD,
    "docs": DOCS,
    "applications": APPLICATIONS,
    "variants": _variants_sql(),
    "entries": _entries_sql(),
    "part_entries": PART_ENTRIES,
    "cand_hits": hits_sql("resume", "candidate_id", "resume_text"),
    "jd_hits": hits_sql("jd", "jd_id", "jd_text"),
    "doc_hits": hits_sql("docs", "doc_id", "text"),
    "scored_pairs": SCORED,
    "scores": SCORES,
    "ranked": RANKED,
    "pev": PEV,
    "predictions": PREDICTIONS,
}
NEEDS = {
    "resume": ["cand"],
    "profile": ["cand"],
    "cand_hits": ["resume", "variants"],
    "jd_hits": ["jd", "variants"],
    "doc_hits": ["docs", "variants"],
    "scored_pairs": ["applications", "jd_hits", "cand_hits"],
    "scores": ["scored_pairs"],
    "ranked": ["scores"],
}


def with_inputs(inputs: str, body: str, more: dict[str, str] | None = None) -> str:
    """``body`` preceded by the named inputs and what they need, then by ``more`` definitions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in inputs.split():
        add(name)
    definitions = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered]
    definitions += [f"{n} AS MATERIALIZED ({sql})" for n, sql in (more or {}).items()]
    return ("WITH " + ",\n".join(definitions) + "\n" if definitions else "") + body
