"""Queries on skill extraction, scoring and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.functions import scores as s
from screenloom.functions import text as t
from screenloom.operators import ranking as rk
from screenloom.operators.reports import write_report
from screenloom.operators import skills as sk
from screenloom.plans import fixtures as fx
from screenloom.plans.oracle_inputs import norm, r, with_inputs
from screenloom.plans.registry import query
from screenloom.session import new_path
from screenloom.sources import candidates as src
from screenloom.sources.taxonomy import read_taxonomy, write_taxonomy

def starter_matcher(spark: SparkSession) -> sk.Matcher:
    return sk.Matcher.build(sk.starter_entries(spark))


def joined(column: str) -> F.Column:
    return F.array_join(column, "|")


def scored(spark: SparkSession, d: str) -> DataFrame:
    matcher = starter_matcher(spark)
    people = matcher.skills(fx.resumes(spark, d), "resume_text").drop("resume_text")
    return rk.score_applications(people, rk.job_skills(fx.jobs(spark, d), matcher), fx.applications(spark, d))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return rk.rank_candidates(
        fx.resumes(spark, d), fx.jobs(spark, d), fx.applications(spark, d), starter_matcher(spark)
    )


# ---- sources ---------------------------------------------------------------------------------------------------

PROFILE_COLUMNS = (
    "candidate_id, name, age, gender, education_level, field_of_study, experience_years, skills_text, "
    "certifications, current_job_title, target_job_description"
)


@query("scan_candidates", with_inputs("cand", f"SELECT {PROFILE_COLUMNS} FROM cand"))
def scan_candidates(spark, d):
    """All candidates, written as CSV files and read back."""
    names = {new: old for old, new in src.PROFILE_NAMES.items()} | {"candidate_id": "Candidate_ID"}
    people = fx.candidates(spark, d)
    sheet = people.select(*[F.col(new).alias(old) for new, old in names.items()]).repartition(3)
    # the reader expects the columns of its schema in order, the id last
    path = write_report({"people": sheet}, new_path(spark, "profiles"))["people"]
    return src.read_profiles(spark, path, id_column="Candidate_ID").select(*PROFILE_COLUMNS.split(", "))


@query(
    "sample_candidates",
    with_inputs(
        "cand",
        "SELECT candidate_id, name FROM cand ORDER BY ('0x' || substr(md5(candidate_id || '|42'), 1, 8))::BIGINT, "
        "candidate_id LIMIT 50",
    ),
)
def sample_candidates(spark, d):
    return src.seeded_sample(fx.candidates(spark, d), "candidate_id", 50, 42).select("candidate_id", "name")


@query("build_resume_text", with_inputs("resume", "SELECT candidate_id, name, resume_text FROM resume"))
def build_resume_text(spark, d):
    return fx.resumes(spark, d).select("candidate_id", "name", "resume_text")


_H = "('0x' || substr(md5(c_custkey::VARCHAR || '|{}'), 1, 8))::BIGINT"


@query(
    "demo_candidates",
    f"""WITH b AS (SELECT c_custkey, (['Priya Sharma','Arjun Mehta','Neha Gupta','Rahul Das','Zara Khan','Dev Patel',
  'Ananya Singh','Kiran Rao','Aditya Verma','Meera Nair'])[c_custkey%10+1] AS name,
  (['Python Machine Learning Deep Learning TensorFlow Docker AWS CI/CD',
  'JavaScript React Node.js REST APIs MongoDB Agile','SQL Data Analysis Power BI Statistics Python R',
  'Java Spring Boot Microservices Docker Kubernetes Jenkins',
  'Cybersecurity Network Security Linux Ansible Terraform'])[{_H.format('42-skills')}%5+1] AS bundle,
  {_H.format('42-text')}%10+1 AS text_years, {_H.format('42-years')}%10+1 AS experience_years FROM customer)
 SELECT (c_custkey+1)::VARCHAR AS candidate_id, name, bundle || ' ' || text_years || ' years experience' AS resume_text,
  experience_years::DOUBLE AS experience_years FROM b""",
)
def demo_candidates(spark, d):
    ids = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("position"))
    return src.demo_rows(ids, seed=42)


@query(
    "ingest_documents",
    "SELECT 'PDF_' || doc_id::VARCHAR AS candidate_id, text AS resume_text, 'pdf_upload' AS source "
    "FROM documents WHERE trim(text) <> ''",
)
def ingest_documents(spark, d):
    texts = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"), "text")
    return src.as_uploads(texts).select("candidate_id", "resume_text", "source")


# ---- text functions --------------------------------------------------------------------------------------------


@query("normalize_text", with_inputs("docs", f"SELECT doc_id, {norm('text')} AS normalized FROM docs"))
def normalize(spark, d):
    return fx.documents(spark, d).select("doc_id", t.normalize_text(F.col("text")).alias("normalized"))


@query(
    "parse_skills",
    with_inputs(
        "profile",
        "SELECT candidate_id, len(skills) AS n_skills, array_to_string(skills, '|') AS skills FROM profile",
    ),
)
def parse(spark, d):
    return fx.profiles(spark, d).select(
        "candidate_id", F.size("skills").cast("long").alias("n_skills"), joined("skills").alias("skills")
    )


_LINE = r"^[A-Z][a-z]+(\s+[A-Z][a-z]+){1,3}$"


@query(
    "guess_name",
    with_inputs(
        "docs",
        rf"""SELECT doc_id, coalesce(
  nullif(trim(regexp_extract(text, '(?i)name\s*[:\-]?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{1,3}})', 1)), ''),
  list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)),
   lambda l: regexp_matches(l, '{_LINE}'))[1], 'Unknown Candidate') AS name FROM docs""",
    ),
)
def names(spark, d):
    return fx.documents(spark, d).select("doc_id", t.guess_name(F.col("text")).alias("name"))


_N = r"([0-9]+(?:\.[0-9]+)?)"


@query(
    "guess_experience",
    with_inputs(
        "docs",
        rf"""SELECT doc_id, coalesce(
  TRY_CAST(nullif(regexp_extract(text, '(?i){_N}\+?\s*years?\s*of\s*experience', 1), '') AS DOUBLE),
  TRY_CAST(nullif(regexp_extract(text, '(?i)experience\s*[:\-]?\s*{_N}\+?\s*years?', 1), '') AS DOUBLE),
  TRY_CAST(nullif(regexp_extract(text, '(?i){_N}\s*years?\s*(?:work|professional|industry)', 1), '') AS DOUBLE),
  0.0) AS years FROM docs""",
    ),
)
def experience(spark, d):
    return fx.documents(spark, d).select("doc_id", t.guess_experience(F.col("text")).alias("years"))


_REQUIRED = with_inputs(
    "applications jd scored_pairs", "SELECT DISTINCT jd_id, candidate_id, required_years FROM scored_pairs"
)


@query("required_experience", _REQUIRED)
def required(spark, d):
    return scored(spark, d).select("jd_id", "candidate_id", "required_years")


@query(
    "experience_score",
    with_inputs("scores", f"SELECT jd_id, candidate_id, {r('experience_score')} AS experience_score FROM scores"),
)
def exp_score(spark, d):
    return scored(spark, d).select(
        "jd_id", "candidate_id", s.rounded(F.col("experience_score"), 6).alias("experience_score")
    )


@query(
    "seniority_tier",
    with_inputs(
        "cand",
        "SELECT candidate_id, CASE WHEN experience_years < 2 THEN 'junior' WHEN experience_years < 5 THEN 'mid' "
        "ELSE 'senior' END AS tier FROM cand",
    ),
)
def tier(spark, d):
    years = F.coalesce("experience_years", F.lit(0.0))
    return fx.candidates(spark, d).select("candidate_id", t.seniority_tier(years).alias("tier"))


# ---- skills ----------------------------------------------------------------------------------------------------

_SKILLS = """SELECT {id}, coalesce(string_agg(canonical, '|' ORDER BY canonical), '') AS skills
 FROM {src} LEFT JOIN {hits} USING ({id}) GROUP BY {id}"""


@query("extract_skills", with_inputs("docs doc_hits", _SKILLS.format(id="doc_id", src="docs", hits="doc_hits")))
def extract(spark, d):
    found = starter_matcher(spark).skills(fx.documents(spark, d), "text")
    return found.select("doc_id", joined("skills").alias("skills"))


@query(
    "extract_skills_joined", with_inputs("docs doc_hits", _SKILLS.format(id="doc_id", src="docs", hits="doc_hits"))
)
def extract_joined(spark, d):
    """The same with the variants in many blocks, as a taxonomy of any size is matched."""
    matcher = sk.Matcher.build(sk.starter_entries(spark), block_variants=100)
    found = matcher.skills(fx.documents(spark, d), "text")
    return found.select("doc_id", joined("skills").alias("skills"))


# Three sources: the starter values, a file made from the part catalogue, and entries added at run time.
_MERGED = {
    "part_file": "SELECT category, canonical, arg_max(aliases, ord) AS aliases, min(ord) AS ord FROM part_entries GROUP BY 1, 2",
    "part_first": "SELECT *, min(ord) OVER (PARTITION BY category) AS first_ord FROM part_file",
    "part_places": "SELECT *, row_number() OVER (ORDER BY first_ord, ord) AS place FROM part_first",
    "merged": "SELECT 0 AS src, ord, category, canonical, aliases FROM entries UNION ALL "
    "SELECT 1, place, category, canonical, aliases FROM part_places UNION ALL "
    "SELECT 2, n_nationkey, 'Places', n_name, ['py', lower(n_name) || ' office'] FROM nation",
    "numbered": "SELECT row_number() OVER (ORDER BY src, ord) AS n, category, canonical, aliases FROM merged",
    "names": """SELECT lower(canonical) AS key, arg_max(canonical, n) AS canonical, arg_max(category, n) AS category,
  arg_max(aliases, n) AS aliases, min(n) AS first FROM numbered GROUP BY 1""",
    "alias_owner": """SELECT alias, arg_min(canonical, (n, pos)) AS canonical FROM (
  SELECT n, canonical, lower(trim(unnest(aliases))) AS alias, generate_subscripts(aliases, 1) AS pos FROM numbered)
  WHERE alias <> '' GROUP BY 1""",
    "owners": """SELECT variant, canonical FROM (SELECT variant, canonical, row_number() OVER (PARTITION BY variant
  ORDER BY first, pos) AS rn FROM (SELECT canonical, first, lower(unnest(vs)) AS variant,
  generate_subscripts(vs, 1) AS pos FROM (SELECT canonical, first, [canonical] || aliases AS vs FROM names)))
 WHERE rn = 1""",
}


def merged_entries(spark, d):
    path = new_path(spark, "taxonomy")
    write_taxonomy(fx.part_entries(spark, d), path)
    nation = fx.table(spark, d, "nation").select(
        F.array(F.col("n_nationkey").cast("long")).alias("ord"),
        F.lit("Places").alias("category"),
        F.col("n_name").alias("canonical"),
        F.array(F.lit("py"), F.concat(F.lower("n_name"), F.lit(" office"))).alias("aliases"),
    )
    return sk.merge_entries(sk.starter_entries(spark), read_taxonomy(spark, path), nation)


@query(
    "extract_skills_part",
    with_inputs(
        "entries part_entries",
        f"""SELECT id, coalesce(string_agg(DISTINCT canonical, '|' ORDER BY canonical), '') AS skills FROM (
  SELECT id, {norm('text')} AS t FROM (SELECT p_partkey AS id,
   'Wanted: ' || p_name || ' ' || p_size::VARCHAR || ' or ' || p_brand || ' with python3, Docker' AS text FROM part)) n
 LEFT JOIN owners o ON contains(t, variant) AND regexp_matches(t,
  '(^|[^a-z0-9_])' || regexp_escape(variant) || '($|[^a-z0-9_])') GROUP BY 1""",
        _MERGED,
    ),
)
def extract_part(spark, d):
    """Texts on parts against the starter values and the whole part catalogue."""
    wanted = F.concat(
        F.lit("Wanted: "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" or "), "p_brand",
        F.lit(" with python3, Docker"),
    )
    texts = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), wanted.alias("text"))
    matcher = sk.Matcher.build(merged_entries(spark, d))
    return matcher.skills(texts, "text").select("id", joined("skills").alias("skills"))


@query(
    "taxonomy_flat",
    with_inputs(
        "entries part_entries",
        """SELECT category, canonical, alias_ord, alias FROM (
  SELECT category, canonical, unnest(aliases) AS alias, generate_subscripts(aliases, 1) - 1 AS alias_ord FROM (
   SELECT category, canonical, arg_max(aliases, n) AS aliases FROM numbered GROUP BY 1, 2))""",
        _MERGED,
    ),
)
def taxonomy_flat(spark, d):
    flat = sk.entries_table(merged_entries(spark, d)).where(F.col("alias").isNotNull())
    return flat.select("category", "canonical", F.col("alias_ord").cast("long").alias("alias_ord"), "alias")


@query(
    "taxonomy_merge",
    with_inputs(
        "entries part_entries",
        "SELECT 'canonical' AS kind, key, canonical, category FROM names UNION ALL "
        "SELECT 'alias', alias, canonical, NULL FROM alias_owner",
        _MERGED,
    ),
)
def taxonomy_merge(spark, d):
    entries = merged_entries(spark, d)
    names = sk.canonical_table(entries).select(
        F.lit("canonical").alias("kind"), F.col("canonical_lower").alias("key"), "canonical", "category"
    )
    aliases = sk.alias_table(entries).select(
        F.lit("alias").alias("kind"), F.col("alias").alias("key"), "canonical", F.lit(None).cast("string").alias("category")
    )
    return names.unionByName(aliases)


@query(
    "variant_owner",
    with_inputs(
        "entries part_entries",
        "SELECT variant, canonical FROM owners",
        _MERGED,
    ),
)
def variant_owner(spark, d):
    return sk.variant_table(merged_entries(spark, d)).select("variant", "canonical")


@query(
    "resolve_skills",
    with_inputs(
        "profile entries",
        """SELECT candidate_id, token, coalesce(n.canonical, a.canonical) AS canonical
 FROM (SELECT candidate_id, unnest(skills) AS token FROM profile) p
 LEFT JOIN names n ON n.key = lower(trim(token)) LEFT JOIN alias_owner a ON a.alias = lower(trim(token))""",
        {"numbered": "SELECT ord AS n, category, canonical, aliases FROM entries"}
        | {k: _MERGED[k] for k in ("names", "alias_owner")},
    ),
)
def resolve_skills(spark, d):
    tokens = fx.profiles(spark, d).select("candidate_id", F.explode("skills").alias("token"))
    return sk.resolve_tokens(tokens, sk.starter_entries(spark)).select("candidate_id", "token", "canonical")


_CATEGORY = {
    "names": """SELECT canonical, arg_max(category, ord) AS category FROM entries GROUP BY 1""",
}


@query(
    "skills_with_category",
    with_inputs(
        "profile entries",
        """SELECT candidate_id, skill, coalesce(category, 'Unknown') AS category
 FROM (SELECT candidate_id, unnest(skills) AS skill FROM profile) p LEFT JOIN names ON canonical = skill""",
        _CATEGORY,
    ),
)
def skills_with_category(spark, d):
    exploded = fx.profiles(spark, d).select("candidate_id", F.explode("skills").alias("skill"))
    return sk.with_category(exploded, sk.starter_entries(spark)).select("candidate_id", "skill", "category")


@query(
    "skills_by_category",
    with_inputs(
        "cand_hits entries",
        """SELECT candidate_id, category, string_agg(h.canonical, '|' ORDER BY h.canonical) AS skills
 FROM cand_hits h JOIN names n ON n.canonical = h.canonical GROUP BY 1, 2""",
        _CATEGORY,
    ),
)
def by_category(spark, d):
    found = starter_matcher(spark).skills(fx.resumes(spark, d), "resume_text")
    grouped = sk.skills_by_category(found, sk.starter_entries(spark), "candidate_id")
    return grouped.select("candidate_id", "category", joined("skills").alias("skills"))


_PAIR_LISTS = """list_sort(list_intersect(skills, jd_skills)) AS m,
  list_sort(list_filter(jd_skills, lambda x: NOT list_contains(skills, x))) AS miss,
  list_sort(list_filter(skills, lambda x: NOT list_contains(jd_skills, x))) AS ext"""


@query(
    "coverage_report",
    with_inputs(
        "scores",
        f"""SELECT jd_id, candidate_id, jd_coverage, breadth_bonus, array_to_string(m, '|') AS matched,
  array_to_string(miss, '|') AS missing, array_to_string(ext, '|') AS extra
 FROM (SELECT *, {_PAIR_LISTS} FROM scores)""",
    ),
)
def coverage_report(spark, d):
    report = sk.coverage_columns("skills", "jd_skills")
    pairs = scored(spark, d).select("jd_id", "candidate_id", "skills", "jd_skills").withColumns(report)
    lists = [joined(c).alias(c) for c in ("matched", "missing", "extra")]
    return pairs.select("jd_id", "candidate_id", "jd_coverage", "breadth_bonus", *lists)


# ---- scoring and ranking ---------------------------------------------------------------------------------------


@query("jd_coverage", with_inputs("scores", f"""SELECT jd_id, candidate_id, jd_coverage, breadth_bonus,
 {r('keyword_sim')} AS keyword_sim FROM scores"""))
def coverage(spark, d):
    keyword = s.rounded(F.col("keyword_sim"), 6).alias("keyword_sim")
    return scored(spark, d).select("jd_id", "candidate_id", "jd_coverage", "breadth_bonus", keyword)


@query("match_scores", with_inputs("scores", "SELECT jd_id, candidate_id, match_score FROM scores"))
def match_scores(spark, d):
    return scored(spark, d).select("jd_id", "candidate_id", "match_score")


@query(
    "rank_candidates",
    with_inputs("ranked", "SELECT jd_id, candidate_id, name, match_score, jd_coverage, rank FROM ranked"),
)
def rank_candidates(spark, d):
    return ranked(spark, d).select("jd_id", "candidate_id", "name", "match_score", "jd_coverage", "rank")


@query(
    "screening_result",
    with_inputs(
        "ranked",
        "SELECT jd_id, candidate_id, name, rank, match_score, array_to_string(skills, '|') AS skills FROM ranked",
    ),
)
def screening_result(spark, d):
    return rk.screening_result(ranked(spark, d)).withColumn("skills", joined("skills"))


@query(
    "default_selection",
    with_inputs("ranked", "SELECT jd_id, candidate_id, name || ' (#' || rank || ')' AS label FROM ranked WHERE rank <= 3"),
)
def default_selection(spark, d):
    label = F.concat("name", F.lit(" (#"), F.col("rank").cast("string"), F.lit(")"))
    return rk.top_ranked(ranked(spark, d), 3).select("jd_id", "candidate_id", label.alias("label"))


@query(
    "top_candidate",
    with_inputs(
        "ranked resume",
        """SELECT k.jd_id, k.candidate_id, c.name, c.experience_years, c.resume_text
 FROM ranked k JOIN resume c USING (candidate_id) WHERE rank = 1""",
    ),
)
def top_candidate(spark, d):
    best = rk.top_ranked(ranked(spark, d), 1).select("jd_id", "candidate_id")
    people = fx.resumes(spark, d).select("candidate_id", "name", "experience_years", "resume_text")
    return best.join(people, "candidate_id").select(
        "jd_id", "candidate_id", "name", "experience_years", "resume_text"
    )


@query(
    "display_skills",
    with_inputs(
        "scores",
        f"""SELECT jd_id, candidate_id, array_to_string((m || ext)[1:10], '|') AS shown,
  greatest(n_skills - 10, 0) AS hidden FROM (SELECT *, {_PAIR_LISTS} FROM scores)""",
    ),
)
def display_skills(spark, d):
    shown, hidden = rk.display_skills(10)
    return scored(spark, d).select(
        "jd_id", "candidate_id", F.array_join(shown, "|").alias("shown"), hidden.cast("long").alias("hidden")
    )


@query(
    "score_badges",
    with_inputs(
        "scores",
        """SELECT jd_id, candidate_id, CASE WHEN match_score >= 0.75 THEN '🟢 Excellent' WHEN match_score >= 0.5
  THEN '🟡 Good' WHEN match_score >= 0.3 THEN '🟠 Fair' ELSE '🔴 Poor' END AS badge,
  CASE WHEN pct >= 75 THEN 'Excellent' WHEN pct >= 55 THEN 'Good' WHEN pct >= 35 THEN 'Fair' ELSE 'Poor' END
   AS percent_badge, pct FROM (SELECT *, trunc(match_score * 100)::INTEGER AS pct FROM scores)""",
    ),
)
def score_badges(spark, d):
    score = F.col("match_score")
    return scored(spark, d).select(
        "jd_id",
        "candidate_id",
        s.score_badge(score).alias("badge"),
        s.percent_badge(score).alias("percent_badge"),
        s.percent(score).alias("pct"),
    )


@query(
    "invalid_jds",
    with_inputs(
        "jd jd_hits",
        """SELECT jd_id, jd_text, CASE WHEN trim(jd_text) = '' THEN 'empty job description' ELSE 'no known skills' END
  AS reason FROM jd WHERE jd_id NOT IN (SELECT jd_id FROM jd_hits)""",
    ),
)
def invalid_jds(spark, d):
    return rk.invalid_jobs(rk.job_skills(fx.jobs(spark, d), starter_matcher(spark)))


@query(
    "degenerate_jds",
    with_inputs(
        "scores",
        "SELECT jd_id, count(*) AS applications, count(DISTINCT match_score) = 1 AS degenerate FROM scores GROUP BY 1",
    ),
)
def degenerate_jds(spark, d):
    return rk.degenerate_jobs(scored(spark, d))


_LAST_RANKED = {
    "last": """SELECT jd_id, CASE jd_id::INTEGER % 4 WHEN 0 THEN jd_text || '  ' WHEN 1 THEN '' WHEN 2 THEN
  jd_text || ' Updated.' ELSE jd_text END AS jd_text FROM jd"""
}


@query(
    "stale_rankings",
    with_inputs(
        "jd",
        """SELECT jd_id, j.jd_text, l.jd_text AS ranked_text FROM jd j JOIN last l USING (jd_id)
 WHERE l.jd_text <> '' AND trim(j.jd_text) <> trim(l.jd_text)""",
        _LAST_RANKED,
    ),
)
def stale_rankings(spark, d):
    current = fx.jobs(spark, d)
    k = F.col("jd_id").cast("int") % 4
    text = F.col("jd_text")
    before = F.when(k == 0, F.concat(text, F.lit("  "))).when(k == 1, "").when(k == 2, F.concat(text, F.lit(" Updated.")))
    return rk.stale_rankings(current, current.withColumn("jd_text", F.coalesce(before, text)))


@query(
    "apply_corrections",
    with_inputs(
        "resume",
        """SELECT candidate_id, CASE WHEN ord%3=0 THEN 'Corrected ' || name ELSE name END AS name,
  CASE WHEN ord%5=0 THEN (ord%30)::DOUBLE/2 ELSE experience_years END AS experience_years,
  resume_text || CASE WHEN ord%4=0 THEN ' Terraform, Kafka' ELSE '' END AS resume_text FROM resume""",
    ),
)
def apply_corrections(spark, d):
    fixed = rk.apply_corrections(fx.resumes(spark, d), fx.corrections(spark, d))
    return fixed.select("candidate_id", "name", "experience_years", "resume_text")


@query(
    "candidate_preview",
    with_inputs(
        "resume cand_hits",
        """SELECT candidate_id, name, experience_years, 'dataset' AS source,
  coalesce(array_to_string(list(canonical ORDER BY canonical) FILTER (canonical IS NOT NULL)[1:4], ', '), '—')
   AS skills_preview
 FROM resume LEFT JOIN cand_hits USING (candidate_id) GROUP BY ALL""".replace(
            "list(canonical ORDER BY canonical) FILTER (canonical IS NOT NULL)[1:4]",
            "(list(canonical ORDER BY canonical) FILTER (canonical IS NOT NULL))[1:4]",
        ),
    ),
)
def candidate_preview(spark, d):
    return rk.preview(starter_matcher(spark).skills(fx.resumes(spark, d), "resume_text"))


@query(
    "safe_json",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  json_valid(props) AS valid FROM events""",
)
def safe_json(spark, d):
    parsed = s.safe_json(F.col("props"), "k long")
    events = fx.table(spark, d, "events").withColumn("parsed", parsed)
    return events.select("event_id", F.col("parsed.k").alias("k"), F.col("parsed.k").isNotNull().alias("valid"))




@query("report_sheets", with_inputs("ranked", "SELECT jd_id, candidate_id, name, rank FROM ranked"))
def report_sheets(spark, d):
    """The ranking sheet of a written report, read back."""
    sheet = ranked(spark, d).select("jd_id", "candidate_id", "name", "rank")
    path = write_report({"ranking": sheet}, new_path(spark, "report"))["ranking"]
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.schema("jd_id string, candidate_id string, name string, rank long").csv(path)
