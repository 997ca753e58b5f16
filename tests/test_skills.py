import random
import re

import pytest
from pyspark.sql import functions as F

from screenloom.functions.text import guess_experience, guess_name, normalize_text, parse_skills
from screenloom.operators import skills as sk
from screenloom.sources.taxonomy import read_taxonomy, write_taxonomy

GOLDEN = {
    "Proficient in C++ with STL and OOP principles": {"C", "C++", "Object Oriented Programming"},
    "Strong DSA fundamentals — trees, graphs, dynamic programming": {"Data Structures and Algorithms"},
    "Used data structures and algorithms in competitive programming": {"Data Structures and Algorithms"},
    "Worked with Kubernetes (k8s) and Terraform for IaC": {"Kubernetes", "Terraform"},
    "Built LLM pipelines using Hugging Face transformers and LangChain": {"Generative AI", "Hugging Face"},
    "Python, ML, Docker, AWS, CI/CD, React, PostgreSQL, Redis": {
        "Python", "Machine Learning", "Docker", "AWS", "React", "SQL", "Redis",
    },
    "Experience in Gen AI, Stable Diffusion, and GPT-4 integrations": {"Generative AI", "LLMs"},
    "Rust and Go microservices deployed on GCP with Helm": {"Rust", "Go", "Microservices", "GCP", "Kubernetes"},
    "Developed dApps using Solidity and Web3.js on Ethereum": {"Web3", "Blockchain", "Smart Contracts", "JavaScript"},
    "Shell scripting (bash), Linux admin, and Ansible playbooks": {"Shell", "Linux", "Ansible"},
}


def scan(text, variants):
    """Every variant searched in the whole text."""
    return sorted(
        {c for v, c in variants if re.search(r"(?<![a-z0-9_])" + re.escape(v) + r"(?![a-z0-9_])", text)}
    )


@pytest.fixture(scope="module")
def entries(spark):
    return sk.starter_entries(spark).cache()


@pytest.fixture(scope="module")
def matcher(entries):
    return sk.Matcher.build(entries)


def extract(spark, matcher, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r.skills for r in matcher.skills(df, "text").orderBy("id").collect()]


def test_golden_texts(spark, matcher):
    assert extract(spark, matcher, list(GOLDEN)) == [sorted(v) for v in GOLDEN.values()]


def test_extraction_equals_the_scan(spark, entries, matcher):
    variants = [(r.variant, r.canonical) for r in sk.variant_table(entries).collect()]
    rnd = random.Random(3)
    glue = [" ", " ", ", ", "-", "_", ".", "x", "+", "/", "\n", "é"]
    texts = ["", "   "] + [
        "".join(rnd.choice(variants)[0] + rnd.choice(glue) for _ in range(rnd.randint(1, 12))) for _ in range(400)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    normalized = [r.n for r in df.select("id", normalize_text(F.col("text")).alias("n")).orderBy("id").collect()]
    expected = [scan(n, variants) for n in normalized]
    assert extract(spark, matcher, texts) == expected
    parts = sk.Matcher.build(entries, block_variants=50)
    assert len(parts.blocks) > 5
    assert extract(spark, parts, texts) == expected


def test_extraction_without_id_or_text(spark, matcher):
    df = spark.createDataFrame([(None, "Docker and python3"), (None, None), (1, "")], "id long, text string")
    assert sorted(r.skills for r in matcher.skills(df, "text").collect()) == [[], [], ["Docker", "Python"]]


def test_normalize_protects_tokens(spark):
    texts = [
        "C++  and C# | .NET/F#", "see https://x.y/z?c++ now", "www.netflix.com www.example.com end",
        "Python's and it's.net", "a•b·c\\d", None, "tab\tand space x",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = [r.n for r in df.select("id", normalize_text(F.col("text")).alias("n")).orderBy("id").collect()]
    assert got == [
        "c++ and c# .net f#", "see now", "www.netflix.com end", "python and it's.net", "a b c d", "",
        "tab and space x",
    ]


def test_owner_of_shared_variants(entries):
    owner = {r.variant: r.canonical for r in sk.variant_table(entries).collect()}
    assert owner["sklearn"] == "Machine Learning"
    assert owner["react native"] == "React"
    assert owner["postgresql"] == "SQL"
    assert owner["jenkins"] == "CI/CD"
    assert owner["web3"] == "Blockchain"
    assert owner["agile"] == "Software Engineering"
    assert "git flow" not in owner  # the later registration of Git replaced its aliases


def test_resolve_prefers_canonical(spark, entries):
    tokens = spark.createDataFrame([(t,) for t in (" jenkins ", "Git Flow", "SKLEARN", "nope")], "token string")
    got = {r.token: r.canonical for r in sk.resolve_tokens(tokens, entries).collect()}
    assert got == {" jenkins ": "Jenkins", "Git Flow": "Git", "SKLEARN": "Machine Learning", "nope": None}


def test_taxonomy_extension(spark, entries):
    extra = spark.createDataFrame(
        [([0], "Emerging Tech", "LangChain", ["langchain", "lang chain"])], sk.ENTRY_SCHEMA
    )
    extended = sk.Matcher.build(sk.merge_entries(entries, extra))
    assert extract(spark, extended, ["We use LangChain with Python."]) == [["LangChain", "Python"]]


def test_variant_without_word_characters(spark, entries):
    extra = spark.createDataFrame([([0], "Marks", "Stars", ["***"])], sk.ENTRY_SCHEMA)
    for limit in (100_000, 7):
        matcher = sk.Matcher.build(sk.merge_entries(entries, extra), block_variants=limit)
        assert extract(spark, matcher, ["rated *** here", "none"]) == [["Stars"], []]


def test_order_of_merged_sources(spark, entries, tmp_path):
    """Starter, then a file, then a runtime entry; nested merges keep the order too."""
    one = lambda place, name, alias: spark.createDataFrame([([place], "New", name, [alias])], sk.ENTRY_SCHEMA)
    write_taxonomy(one(5, "Zeta", "shared").union(one(2, "Alpha", "shared")), str(tmp_path / "t"))
    file = read_taxonomy(spark, str(tmp_path / "t"))
    owner = lambda e: {r.variant: r.canonical for r in sk.variant_table(e).collect()}["shared"]
    assert owner(sk.merge_entries(entries, file, one(0, "Late", "shared"))) == "Alpha"
    assert owner(sk.merge_entries(entries, one(0, "Late", "shared"), file)) == "Late"
    assert owner(sk.merge_entries(sk.merge_entries(entries, one(9, "First", "shared")), one(0, "Second", "shared"))) == "First"
    assert owner(sk.merge_entries(entries, sk.merge_entries(one(9, "First", "shared"), one(0, "Second", "shared")))) == "First"
    replaced = sk.merge_entries(entries, file, one(0, "Alpha", "other"))
    assert [r.aliases for r in sk.canonical_table(replaced).where("canonical = 'Alpha'").collect()] == [["other"]]


def test_taxonomy_files(spark, entries, tmp_path):
    path = str(tmp_path / "taxonomy")
    write_taxonomy(entries, path)
    back = read_taxonomy(spark, path)
    variants = {(r.variant, r.canonical) for r in sk.variant_table(entries).collect()}
    assert {(r.variant, r.canonical) for r in sk.variant_table(back).collect()} == variants
    categories = {r.canonical: r.category for r in sk.canonical_table(back).collect()}
    assert categories["Git"] == "Tools & Practices"


def test_facts_from_text(spark):
    rows = [
        ("Name: Priya Sharma. 5+ years of experience", "Priya Sharma", 5.0),
        ("Résumé\n  Arjun Mehta \nExperience: 2.5 years", "Arjun Mehta", 2.5),
        ("lower case only, 3 years industry", "Unknown Candidate", 3.0),
        ("Madonna", "Unknown Candidate", 0.0),
    ]
    df = spark.createDataFrame(rows, "text string, name string, years double")
    text = F.col("text")
    for r in df.withColumns({"n": guess_name(text), "y": guess_experience(text)}).collect():
        assert (r.n, r.y) == (r.name, r.years)


def test_parse_skills(spark):
    df = spark.createDataFrame([(0, " a ,b,, c"), (1, "None"), (2, None), (3, "  ")], "id int, s string")
    got = [r.p for r in df.select("id", parse_skills(F.col("s")).alias("p")).orderBy("id").collect()]
    assert got == [["a", "b", "c"], [], [], []]


def test_coverage_of_empty_job(spark):
    df = spark.createDataFrame([(["A", "B"], []), (["A", "B"], ["B", "C"])], "s array<string>, j array<string>")
    empty, some = df.withColumns(sk.coverage_columns("s", "j")).collect()
    assert (empty.jd_coverage, empty.breadth_bonus, empty.extra) == (0.5, 0.0, ["A", "B"])
    assert (some.jd_coverage, some.breadth_bonus, some.matched, some.missing) == (0.5, 0.04, ["B"], ["C"])
