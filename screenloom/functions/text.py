"""Text normalisation and the facts read from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns. White space follows Unicode and includes \x1c-\x1f; (?U) does the same for \b.
# Single characters share one lookup table and the outer range settles most others, so letters are passed quickly.
ASCII_BLANK = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
WIDE_BLANK = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = rf"{ASCII_BLANK}[\u1680-\u3000&&[{WIDE_BLANK}]]"
URL = rf"https?://[^{ASCII_BLANK}{WIDE_BLANK}]+|www\.(?!net)[^{ASCII_BLANK}{WIDE_BLANK}]+"
POSSESSIVE = r"(?U)'s\b(?!\.net)"
GAPS = rf"[{ASCII_BLANK}\u00b7|/\\[\u1680-\u3000&&[{WIDE_BLANK}\u2022]]]+"

NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
RESUME_EXPERIENCE = [
    rf"(?iU){NUMBER}\+?\s*years?\s*of\s*experience",
    rf"(?iU)experience\s*[:\-]?\s*{NUMBER}\+?\s*years?",
    rf"(?iU){NUMBER}\s*years?\s*(?:work|professional|industry)",
]
REQUIRED_EXPERIENCE = [
    rf"(?U){NUMBER}\+?\s*years?\s*of\s*experience",
    rf"(?U)minimum\s+{NUMBER}\s+years?",
    rf"(?U)at\s+least\s+{NUMBER}\s+years?",
    rf"(?U){NUMBER}\+?\s*years?\s*(?:of\s*)?(?:work|professional|industry|relevant)",
]
NAME_LABEL = r"(?iU)name\s*[:\-]?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
NAME_LINE = r"(?U)^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$"
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
EDGE_BLANKS = rf"^[{BLANK}]+|[{BLANK}]+$"
UNKNOWN_NAME = "Unknown Candidate"


def normalize_text(text: Column) -> Column:
    """Lower-case text without URLs, separators and possessives.

    The look-aheads keep what starts with the token ".net" whole: it is not a URL and ends no possessive. Texts
    without a trigger skip the two rarer patterns; separators and white space collapse in one pass.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def where_present(value: Column, triggers: list[str], pattern: str, to: str) -> Column:
        present = F.contains(value, F.lit(triggers[0]))
        for trigger in triggers[1:]:
            present = present | F.contains(value, F.lit(trigger))
        return F.when(present, F.regexp_replace(value, pattern, to)).otherwise(value)

    no_urls = where_present(lowered, ["http", "www."], URL, " ")
    no_possessives = where_present(no_urls, ["'s"], POSSESSIVE, "")
    return F.trim(F.regexp_replace(no_possessives, GAPS, " "))


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, EDGE_BLANKS, "")


def parse_skills(skills: Column) -> Column:
    """Comma list to array; null, blank and "None" give no skills."""
    listed = F.filter(F.transform(F.split(skills, ","), lambda s: strip(s)), lambda s: s != "")
    empty = F.array().cast("array<string>")
    return F.when(skills.isNull() | strip(skills).isin("None", ""), empty).otherwise(listed)


def _first_number(text: Column, patterns: list[str]) -> Column:
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("double") for p in patterns]
    return F.coalesce(*found, F.lit(0.0))


def guess_experience(text: Column) -> Column:
    return _first_number(text, RESUME_EXPERIENCE)


def required_experience(jd_text: Column) -> Column:
    return _first_number(F.lower(jd_text), REQUIRED_EXPERIENCE)


def guess_name(text: Column) -> Column:
    """A labelled name, else the first line that looks like a name."""
    labelled = F.nullif(strip(F.regexp_extract(text, NAME_LABEL, 1)), F.lit(""))
    lines = F.transform(F.split(text, LINE_BREAK), lambda x: strip(x))
    line = F.get(F.filter(lines, lambda x: x.rlike(NAME_LINE)), 0)
    return F.coalesce(labelled, line, F.lit(UNKNOWN_NAME))


def seniority_tier(years: Column) -> Column:
    return F.when(years < 2, "junior").when(years < 5, "mid").otherwise("senior")


def resume_text(
    name: str, education: str, field: str, years: str, job: str, skills: str, certifications: str, objective: str
) -> Column:
    """Resume sentences from profile columns; missing values give empty text."""

    def part(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    return F.concat(
        F.lit("Name: "), part(name),
        F.lit(". Education: "), part(education), F.lit(" in "), part(field),
        F.lit(". Experience: "), F.coalesce(F.col(years), F.lit(0.0)).cast("string"),
        F.lit(" years. Current role: "), part(job),
        F.lit(". Skills: "), part(skills),
        F.lit(". Certifications: "), part(certifications),
        F.lit(". Objective: "), part(objective),
    )
