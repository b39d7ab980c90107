"""Résumé text to structured fields, as column expressions over a text column.

Everything stays inside Catalyst. ``with_lines`` makes the lines and the places of the headings
columns of their own; all later expressions are built on these, so no pattern is applied to a
line twice. The two parsers that depend on the line before find their entries' first lines at
once and cut the block there; no array grows line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unifold.functions.text import strip
from unifold.schemas import EDUCATION, EXPERIENCE, as_raw

# Section headings, degree words and link patterns that are recognised.
HEADINGS = ["education", "skills", "projects", "experience", "certifications", "summary", "objective"]
DEGREE_WORDS = ["b.e.", "b.tech", "b.s.", "sslc", "puc", "course", "school", "college", "university"]
EMAIL = r"(?U)[\w\.-]+@[\w\.-]+\.\w+"
PHONE = r"(?U)(?:\+?\d{1,4}[-.\s]?)?\(?\d{2,5}\)?[-.\s]?\d{3,5}[-.\s]?\d{3,5}"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[a-zA-Z0-9_-]+"
LOCATION = r"(?idU)Location:\s*(.*)"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[a-zA-Z0-9_-]+"


def extract_emails(text: Column, annotated: Column | None = None) -> Column:
    """Distinct addresses; with annotated ones, those that merely contain one of them are dropped."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), 0))
    if annotated is None:
        return found
    extra = F.coalesce(annotated, F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(found, extra))
    return F.filter(every, lambda e: ~F.exists(extra, lambda a: (e != a) & F.contains(e, a)))


def extract_phones(text: Column) -> Column:
    """Distinct number-like strings of 8 to 15 digits, trimmed to their first + or digit and last digit."""
    found = F.filter(F.regexp_extract_all(text, F.lit(PHONE), 0), lambda p: F.length(F.regexp_replace(p, r"\D", "")).between(8, 15))
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"^[^+\d]+|[^0-9]+$", "")))


def first_match(text: Column, pattern: str) -> Column:
    """First match of a pattern, or an empty string."""
    return F.coalesce(F.regexp_extract(text, pattern, 0), F.lit(""))


def text_lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def heading_of(line: Column) -> Column:
    """The section heading a whole stripped line is, or null."""
    low = F.lower(line)
    bare = F.when(F.endswith(low, F.lit(":")), strip(F.substring(low, F.lit(1), F.length(low) - 1))).otherwise(low)
    return F.when(bare.isin(HEADINGS), bare)


def with_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``_lines``, the stripped lines that aren't blank, and ``_heads``, (i, h) of each heading."""
    df = df.withColumn("_lines", text_lines(F.col(text_col)))
    told = F.transform("_lines", lambda x, i: F.struct(i.alias("i"), heading_of(x).alias("h")))
    return df.withColumn("_heads", F.filter(told, lambda x: x["h"].isNotNull()))


def section_block(heading: str) -> Column:
    """Lines below the last occurrence of a heading, up to the next heading; null without it.

    Needs the columns of ``with_lines``.
    """
    lines, heads = F.col("_lines"), F.col("_heads")
    places = F.transform(heads, lambda x, k: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.coalesce(F.get(heads, k + 1)["i"], F.size(lines)).alias("upto")))
    mine = F.filter(places, lambda x: x["h"] == heading)
    last = F.get(mine, F.size(mine) - 1)
    return F.when(F.size(mine) > 0, F.slice(lines, last["i"] + 2, last["upto"] - last["i"] - 1))


def split_skills(block: Column) -> Column:
    """Skills of a block's lines: after the first colon, divided at commas and semicolons, under 50 characters."""
    def of_line(line: Column) -> Column:
        tail = F.when(F.contains(line, F.lit(":")), F.regexp_replace(line, r"(?s)^[^:]*:", "")).otherwise(line)
        parts = F.filter(F.transform(F.split(tail, "[,;]"), strip), lambda x: (x != "") & (F.length(x) < 50))
        return F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)\s+", " "))

    return F.flatten(F.transform(F.coalesce(block, F.array().cast("array<string>")), of_line))


def split_location(value: Column) -> Column:
    """Comma-separated place to city, region, country: three parts, two (no region) or one (country)."""
    parts = F.transform(F.split(value, ","), strip)
    n = F.size(parts)
    none = F.lit("")
    return F.struct(
        F.when(n >= 2, F.get(parts, F.lit(0))).otherwise(none).alias("city"),
        F.when(n >= 3, F.get(parts, F.lit(1))).otherwise(none).alias("region"),
        F.when(n >= 3, F.get(parts, F.lit(2))).when(n == 2, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))).alias("country"),
    )


def parse_education(block: Column) -> Column:
    """Degree lines with the institution in the line after each, which is no degree line itself.

    The degree lines are marks in a string, in which a pattern takes each with its successor.
    """
    lines = F.coalesce(block, F.array().cast("array<string>"))
    words = "|".join(w.replace(".", r"\.") for w in DEGREE_WORDS)
    marks = F.array_join(F.transform(lines, lambda x: F.when(F.rlike(F.lower(x), F.lit(words)), F.lit("d")).otherwise(F.lit("-"))), "")
    begins = F.split(F.regexp_replace(F.regexp_replace(marks, "d.", "B-"), "d", "B"), "")

    def last_year(x: Column) -> Column:
        years = F.regexp_extract_all(x, F.lit(r"\b(\d{4})\b"), 1)
        return F.get(years, F.size(years) - 1).cast("int")

    def entry(x: Column) -> Column:
        degree = strip(F.regexp_replace(F.regexp_replace(x["line"], r"\d{4}", ""), r"(?U)[-?–\s]+$", ""))
        inst = strip(F.regexp_replace(strip(F.regexp_replace(x["next"], r"(?:CGPA:|Percentage:).*$", "")), r"(?U)[,\s\?\-]+$", ""))
        field = strip(F.regexp_extract(degree, r"(?iU)in\s+([^(\n?]+)", 1))
        return F.struct(
            F.coalesce(inst, F.lit("")).alias("institution"),
            degree.alias("degree"),
            field.alias("field"),
            F.coalesce(last_year(x["line"]), last_year(x["next"])).alias("end_year"),
        )

    zipped = F.arrays_zip(lines.alias("line"), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))).alias("next"), begins.alias("mark"))
    found = F.filter(zipped, lambda x: x["mark"] == "B")
    return F.transform(found, entry).cast(EDUCATION)


def parse_projects(block: Column) -> Column:
    """Entries that begin with a line "title | technologies"; bullets and other lines add to the summary."""
    lines = F.coalesce(block, F.array().cast("array<string>"))
    begins = F.filter(F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit("|")), i)), lambda i: i.isNotNull())

    def more(x: Column) -> Column:
        return F.concat(F.when(F.rlike(x, F.lit(r"^[?•-]")), strip(F.substring(x, F.lit(2), F.length(x)))).otherwise(x), F.lit(" "))

    def entry(x: Column) -> Column:
        first = F.element_at(x, 1)
        title = F.regexp_replace(strip(F.substring_index(first, "|", 1)), r"(?U)(\w)\s+(\w)", "$1$2")
        tech = strip(F.regexp_replace(first, r"(?s)^[^|]*\|", ""))
        rest = F.transform(F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), more)
        return F.struct(
            F.lit("Personal/Academic Project").alias("company"), title.alias("title"), F.lit(None).cast("string").alias("start"),
            F.lit("Present").alias("end"), F.concat(F.lit("Technologies: "), tech, F.lit(". "), F.array_join(rest, "")).alias("summary"),
        )

    slices = F.transform(begins, lambda i, k: F.slice(lines, i + 1, F.coalesce(F.get(begins, k + 1), F.size(lines)) - i))
    return F.transform(slices, entry).cast(EXPERIENCE)


def location_of(text: Column, education: Column) -> Column:
    """The place after "Location:", else a guess from the first institution."""
    hit = F.rlike(text, F.lit(LOCATION))
    stated = split_location(strip(F.regexp_extract(text, LOCATION, 1)))
    inst = F.coalesce(F.get(education, F.lit(0))["institution"], F.lit(""))
    parts = F.transform(F.split(inst, ","), strip)
    low = F.lower(inst)
    indian = F.contains(low, F.lit("ballari")) | F.contains(low, F.lit("india"))
    guess = F.struct(
        F.when(inst != "", F.get(parts, F.size(parts) - 1)).otherwise(F.lit("")).alias("city"), F.lit("").alias("region"),
        F.when((F.size(parts) >= 2) & indian, F.lit("IN")).otherwise(F.lit("")).alias("country"),
    )
    return F.when(hit, stated).otherwise(guess)


def work_block() -> Column:
    """Lines of the projects section, of the experience section where that has none."""
    projects = section_block("projects")
    return F.when(F.coalesce(F.size(projects), F.lit(0)) > 0, projects).otherwise(section_block("experience"))


def headline_of() -> Column:
    """Summary block, else objective block, else a short second line that is no heading; null if none.

    Needs the columns of ``with_lines``.
    """
    def block(h: str) -> Column:
        joined = strip(F.array_join(section_block(h), "\n"))
        return F.when(joined != "", joined)

    second = F.get("_lines", F.lit(1))
    fallback = F.when(~F.lower(second).isin(HEADINGS) & (F.length(second) < 100), second)
    return strip(F.regexp_replace(F.coalesce(block("summary"), block("objective"), fallback), "\n", " "))


def resume_records(df: DataFrame, text_col: str = "text", annotations: bool = False) -> DataFrame:
    """Raw records of a frame with a text column; rows with a null or empty text give none.

    With ``annotations`` the frame also has ``pdf_links`` and ``pdf_emails``, which come first.
    Other columns the raw record doesn't know are dropped; ``ingest_idx`` is kept if present.
    """
    text = F.col(text_col)
    # Blocks are columns too: their parsers refer to them from within lambdas.
    base = with_lines(df.where(text.isNotNull() & (text != "")), text_col)
    base = base.withColumn("_edu", section_block("education")).withColumn("_work", work_block()).withColumn("_skills", section_block("skills"))
    base = base.withColumn("_edu", parse_education(F.col("_edu")))
    lines, edu = F.col("_lines"), F.col("_edu")
    given = (lambda n: F.coalesce(F.col("pdf_links")[n], F.lit(""))) if annotations else (lambda n: F.lit(""))
    pick = lambda n, pattern: F.when(given(n) != "", given(n)).otherwise(first_match(text, pattern))
    other = F.coalesce(F.col("pdf_links")["other"], F.array().cast("array<string>")) if annotations else F.array().cast("array<string>")
    skills = F.transform(split_skills(F.col("_skills")), lambda x: F.struct(x.alias("name"), F.lit(None).cast("double").alias("confidence")))
    return as_raw(
        base,
        source=F.lit("resume"),
        full_name=F.coalesce(F.get(lines, F.lit(0)), F.lit("")),
        emails=extract_emails(text, F.col("pdf_emails") if annotations else None),
        phones=extract_phones(text),
        location=location_of(text, edu),
        links=F.struct(pick("linkedin", LINKEDIN).alias("linkedin"), pick("github", GITHUB).alias("github"), given("portfolio").alias("portfolio"), other.alias("other")),
        headline=headline_of(),
        skills=skills,
        experience=parse_projects(F.col("_work")),
        education=edu,
    )
