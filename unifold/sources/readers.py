"""Sheets, résumés and code-host profiles to raw records.

Row order, where it matters, is the file path, then the place in the file: the row's position
(file, block, row) is taken right after the scan, before any shuffle.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unifold.functions.text import strip
from unifold.operators.extract import resume_records, split_location
from unifold.schemas import EXPERIENCE, GITHUB_SCHEMA, RAW_DDL, as_raw

SHEET_COLUMNS = ("name", "email", "phone", "current_company", "title")
#: Place of each source in the order of ingestion.
SHEET, RESUME, GITHUB, ENRICHED = range(4)
_PER_SOURCE = 1 << 60


def empty_raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RAW_DDL)


def numbered(df: DataFrame, source_order: int) -> DataFrame:
    """Add ``ingest_idx``, increasing in the scan's order; sources come one after another."""
    return df.withColumn("ingest_idx", F.lit(source_order * _PER_SOURCE) + F.monotonically_increasing_id())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, local or on any file system Spark knows, exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


def sheet_records(rows: DataFrame) -> DataFrame:
    """Raw records of sheet rows; columns are found by name, missing ones count as empty, others are ignored.

    Null counts as empty, values are stripped. A row with a company or a title has one job.
    """
    get = lambda n: F.coalesce(strip(F.col(n).cast("string")), F.lit("")) if n in rows.columns else F.lit("")
    company, title = get("current_company"), get("title")
    job = F.struct(company.alias("company"), title.alias("title"), F.lit(None).cast("string").alias("start"), F.lit("Present").alias("end"), F.lit("Extracted from recruiter CSV").alias("summary"))
    one = lambda c: F.filter(F.array(c), lambda x: x != "")
    return as_raw(
        rows,
        source=F.lit("recruiter_csv"),
        full_name=get("name"),
        emails=one(get("email")),
        phones=one(get("phone")),
        experience=F.when((company != "") | (title != ""), F.array(job)).otherwise(F.array().cast(EXPERIENCE)),
    )


def read_sheet(spark: SparkSession, path: str, stop_at_bad_row: bool = False) -> DataFrame:
    """Raw records of a CSV file with a header; a missing file gives none.

    UTF-8 with or without a byte order mark; quoted fields may span lines; blank lines are
    skipped, short rows are filled up with nulls. ``stop_at_bad_row`` leaves out the first row
    that lacks a known field and all after it.
    """
    if not exists(spark, path):
        return empty_raw(spark)
    rows = numbered(spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, mode="PERMISSIVE"), SHEET)
    if stop_at_bad_row:
        bad = rows.where(" or ".join(f"`{c}` is null" for c in SHEET_COLUMNS if c in rows.columns) or "false")
        first = bad.agg(F.min("ingest_idx").alias("first"))
        rows = rows.crossJoin(F.broadcast(first)).where("first is null or ingest_idx < first").drop("first")  # one row
    return sheet_records(rows)


def read_resumes(spark: SparkSession, path: str, pdf_text: Callable[[bytes], tuple[str, dict, list[str]]] | None = None) -> DataFrame:
    """Raw records of résumé files, in path order.

    A folder is not searched below its first level, and only .pdf and .txt files in it are read;
    a single file of any other extension is text. Files that are missing, empty or not UTF-8 give
    none. ``pdf_text`` turns a PDF file's bytes into (text, links, e-mails); without it PDF files
    give none.
    """
    if not exists(spark, path):
        return empty_raw(spark)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "content")
    low = F.lower("path")
    if folder:
        files = files.where(F.endswith(low, F.lit(".txt")) | F.endswith(low, F.lit(".pdf")))
    is_pdf = F.endswith(low, F.lit(".pdf"))
    texts = files.where(~is_pdf & F.is_valid_utf8(F.col("content").cast("string"))).select(
        "path", F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n").alias("text"),
        F.lit(None).cast("struct<linkedin:string,github:string,portfolio:string,other:array<string>>").alias("pdf_links"),
        F.lit(None).cast("array<string>").alias("pdf_emails"),
    )
    if pdf_text is not None:
        from unifold.sources.pdf import pdf_rows

        texts = texts.unionByName(pdf_rows(files.where(is_pdf), pdf_text))
    ordered = texts.where(F.col("text").isNotNull() & (F.col("text") != "")).sort("path")
    return resume_records(numbered(ordered, RESUME), annotations=True)


def github_records(profiles: DataFrame) -> DataFrame:
    """Raw records of code-host profiles (user, repos); a null user gives none.

    The name falls back to the login, the link to the one made from the login, the repository
    count to the number of repositories. Skills are the repositories' languages, each once (case
    ignored) in its first spelling.
    """
    u = F.col("user")
    text = lambda n: F.coalesce(u[n], F.lit(""))
    repos = F.coalesce(F.col("repos"), F.array().cast(GITHUB_SCHEMA["repos"].dataType))
    langs = F.filter(F.transform(repos, lambda r: strip(r["language"])), lambda x: x.isNotNull() & (x != ""))
    first = F.filter(F.transform(langs, lambda x, i: F.when(F.array_position(F.transform(langs, lambda y: F.lower(y)), F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    place = strip(text("location"))
    nowhere = F.struct(F.lit("").alias("city"), F.lit("").alias("region"), F.lit("").alias("country"))
    return as_raw(
        profiles.where(u.isNotNull()),
        source=F.lit("github"),
        full_name=F.when(text("name") != "", strip(u["name"])).otherwise(text("login")),
        emails=F.filter(F.array(strip(text("email"))), lambda x: x != ""),
        location=F.when(text("location") != "", split_location(place)).otherwise(nowhere),
        links=F.struct(
            F.lit("").alias("linkedin"), F.coalesce(u["html_url"], F.concat(F.lit("https://github.com/"), text("login"))).alias("github"),
            strip(text("blog")).alias("portfolio"), F.array().cast("array<string>").alias("other"),
        ),
        headline=F.when(text("bio") != "", u["bio"]),
        skills=F.transform(first, lambda x: F.struct(x.alias("name"), F.lit(None).cast("double").alias("confidence"))),
        repository_count=F.coalesce(u["public_repos"], F.size(repos)),
    )


def read_github(spark: SparkSession, path: str) -> DataFrame:
    """Code-host profiles of JSON files (one object per file); a missing or unreadable file gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], GITHUB_SCHEMA)
    return spark.read.schema(GITHUB_SCHEMA).json(path, multiLine=True, mode="DROPMALFORMED")


def profile_records(profiles: DataFrame, source: Column) -> DataFrame:
    """Raw records of canonical profiles exported earlier, under a given source."""
    jobs = F.transform("experience", lambda x: F.struct(x["company"].alias("company"), x["title"].alias("title"), x["start_month"].alias("start"), x["end_month"].alias("end"), x["summary"].alias("summary")))
    skills = F.transform("skills", lambda x: F.struct(x["name"].alias("name"), x["confidence"].alias("confidence")))
    return as_raw(profiles, source=source, experience=jobs, skills=skills)
