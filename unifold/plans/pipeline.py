"""The pipeline: sheet, résumés and code-host profiles to canonical and projected profiles."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unifold.functions.normalize import github_handle
from unifold.operators.enrich import enrich, wanted_handles
from unifold.operators.merge import GROUP, merge_records
from unifold.operators.project import project
from unifold.operators.resolve import resolve_entities
from unifold.runtime import cut_lineage
from unifold.sources.readers import GITHUB, empty_raw, exists, github_records, numbered, read_github, read_resumes, read_sheet


@dataclass
class Result:
    """Profiles in the order of their groups; ``custom`` and ``rejects`` only with a config."""

    default: DataFrame
    custom: DataFrame | None = None
    rejects: DataFrame | None = None


def handle_text(value: str) -> str:
    """The handle a command line argument names, in lower case."""
    s = value.strip().lower().rstrip("/")
    if "github.com/" in s:
        s = [p for p in s.split("/") if p][-1]
    return re.split(r"[?#]", s)[0].strip()


def run_pipeline(
    spark: SparkSession,
    csv_path: str | None = None,
    resume_path: str | None = None,
    github: str | None = None,
    profiles: DataFrame | None = None,
    config: dict | None = None,
    as_of: str | None = None,
    pdf_text: Callable | None = None,
) -> Result:
    """Ingest, enrich, resolve, merge and project.

    ``github`` is a JSON file's path, or a link or handle that is looked up in ``profiles``
    (user, repos), as are the handles the records mention. Missing inputs give no records.
    """
    records = empty_raw(spark)
    if csv_path:
        records = records.unionByName(read_sheet(spark, csv_path))
    if resume_path:
        records = records.unionByName(read_resumes(spark, resume_path, pdf_text))
    seen = None
    if github:
        if not re.match(r"(?i)https?://", github.strip()) and exists(spark, github):
            own = read_github(spark, github)
        else:
            handle = handle_text(github)
            seen = spark.createDataFrame([(handle,)], "handle string")
            own = profiles.where((F.lower("user.login") == handle) | (github_handle(F.col("user.html_url")) == handle)) if profiles is not None else read_github(spark, github)
        records = records.unionByName(github_records(numbered(own, GITHUB)))
    records = cut_lineage(records)
    if profiles is not None:
        records = cut_lineage(enrich(records, profiles, seen))
    merged = cut_lineage(merge_records(resolve_entities(records), as_of))
    out = Result(merged)
    if config:
        out.custom, out.rejects = project(merged, config)
    return out


__all__ = ["GROUP", "Result", "run_pipeline", "wanted_handles"]
