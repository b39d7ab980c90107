"""Enrichment: code-host profiles of the handles that raw records mention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unifold.functions.normalize import github_handle
from unifold.sources.readers import ENRICHED, github_records, numbered


def wanted_handles(records: DataFrame, seen: DataFrame | None = None, handle=github_handle) -> DataFrame:
    """(handle, first) of each distinct handle in the records that isn't in ``seen`` (handle)."""
    found = records.select("ingest_idx", handle(F.col("links.github")).alias("handle")).where("handle is not null")
    wanted = found.groupBy("handle").agg(F.min("ingest_idx").alias("first"))
    return wanted if seen is None else wanted.join(seen.select("handle").distinct(), "handle", "left_anti")


def enrich(records: DataFrame, profiles: DataFrame, seen: DataFrame | None = None, handle=github_handle) -> DataFrame:
    """The records and, after them, those of profiles they mention; one hop only.

    ``profiles`` has (user, repos); a profile is found by its login or by the handle of its link,
    the login first, and of several the first by ``ingest_idx`` (place in the scan without one).
    Handles in ``seen`` were fetched before and are left out.
    """
    place = F.col("ingest_idx") if "ingest_idx" in profiles.columns else F.monotonically_increasing_id()
    keyed = profiles.where("user is not null").withColumn("place", place).select(
        F.explode(F.array_distinct(F.filter(F.array(F.lower("user.login"), handle(F.col("user.html_url"))), lambda x: x.isNotNull() & (x != "")))).alias("handle"),
        "user", "repos", "place", F.lower("user.login").alias("login"),
    )
    best = keyed.groupBy("handle").agg(F.min_by(F.struct("user", "repos"), F.struct((F.col("login") != F.col("handle")).alias("other"), "place")).alias("p"))
    hits = wanted_handles(records, seen, handle).join(best, "handle").select("first", "p.user", "p.repos").sort("first")
    return records.unionByName(github_records(numbered(hits, ENRICHED)))
