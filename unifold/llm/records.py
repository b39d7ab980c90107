"""Groups of matching profile records: the inputs of the consolidation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unifold.functions.identifiers import identifier_keys
from unifold.functions.text import strip
from unifold.llm.components import connected_components, edges_from_keys


def record_groups(profiles: DataFrame) -> DataFrame:
    """(record_no, group_no) for every record; records link through e-mails, phones and handles.

    Null structs, null or empty arrays and blank elements link nothing; a record without any key
    is a group of its own. Rows with a null ``record_no`` have no identity and are left out.
    """
    keyed = profiles.where(F.col("record_no").isNotNull()).select(
        F.col("record_no").alias("id"),
        F.explode(identifier_keys(F.col("emails"), F.col("phones"), F.col("links.github"))).alias("key"),
    )
    groups = connected_components(profiles.select(F.col("record_no").alias("id")), edges_from_keys(keyed))
    return groups.select(F.col("id").alias("record_no"), "group_no")


def free_values(profiles: DataFrame) -> DataFrame:
    """Non-blank free values with their place: (record_no, field_name, pos, kind, value).

    Null structs and arrays have none; rows with a null ``record_no`` are left out.
    """
    profiles = profiles.where(F.col("record_no").isNotNull())

    def listed(arr: str, member: str, kind: str) -> DataFrame:
        each = profiles.select("record_no", F.posexplode(arr).alias("pos", "x"))
        return each.select("record_no", F.lit(f"{arr}.{member}").alias("field_name"), F.col("pos").cast("bigint").alias("pos"), F.lit(kind).alias("kind"), F.col(f"x.{member}").alias("value"))

    country = profiles.select("record_no", F.lit("location.country").alias("field_name"), F.lit(0).cast("bigint").alias("pos"), F.lit("country").alias("kind"), F.col("location.country").alias("value"))
    every = listed("skills", "name", "skill").union(country).union(listed("experience", "title", "title"))
    return every.where(strip(F.col("value")) != "")


def profile_texts(profiles: DataFrame) -> DataFrame:
    """Job summaries and headlines with their place: (record_no, field_name, pos, text).

    Rows with a null ``record_no`` are left out.
    """
    profiles = profiles.where(F.col("record_no").isNotNull())
    zero = F.lit(0).cast("bigint")
    jobs = profiles.select("record_no", F.posexplode("experience").alias("pos", "x")).select("record_no", F.lit("experience.summary").alias("field_name"), F.col("pos").cast("bigint").alias("pos"), F.col("x.summary").alias("text"))
    heads = profiles.select("record_no", F.lit("headline").alias("field_name"), zero.alias("pos"), F.col("headline").alias("text"))
    return jobs.union(heads)
