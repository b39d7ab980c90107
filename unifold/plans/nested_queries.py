"""Queries over the nested profile exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unifold.functions.text import strip
from unifold.operators.nested import child_table, flatten_json, label_at
from unifold.runtime import read_table

ANCHOR = "candidate_id"
LISTS = ("experience", "skills", "skills.sources", "provenance", "education")


def export_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_json(read_table(spark, sf_dir, "output_default_json"), "dump_no", "payload", ANCHOR, LISTS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every present company, skill source and provenance field with its profile and parent."""
    nodes = export_nodes(spark, sf_dir).where(F.col("table_name").isin("experience", "skills.sources", "provenance"))
    field = (
        F.when(F.col("table_name") == "experience", F.struct(F.lit("experience.company").alias("name"), F.try_element_at("fields", F.lit("company")).alias("v")))
        .when(F.col("table_name") == "provenance", F.struct(F.lit("provenance.field").alias("name"), F.try_element_at("fields", F.lit("field")).alias("v")))
        .otherwise(F.struct(F.lit("skills.sources").alias("name"), F.col("value").alias("v")))
    )
    return (
        nodes.withColumn("x", field)
        .where(strip(F.col("x.v")) != "")
        .select(
            F.col("doc").alias("dump_no"),
            label_at(0).alias("profile_pos"),
            F.col("x.name").alias("field_name"),
            label_at(1).alias("parent_pos"),
            F.coalesce(label_at(2), F.lit(0).cast("bigint")).alias("child_pos"),
        )
    )


def _table(name: str, columns: tuple[str, ...]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = child_table(export_nodes(spark, sf_dir), name, columns)
        return t if name.endswith("sources") else t.drop("value")

    query.__doc__ = f"The flat table {name} of the exports, with labels and parent labels."
    return query


QUERIES = {
    "p4_found": p4_found,
    "p4_experience": _table("experience", ("company", "title", "start", "end", "summary")),
    "p4_skills": _table("skills", ("name", "confidence")),
    "p4_skill_sources": _table("skills.sources", ()),
    "p4_provenance": _table("provenance", ("field", "source", "method")),
}
