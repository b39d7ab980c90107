"""Schemas of raw records, canonical profiles and code-host profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCATION = "struct<city:string,region:string,country:string>"
LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
SKILLS = "array<struct<name:string,confidence:double>>"
EXPERIENCE = "array<struct<company:string,title:string,start:string,end:string,summary:string>>"
EDUCATION = "array<struct<institution:string,degree:string,field:string,end_year:int>>"
PROVENANCE = "array<struct<field:string,source:string,method:string>>"

#: A record as a source delivers it. ``ingest_idx`` is its place in the order of all records.
RAW_FIELDS = {
    "ingest_idx": "bigint",
    "source": "string",
    "full_name": "string",
    "emails": "array<string>",
    "phones": "array<string>",
    "location": LOCATION,
    "links": LINKS,
    "headline": "string",
    "years_experience": "double",
    "skills": SKILLS,
    "experience": EXPERIENCE,
    "education": EDUCATION,
    "repository_count": "int",
}
RAW_DDL = ", ".join(f"`{k}` {v}" for k, v in RAW_FIELDS.items())

CANONICAL_FIELDS = [
    "candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience",
    "skills", "experience", "education", "repository_count", "provenance", "overall_confidence",
]

def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


GITHUB_SCHEMA = T.StructType([
    T.StructField("user", T.StructType([*_strings("login", "name", "email", "bio", "location", "html_url", "blog"), T.StructField("public_repos", T.IntegerType())])),
    T.StructField("repos", T.ArrayType(T.StructType(_strings("name", "description", "created_at", "updated_at", "language")))),
])


def empty(kind: str) -> Column:
    """An empty array of a type, or a null of any other."""
    return (F.array() if kind.startswith("array") else F.lit(None)).cast(kind)


def as_raw(df: DataFrame, **columns: Column) -> DataFrame:
    """Select the raw record's columns: the given ones, those the frame has, else empty ones."""
    out = []
    for name, kind in RAW_FIELDS.items():
        c = columns.get(name)
        if c is None:
            c = F.col(name) if name in df.columns else empty(kind)
        out.append(c.cast(kind).alias(name))
    return df.select(*out)
