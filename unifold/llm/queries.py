"""Queries of the llm operators over the project's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unifold.llm.leakage import find_leaks
from unifold.llm.linkage import link_people
from unifold.llm.namelinks import distinct_names, linked_names
from unifold.llm.packing import item_sizes, pack
from unifold.llm.pieces import split_documents
from unifold.llm.records import free_values, profile_texts, record_groups
from unifold.llm.refmap import map_values
from unifold.llm.scanned import inspect_texts
from unifold.llm.survivor import field_candidates, fused_survivors, stated_order
from unifold.plans.oracle import handle_key, strip
from unifold.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile record with the smallest record number of its group."""
    return record_groups(read_table(spark, sf_dir, "output_default"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group and field the record whose value survives."""
    profiles = read_table(spark, sf_dir, "output_default")
    return fused_survivors(field_candidates(profiles, record_groups(profiles)), stated_order()).select("group_no", "field_name", "record_no")


def p2_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group and field the value of largest posterior under fusion with copy detection."""
    profiles = read_table(spark, sf_dir, "output_default")
    return fused_survivors(field_candidates(profiles, record_groups(profiles)))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a sheet or code-host row and a profile record of one person, with a confidence."""
    return link_people(read_table(spark, sf_dir, "sample_csv"), read_table(spark, sf_dir, "github_mock"), read_table(spark, sf_dir, "output_default"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p3_links."""
    return p3_links(spark, sf_dir).select("src_table", "src_id", "record_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every skill name, country and job title with the reference entry it means, or -1."""
    values = free_values(read_table(spark, sf_dir, "output_default"))
    return map_values(values, read_table(spark, sf_dir, "ref_values")).select("record_no", "field_name", "pos", "ref_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile text with each kind of scanner damage in it."""
    texts = inspect_texts(profile_texts(read_table(spark, sf_dir, "output_default")))
    return texts.select("record_no", "field_name", "pos", F.explode("damage").alias("damage"))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile text in its repaired form; undamaged ones as they are."""
    texts = inspect_texts(profile_texts(read_table(spark, sf_dir, "output_default")))
    return texts.select("record_no", "field_name", "pos", F.col("repaired").alias("text"), (F.size("damage") > 0).alias("was_damaged"))


def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct strings of the three name columns."""
    columns = [
        read_table(spark, sf_dir, "sample_csv").select("name"),
        read_table(spark, sf_dir, "output_default").select("full_name"),
        read_table(spark, sf_dir, "github_mock").select("user_profile.name"),
    ]
    return distinct_names(columns)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of spellings of one person's name."""
    return linked_names(person_names(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each evaluation item that stands in it."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or part of an oversized one, with its container of 2,048 tokens."""
    return pack(item_sizes(read_table(spark, sf_dir, "documents")))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every text above 512 tokens, overlapping by 64."""
    return split_documents(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_fused": p2_fused, "p3_found": p3_found, "p3_links": p3_links, "p5_found": p5_found, "p6_found": p6_found, "p6_repaired": p6_repaired, "p7_found": p7_found, "p8_containers": p8_containers, "p9_found": p9_found, "p10_pieces": p10_pieces}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can say in reasonable time; the others are tested by brute force."""
    s = strip("v")
    bare = f"regexp_replace({s}, '(?i)\\s*(?:;\\s*)?(?:ext\\.?|extension|x|#)\\s*\\d+\\s*$', '')"
    d = f"regexp_replace({bare}, '\\D', '', 'g')"
    phone = f"""case when length({d}) < 7 then null when {bare} like '+%' then '+' || {d} when {d} like '00%' and length({d}) > 11 then '+' || substr({d}, 3)
      when length({d}) = 10 then '+1' || {d} when length({d}) = 11 and {d} like '1%' then '+' || {d} when length({d}) >= 12 then '+' || {d} else {d} end"""
    return {
        "p1_found": f"""with recursive keyed as (
            select record_no as id, 'e:' || lower({s}) as k from (select record_no, unnest(emails) as v from output_default) t where {s} <> ''
            union select record_no, 'p:' || {phone} from (select record_no, unnest(phones) as v from output_default) t where {phone} is not null
            union select record_no, 'g:' || {handle_key("links.github")} from output_default where {handle_key("links.github")} is not null),
          edges as (select distinct a.id as a, b.id as b from keyed a join (select k, min(id) as id from keyed group by k) b on a.k = b.k),
          both_ways as (select a, b from edges union select b, a from edges),
          reach as (select record_no as a, record_no as b from output_default union select r.a, e.b from reach r join both_ways e on r.b = e.a)
          select a as record_no, min(b) as group_no from reach group by a""",
    }
