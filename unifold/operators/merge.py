"""Merging the records of each group into one canonical profile, by source trust.

Scalars are one aggregate over the trust order (``scalars``). All lists are another (``lists``):
their elements are laid out as rows of one form, deduplicated keep-first by group, kind and key,
which combines before the shuffle, and only then collected, so what a task collects for a group
is only what the profile will hold. A profile costs three shuffles, and no group is in one task
before it is deduplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unifold.functions.normalize import is_missing, normalize_country, normalize_date, normalize_skill, round_half_even, stable_id
from unifold.functions.text import strip
from unifold.functions.trust import trust_weight
from unifold.operators.resolve import email_keys, phone_keys
from unifold.schemas import CANONICAL_FIELDS, EDUCATION, EXPERIENCE, LINKS, LOCATION, PROVENANCE, SKILLS

GROUP = "component_id"


def ranked(records: DataFrame) -> DataFrame:
    """Add ``weight`` and ``rk``, the trust order: weight descending, then order of ingestion."""
    w = trust_weight(F.col("source"))
    return records.withColumn("weight", w).withColumn("rk", F.struct((-w).alias("w"), F.col("ingest_idx").alias("i")))


def first_by_trust(value: Column, present: Column) -> Column:
    """Aggregate: the value of the first record in trust order for which ``present`` holds."""
    return F.min_by(value, F.when(present, F.col("rk")))


def _text(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def scalars(base: DataFrame) -> DataFrame:
    """One row per group: first values by trust, location and links property by property."""
    def pick(name: str, kind: str) -> Column:
        return first_by_trust(F.struct(F.col(name).alias("v"), F.coalesce("source", F.lit("unknown")).alias("s")), ~is_missing(F.col(name), kind)).alias(name)

    def part(c: Column, name: str) -> Column:
        return F.coalesce(first_by_trust(c, c.isNotNull() & (c != "")), F.lit("")).alias(name)

    return base.groupBy(GROUP).agg(
        F.min_by(F.coalesce("source", F.lit("unknown")), "rk").alias("primary"),
        pick("full_name", "string"), pick("headline", "string"), pick("years_experience", "double"), pick("repository_count", "int"),
        part(_text(F.col("location.city")), "city"), part(_text(F.col("location.region")), "region"), part(normalize_country(F.col("location.country")), "country"),
        part(_text(F.col("links.linkedin")), "linkedin"), part(_text(F.col("links.github")), "github"), part(_text(F.col("links.portfolio")), "portfolio"),
    )


_ELEMENT = f"array<struct<kind:string,k1:string,k2:string,pos:int,job:{EXPERIENCE[6:-1]},school:{EDUCATION[6:-1]},confidence:double,source:string>>"


def elements(as_of: str | None) -> Column:
    """All list elements of a ranked record in one form: kind, key, place, value.

    Keys of jobs and education are compared stripped and in lower case; elements whose key is
    empty are left out.
    """
    source = F.coalesce("source", F.lit("unknown"))

    def each(kind: str, values: Column, key, second=None, **members) -> Column:
        def element(x: Column, i: Column) -> Column:
            given = {n: fn(x) for n, fn in members.items()}
            missing = {n: F.lit(None).cast(t) for n, t in (("job", EXPERIENCE[6:-1]), ("school", EDUCATION[6:-1]), ("confidence", "double"), ("source", "string")) if n not in given}
            rest = {**given, **missing}
            return F.struct(F.lit(kind).alias("kind"), key(x).alias("k1"), (second(x) if second else F.lit("")).alias("k2"), i.alias("pos"), *(rest[n].alias(n) for n in ("job", "school", "confidence", "source")))

        return F.filter(F.transform(values, element), lambda x: x["k1"] != "").cast(_ELEMENT)

    def low(name: str):
        return lambda x: F.lower(_text(x[name]))

    def job(x: Column) -> Column:
        return F.struct(_text(x["company"]).alias("company"), _text(x["title"]).alias("title"), normalize_date(x["start"], as_of).alias("start"), normalize_date(x["end"], as_of).alias("end"), _text(x["summary"]).alias("summary"))

    def school(x: Column) -> Column:
        return F.struct(*(_text(x[n]).alias(n) for n in ("institution", "degree", "field")), x["end_year"].alias("end_year"))

    def some(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast(kind))

    itself = lambda x: x
    return F.concat(
        each("email", email_keys(F.col("emails")), itself),
        each("phone", phone_keys(F.col("phones")), itself),
        each("other", some("links.other", "array<string>"), itself),
        each("job", some("experience", EXPERIENCE), low("company"), low("title"), job=job),
        each("school", some("education", EDUCATION), low("institution"), low("degree"), school=school),
        each("skill", some("skills", SKILLS), lambda x: normalize_skill(x["name"]), confidence=lambda x: F.coalesce(x["confidence"], F.col("weight")), source=lambda x: source),
    )


def lists(base: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row per group that has any element: emails, phones, other, experience, education, skills.

    E-mails and phones are sorted; the others stand in the order of their first appearance, by
    trust. A skill has its highest confidence and its sorted sources.
    """
    rows = base.select(GROUP, "rk", F.explode(elements(as_of)).alias("x")).select(GROUP, F.struct("rk", "x.pos").alias("at"), "x.*")
    once = rows.groupBy(GROUP, "kind", "k1", "k2").agg(
        F.min("at").alias("at"), F.min_by("job", "at").alias("job"), F.min_by("school", "at").alias("school"),
        F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"),
    )

    def ordered(kind: str, value: Column) -> Column:
        kept = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", value.alias("v")))))
        return F.transform(kept, lambda x: x["v"])

    def keys(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("k1"))))

    skill = F.struct(F.col("k1").alias("name"), "confidence", "sources")
    return once.groupBy(GROUP).agg(
        keys("email").alias("emails"), keys("phone").alias("phones"), ordered("other", F.col("k1")).alias("other"),
        ordered("job", F.col("job")).alias("experience"), ordered("school", F.col("school")).alias("education"), ordered("skill", skill).alias("skills"),
    )


def worked_years(experience: Column) -> Column:
    """Sum of the jobs' positive month differences in years, one decimal; null if there is none.

    A job without an end counts nothing. Overlapping jobs count twice.
    """
    def months(x: Column) -> Column:
        m = lambda d: F.try_element_at(F.split(d, "-"), F.lit(1)).cast("int") * 12 + F.try_element_at(F.split(d, "-"), F.lit(2)).cast("int")
        return F.coalesce(F.greatest(m(x["end"]) - m(x["start"]), F.lit(0)), F.lit(0))

    total = F.aggregate(F.coalesce(experience, F.array().cast(EXPERIENCE)), F.lit(0), lambda acc, x: acc + months(x))
    return F.when(total > 0, F.bround(total / F.lit(12.0), 1))


def merge_records(records: DataFrame, as_of: str | None = None) -> DataFrame:
    """Canonical profiles, one per ``component_id``, which is kept as an extra column.

    ``records`` are raw records with ``component_id``. ``as_of`` (YYYY-MM) is what "Present"
    means. Profiles without an e-mail get a random id, others one made from the first address.
    """
    base = ranked(records)
    m = scalars(base).join(lists(base, as_of), GROUP, "left")
    for name, kind in (("emails", "array<string>"), ("phones", "array<string>"), ("other", "array<string>"), ("experience", EXPERIENCE), ("education", EDUCATION), ("skills", "array<struct<name:string,confidence:double,sources:array<string>>>")):
        m = m.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    located = (F.col("city") != "") | (F.col("region") != "") | (F.col("country") != "")
    linked = (F.col("linkedin") != "") | (F.col("github") != "") | (F.col("portfolio") != "") | (F.size("other") > 0)
    years = worked_years(F.col("experience"))
    given = F.col("years_experience.v")
    computed = (F.coalesce(given, F.lit(0.0)) == 0) & years.isNotNull()
    has = lambda n: F.size(n) > 0

    def entry(present: Column, field: str, source: Column, method: str) -> Column:
        return F.when(present, F.struct(F.lit(field).alias("field"), source.alias("source"), F.lit(method).alias("method")))

    def chosen(n: str) -> Column:
        return entry(F.col(n).isNotNull(), n, F.col(f"{n}.s"), "source_trust_hierarchy")

    primary = F.col("primary")
    provenance = F.filter(
        F.array(
            chosen("full_name"), entry(has("emails"), "emails", primary, "union_all_sources"), entry(has("phones"), "phones", primary, "union_all_sources"),
            entry(located, "location", primary, "merge_properties"), entry(linked, "links", primary, "merge_properties"), chosen("headline"), chosen("years_experience"),
            chosen("repository_count"), entry(has("experience"), "experience", primary, "union_all_sources"),
            entry(computed, "years_experience", F.lit("calculated"), "date_diff_sum"), entry(has("education"), "education", primary, "union_all_sources"),
            entry(has("skills"), "skills", primary, "merge_properties"),
        ),
        lambda x: x.isNotNull(),
    ).cast(PROVENANCE)
    m = m.withColumn("provenance", provenance)
    flags = [F.col("full_name").isNotNull(), has("emails"), has("phones"), located, linked, F.col("headline").isNotNull(), has("skills"), has("experience"), has("education")]
    complete = sum((f.cast("int") for f in flags), F.lit(0)) / F.lit(9.0)
    weights = F.aggregate(F.col("provenance"), F.lit(0.0), lambda acc, p: acc + trust_weight(p["source"]))
    mean = F.when(F.size("provenance") > 0, weights / F.size("provenance")).otherwise(F.lit(0.5))
    return m.select(
        GROUP,
        F.when(has("emails"), stable_id(F.array_min("emails"))).otherwise(F.uuid()).alias("candidate_id"),
        F.coalesce("full_name.v", F.lit("")).alias("full_name"), "emails", "phones",
        F.struct("city", "region", "country").cast(LOCATION).alias("location"),
        F.struct("linkedin", "github", "portfolio", "other").cast(LINKS).alias("links"),
        F.col("headline.v").alias("headline"),
        F.when(computed, years).otherwise(given).alias("years_experience"),
        "skills", "experience", "education", F.col("repository_count.v").alias("repository_count"), "provenance",
        round_half_even(complete * mean, 2).alias("overall_confidence"),
    ).select(GROUP, *CANONICAL_FIELDS)
