"""Queries of the core operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unifold.functions.identifiers import handle_key
from unifold.functions.normalize import github_handle, normalize_country, normalize_date, normalize_phone, normalize_skill, stable_id
from unifold.functions.text import strip
from unifold.operators import extract as X
from unifold.operators import merge as M
from unifold.operators.enrich import enrich, wanted_handles
from unifold.operators.project import project
from unifold.operators.resolve import identifiers, resolve_entities
from unifold.runtime import cut_lineage, read_table
from unifold.schemas import EDUCATION
from unifold.sources.readers import github_records, profile_records, sheet_records

AS_OF = "2026-07"
CONFIG = {
    "fields": [
        {"path": "full_name", "type": "string", "required": True},
        {"path": "primary_email", "from": "emails[0]", "type": "string", "required": True},
        {"path": "phone", "from": "phones[0]", "type": "string", "normalize": "E164"},
        {"path": "skills", "from": "skills[].name", "type": "string[]", "normalize": "canonical"},
    ],
    "include_confidence": True,
    "on_missing": "null",
}
_SOURCE_GAP = 1_000_000_000_000


def _joined(c: Column) -> Column:
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|", "~")


def host_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The code-host table in the readers' form (user, repos)."""
    repos = F.transform("repos", lambda r: F.struct(r["name"].alias("name"), r["description"].alias("description"), r["created_at"].alias("created_at"), r["updated_at"].alias("updated_at"), r["repo_language"].alias("language")))
    return read_table(spark, d, "github_mock").select((F.col("profile_id") + 2 * _SOURCE_GAP).alias("ingest_idx"), F.col("user_profile").alias("user"), repos.alias("repos"))


def sheet(spark: SparkSession, d: str) -> DataFrame:
    return sheet_records(read_table(spark, d, "sample_csv").withColumn("ingest_idx", F.col("csv_row_id")))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Exported profiles as raw records; their source is the first provenance entry's."""
    t = read_table(spark, d, "output_default").withColumn("ingest_idx", F.col("record_no") + _SOURCE_GAP)
    return profile_records(t, F.coalesce(F.get("provenance", F.lit(0))["source"], F.lit("unknown")))


def all_records(spark: SparkSession, d: str) -> DataFrame:
    return sheet(spark, d).unionByName(profiles(spark, d)).unionByName(github_records(host_profiles(spark, d)))


def by_town(spark: SparkSession, d: str) -> DataFrame:
    """Profiles grouped by their town: few, large groups, to exercise the merge rules; without one, each by itself."""
    return profiles(spark, d).withColumn(M.GROUP, F.coalesce(F.col("location.city"), F.concat(F.lit("#"), "ingest_idx")))


def s1_sheet_records(spark: SparkSession, d: str) -> DataFrame:
    """Sheet rows as raw records."""
    job = F.get("experience", F.lit(0))
    return sheet(spark, d).select("ingest_idx", "source", "full_name", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"), job["company"].alias("company"), job["title"].alias("title"), job["end"].alias("job_end"))


def s9_github_records(spark: SparkSession, d: str) -> DataFrame:
    """Code-host profiles as raw records."""
    return github_records(host_profiles(spark, d)).select(
        "ingest_idx", "full_name", F.get("emails", F.lit(0)).alias("email"), F.col("location.city").alias("city"), F.col("location.region").alias("region"), F.col("location.country").alias("country"),
        F.col("links.github").alias("github"), F.col("links.portfolio").alias("portfolio"), "headline", _joined(F.transform("skills", lambda s: s["name"])).alias("skills"), "repository_count",
    )


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", "text")


def t1_emails(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in the documents."""
    return _documents(spark, d).select("doc_id", F.explode(X.extract_emails(F.col("text"))).alias("email"))


def t2_phones(spark: SparkSession, d: str) -> DataFrame:
    """Number-like strings in the résumés."""
    return resume_texts(spark, d).select("src", "doc_id", F.explode(X.extract_phones(F.col("text"))).alias("phone"))


def t3_links(spark: SparkSession, d: str) -> DataFrame:
    """Profile links in the documents and in the profiles' own link texts."""
    links = read_table(spark, d, "output_default").select(F.col("record_no").alias("doc_id"), F.concat_ws(" ", F.regexp_replace(F.col("links.linkedin"), "example", "com"), F.regexp_replace(F.lower(F.col("links.github")), "example", "com")).alias("text"))
    every = _documents(spark, d).select(F.lit("d").alias("src"), "doc_id", "text").union(links.select(F.lit("p").alias("src"), "doc_id", "text"))
    return every.select("src", "doc_id", X.first_match(F.col("text"), X.GITHUB).alias("github"), X.first_match(F.col("text"), X.LINKEDIN).alias("linkedin"))


def t4_names(spark: SparkSession, d: str) -> DataFrame:
    """First line of each document."""
    return _documents(spark, d).select("doc_id", F.coalesce(F.get(X.text_lines(F.col("text")), F.lit(0)), F.lit("")).alias("full_name"))


def resume_texts(spark: SparkSession, d: str) -> DataFrame:
    """(src, doc_id, text): the documents, and résumés written out from the profiles' fields."""
    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), F.coalesce(value, F.lit("")))

    def each(name: str, fn) -> Column:
        return F.array_join(F.transform(F.coalesce(F.col(name), F.array()), fn), "\n")

    text = F.coalesce
    schooling = each("education", lambda e: F.concat(F.lit("Course: "), text(e["degree"], F.lit("")), F.lit(" in "), text(e["field"], F.lit("")), F.lit(" "), text(e["end_year"].cast("string"), F.lit("")), F.lit("\n"), text(e["institution"], F.lit("?")), F.lit(", CGPA: 9")))
    work = each("experience", lambda x: F.concat(text(x["title"], F.lit("")), F.lit(" | "), text(x["company"], F.lit("")), F.lit("\n- "), text(x["summary"], F.lit(""))))
    place = F.concat_ws(", ", "location.city", "location.region", "location.country")
    written = F.concat_ws(
        "\n", "full_name", "headline", line("Phone: ", F.array_join("phones", " / ")), line("Mail: ", F.array_join("emails", " ")), F.when(place != "", line("LOCATION: ", place)),
        F.lit("Education:"), schooling, F.lit("SKILLS"), line("Main: ", F.array_join(F.transform("skills", lambda x: x["name"]), "; ")), F.lit("Projects"), work,
    )
    made = read_table(spark, d, "output_default").select(F.lit("p").alias("src"), F.col("record_no").alias("doc_id"), written.alias("text"))
    return _documents(spark, d).select(F.lit("d").alias("src"), "doc_id", "text").union(made)


def t5_sections(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the documents' sections."""
    blocks = F.array(*(F.struct(F.lit(h).alias("heading"), X.section_block(h).alias("block")) for h in X.HEADINGS))
    found = X.with_lines(_documents(spark, d)).select("doc_id", F.explode(blocks).alias("b")).where("b.block is not null")
    return found.select("doc_id", "b.heading", _joined(F.col("b.block")).alias("block"))


def t6_skills(spark: SparkSession, d: str) -> DataFrame:
    """Skills of the skills sections, in order."""
    blocks = X.with_lines(resume_texts(spark, d)).select("src", "doc_id", X.section_block("skills").alias("block"))
    return blocks.select("src", "doc_id", F.posexplode(X.split_skills(F.col("block"))).alias("pos", "skill"))


def t7_locations(spark: SparkSession, d: str) -> DataFrame:
    """Places stated in the résumés, and code-host locations, divided into city, region and country."""
    hosts = read_table(spark, d, "github_mock").where("user_profile.location <> ''").select(F.lit("h").alias("src"), F.col("profile_id").alias("doc_id"), X.split_location(strip(F.col("user_profile.location"))).alias("l"))
    stated = resume_texts(spark, d).where(F.rlike("text", F.lit(X.LOCATION))).select("src", "doc_id", X.location_of(F.col("text"), F.array().cast(EDUCATION)).alias("l"))
    return hosts.union(stated).select("src", "doc_id", "l.city", "l.region", "l.country")


def t8_places(spark: SparkSession, d: str) -> DataFrame:
    """Place of each résumé, guessed from the first institution where none is stated."""
    read = X.resume_records(resume_texts(spark, d).select("*", F.col("doc_id").alias("ingest_idx")).where("src = 'd'"))
    schools = read_table(spark, d, "output_default").select("record_no", F.concat_ws(", ", F.get("education", F.lit(0))["institution"], "location.city", "location.country").alias("inst"))
    none = F.lit(None).cast("string")
    edu = F.array(F.struct(F.col("inst").alias("institution"), none.alias("degree"), none.alias("field"), none.cast("int").alias("end_year")))
    guessed = schools.select(F.lit("p").alias("src"), F.col("record_no").alias("doc_id"), X.location_of(F.lit(""), edu).alias("l"))
    return read.select(F.lit("d").alias("src"), F.col("ingest_idx").alias("doc_id"), F.col("location").alias("l")).union(guessed).select("src", "doc_id", "l.city", "l.region", "l.country")


def t9_education(spark: SparkSession, d: str) -> DataFrame:
    """Education entries of the résumés."""
    blocks = X.with_lines(resume_texts(spark, d)).select("src", "doc_id", X.section_block("education").alias("block"))
    return blocks.select("src", "doc_id", F.posexplode(X.parse_education(F.col("block"))).alias("pos", "e")).select("src", "doc_id", "pos", "e.*")


def t10_projects(spark: SparkSession, d: str) -> DataFrame:
    """Project entries of the résumés."""
    blocks = X.with_lines(resume_texts(spark, d)).select("src", "doc_id", X.work_block().alias("block"))
    return blocks.select("src", "doc_id", F.posexplode(X.parse_projects(F.col("block"))).alias("pos", "e")).select("src", "doc_id", "pos", "e.company", "e.title", "e.summary")


def t11_headlines(spark: SparkSession, d: str) -> DataFrame:
    """Headlines of the documents."""
    return X.with_lines(_documents(spark, d)).select("doc_id", X.headline_of().alias("headline"))


def t12_resume_records(spark: SparkSession, d: str) -> DataFrame:
    """Whole raw records of the résumés."""
    texts = resume_texts(spark, d).withColumn("ingest_idx", F.when(F.col("src") == "d", F.col("doc_id")).otherwise(F.col("doc_id") + _SOURCE_GAP))
    r = X.resume_records(texts)
    return r.select("ingest_idx", "source", "full_name", F.size("emails").alias("n_emails"), F.size("phones").alias("n_phones"), "location.city", "location.country", "headline", F.size("skills").alias("n_skills"), F.size("experience").alias("n_jobs"), F.size("education").alias("n_education"))


def n1_phones(spark: SparkSession, d: str) -> DataFrame:
    """E.164 forms of the sheet's phones."""
    return read_table(spark, d, "sample_csv").select("csv_row_id", normalize_phone(F.col("phone")).alias("phone"))


def n2_dates(spark: SparkSession, d: str) -> DataFrame:
    """Months of the profiles' jobs."""
    jobs = read_table(spark, d, "output_default").select("record_no", F.posexplode("experience").alias("pos", "x"))
    return jobs.select("record_no", "pos", normalize_date(F.col("x.start_month"), AS_OF).alias("start_month"), normalize_date(F.col("x.end_month"), AS_OF).alias("end_month"))


def n3_countries(spark: SparkSession, d: str) -> DataFrame:
    """Country codes of the profiles."""
    return read_table(spark, d, "output_default").select("record_no", normalize_country(F.col("location.country")).alias("country"))


def n4_skills(spark: SparkSession, d: str) -> DataFrame:
    """Canonical skill names of the profiles."""
    t = read_table(spark, d, "output_default").select("record_no", F.posexplode("skills").alias("pos", "x"))
    return t.select("record_no", "pos", normalize_skill(F.col("x.name")).alias("skill"))


def n6_handles(spark: SparkSession, d: str) -> DataFrame:
    """Handles of the profiles' links."""
    return read_table(spark, d, "output_default").select("record_no", github_handle(F.col("links.github")).alias("handle"))


def n8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids of the sheet's addresses."""
    email = F.lower(strip(F.col("email")))
    return read_table(spark, d, "sample_csv").where(email != "").select("csv_row_id", stable_id(email).alias("id"))


def j1_shared_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers with the number of records that share them."""
    return identifiers(all_records(spark, d), handle_key).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n_records"), F.min("ingest_idx").alias("first"))


def j2_components(spark: SparkSession, d: str) -> DataFrame:
    """Group of every record of the three tables."""
    return resolve_entities(cut_lineage(all_records(spark, d)), handle_key).select("ingest_idx", "component_id")


def a1_scalars(spark: SparkSession, d: str) -> DataFrame:
    """First values by trust, with their sources."""
    s = M.scalars(M.ranked(by_town(spark, d)))
    return s.select(M.GROUP, "primary", F.col("full_name.v").alias("full_name"), F.col("full_name.s").alias("name_source"), F.col("headline.v").alias("headline"), F.col("headline.s").alias("headline_source"), F.col("repository_count.v").alias("repository_count"))


def a2_emails(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct addresses of each group, the first of them, and numbers."""
    found = M.lists(M.ranked(by_town(spark, d))).where((F.size("emails") > 0) | (F.size("phones") > 0))
    return found.select(M.GROUP, _joined(F.col("emails")).alias("emails"), F.array_min("emails").alias("first_email"), _joined(F.col("phones")).alias("phones"))


def a3_places_and_links(spark: SparkSession, d: str) -> DataFrame:
    """Location and links, property by property (A3, A4)."""
    base = M.ranked(by_town(spark, d))
    s = M.scalars(base).join(M.lists(base).select(M.GROUP, "other"), M.GROUP, "left")
    return s.select(M.GROUP, "city", "region", "country", "linkedin", "github", "portfolio", _joined(F.col("other")).alias("other"))


def a5_experience(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of each group, each company and title once, in order."""
    e = M.lists(M.ranked(by_town(spark, d)), AS_OF).select(M.GROUP, F.posexplode("experience").alias("pos", "x"))
    return e.select(M.GROUP, "pos", "x.*")


def a6_education(spark: SparkSession, d: str) -> DataFrame:
    """Education of each group, each institution and degree once, in order."""
    e = M.lists(M.ranked(by_town(spark, d))).select(M.GROUP, F.posexplode("education").alias("pos", "x"))
    return e.select(M.GROUP, "pos", "x.*")


def a7_skills(spark: SparkSession, d: str) -> DataFrame:
    """Skills of each group with confidence and sources, in order."""
    e = M.lists(M.ranked(by_town(spark, d))).select(M.GROUP, F.posexplode("skills").alias("pos", "x"))
    return e.select(M.GROUP, "pos", "x.name", "x.confidence", _joined(F.col("x.sources")).alias("sources"))


def a8_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Years, provenance and confidence of each group's profile."""
    m = M.merge_records(by_town(spark, d), AS_OF)
    return m.select(M.GROUP, "years_experience", _joined(F.transform("provenance", lambda p: F.concat_ws("/", p["field"], p["source"], p["method"]))).alias("provenance"), "overall_confidence")


def _projected(spark: SparkSession, d: str, **changes) -> tuple[DataFrame, DataFrame]:
    return project(read_table(spark, d, "output_default"), {**CONFIG, **changes})


def p5_projection(spark: SparkSession, d: str) -> DataFrame:
    """The profiles under the usual config."""
    valid, _ = _projected(spark, d)
    return valid.select("full_name", "primary_email", "phone", _joined(F.col("skills")).alias("skills"), "overall_confidence")


def p6_required_missing(spark: SparkSession, d: str) -> DataFrame:
    """Profiles that a required field's absence rejects."""
    _, rejects = _projected(spark, d, on_missing="error")
    return rejects


def p7_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Projected provenance: entries of fields that are in the output."""
    fields = [{"path": "candidate_id"}, {"path": "headline"}, {"path": "skills_named", "from": "skills[].name", "type": "string[]"}]
    valid, _ = project(read_table(spark, d, "output_default"), {"fields": fields, "include_provenance": True})
    return valid.select("candidate_id", "headline", F.size("provenance").alias("n_provenance"), F.coalesce(F.size("skills_named"), F.lit(0)).alias("n_skills"))


def u1_sources(spark: SparkSession, d: str) -> DataFrame:
    """Records of all sources in one, counted."""
    return all_records(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.min("ingest_idx").alias("first"))


def j4_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Code-host records that the profiles' links lead to."""
    records = profiles(spark, d)
    seen = read_table(spark, d, "github_mock").where("user_profile.public_repos = 0").select(F.lower("user_profile.login").alias("handle"))
    added = enrich(records, host_profiles(spark, d), seen, handle_key).where("source = 'github'").join(records.select("ingest_idx"), "ingest_idx", "left_anti")
    return added.select("full_name", F.col("links.github").alias("github"), "repository_count")


def u5_wanted_handles(spark: SparkSession, d: str) -> DataFrame:
    """Handles mentioned but not fetched yet."""
    seen = read_table(spark, d, "github_mock").select(F.lower("user_profile.login").alias("handle"))
    return wanted_handles(profiles(spark, d), seen, handle_key)


def profile_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """All three tables resolved and merged: one profile per person group."""
    merged = M.merge_records(resolve_entities(cut_lineage(all_records(spark, d)), handle_key), AS_OF)
    return merged.select(M.GROUP, "full_name", _joined(F.col("emails")).alias("emails"), _joined(F.col("phones")).alias("phones"), F.col("location.country").alias("country"), F.size("experience").alias("n_jobs"), F.size("skills").alias("n_skills"), "repository_count", "overall_confidence")


QUERIES = {
    f.__name__: f
    for f in (
        s1_sheet_records, s9_github_records, t1_emails, t2_phones, t3_links, t4_names, t5_sections, t6_skills, t7_locations, t8_places, t9_education, t10_projects, t11_headlines,
        t12_resume_records, n1_phones, n2_dates, n3_countries, n4_skills, n6_handles, n8_ids, j1_shared_identifiers, j2_components, a1_scalars, a2_emails, a3_places_and_links,
        a5_experience, a6_education, a7_skills, a8_profiles, p5_projection, p6_required_missing, p7_metadata, u1_sources, j4_enrichment, u5_wanted_handles, profile_pipeline,
    )
}
# The projection queries' names must not look like those of the numbered problems.
QUERIES = {("project_" + n[3:] if n[:3] in ("p5_", "p6_", "p7_") else n): f for n, f in QUERIES.items()}
