"""Consolidation of matches and choice of survivors."""

import random

from pyspark.sql import functions as F

from unifold.llm.components import connected_components, edges_from_keys
from unifold.llm.records import record_groups
from unifold.llm.standins import is_stand_in, stand_in
from unifold.llm.survivor import field_candidates, fused_survivors, stated_order


def union_find(ids, edges):
    root = {i: i for i in ids}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def components(spark, ids, edges):
    i = spark.createDataFrame([(x,) for x in ids], "id bigint")
    e = spark.createDataFrame(edges, "a bigint, b bigint")
    return dict(connected_components(i, e).collect())


def test_random_graphs_chains_and_stars(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(150)] + [(2000, 2001 + i) for i in range(50)] + [(3050, 3000 + i) for i in range(50)]
    ids = sorted({x for e in edges for x in e} | {9999})
    assert components(spark, ids, edges) == union_find(ids, edges)


def test_empty_null_and_repeated_edges(spark):
    assert components(spark, [], []) == {}
    assert components(spark, [1, 1, 2, 3], [(2, 1), (2, 1), (1, 2), (3, 3), (None, 3), (3, None)]) == {1: 1, 2: 1, 3: 3}


def test_hot_key_is_a_star_not_a_clique(spark):
    keyed = spark.range(2000).select("id", F.lit("hot").alias("key"), F.lit("x").alias("salt"))
    edges = edges_from_keys(keyed)
    assert edges.count() < 2 * 2000
    assert components(spark, range(2000), [tuple(e) for e in edges.collect()]) == dict.fromkeys(range(2000), 0)


SCHEMA = "record_no bigint, full_name string, headline string, emails array<string>, phones array<string>, links struct<github:string>, provenance array<struct<field:string,source:string,method:string>>, updated_at timestamp, group_no string, value string"


def rows(spark, *values):
    base = {"full_name": None, "headline": None, "emails": None, "phones": None, "links": None, "provenance": None, "updated_at": None, "group_no": "clash", "value": "clash"}
    return spark.createDataFrame([{**base, **v} for v in values], SCHEMA)


def test_record_groups(spark):
    df = rows(
        spark, {"record_no": 5, "emails": [" A@x.example ", None, " "]}, {"record_no": 3, "emails": ["a@X.example"], "phones": ["(200) 555-0100"]},
        {"record_no": 9, "phones": ["+1 200 555 0100"], "links": {"github": "https://h.example/Foo/?x#y"}}, {"record_no": 8, "links": {"github": "foo"}},
        {"record_no": 7, "phones": ["12345", ""], "emails": [], "links": {"github": " "}}, {"record_no": 6, "phones": ["12345"]}, {"record_no": None, "emails": ["a@x.example"]},
    )
    assert dict(record_groups(df).collect()) == {5: 3, 3: 3, 9: 3, 8: 3, 7: 7, 6: 6}
    assert record_groups(df.limit(0)).count() == 0


def test_groups_of_the_small_tables(spark, small):
    df = spark.read.parquet(f"{small}/output_default.parquet")
    from unifold.functions.identifiers import identifier_keys

    keyed = df.select("record_no", F.explode(identifier_keys(F.col("emails"), F.col("phones"), F.col("links.github"))).alias("k")).collect()
    first, edges = {}, []
    for r in keyed:
        edges.append((r.record_no, first.setdefault(r.k, r.record_no)))
    assert dict(record_groups(df).collect()) == union_find([r.record_no for r in df.select("record_no").collect()], edges)


STAND_INS = [None, "", "  ", "—", "[redacted]", "N.N.", "unknown", "TBD", "Candidate 17", "Applicant #4", "???", "xxx", "n/a", "<full_name>", "\xa0", "(no name)", "test test", "see attachment", "to be added", "(EMPTY)", "keine Angabe", "[insert headline]", "Headline", "null", "no headline provided", "headline goes here"]
NAMES = ["Ada Stone", "X Æ Stone", "Wei Na", "Owner at Hillgate", "Engineer", "Null Island Labs engineer", "Ann", "Nil Stone"]


def test_stand_ins(spark):
    df = spark.createDataFrame([(v,) for v in STAND_INS + NAMES], "v string")
    got = [r[0] for r in df.select(is_stand_in(F.col("v"))).collect()]
    assert got == [True] * len(STAND_INS) + [False] * len(NAMES)
    assert [stand_in(v) for v in STAND_INS + NAMES] == got


def entry(field, source, method="source_trust_hierarchy"):
    return {"field": field, "source": source, "method": method}


def test_stated_order(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2025, 1, n)
    df = rows(
        spark, {"record_no": 1, "full_name": "Best source", "provenance": [entry("full_name", "resume"), entry("full_name", "ats_json"), entry("headline", "ats_json", "union_all_sources")], "headline": "old", "updated_at": day(1)},
        {"record_no": 2, "full_name": "n/a", "provenance": [entry("full_name", "ats_json")], "headline": "new", "updated_at": day(3)},
        {"record_no": 3, "full_name": "Other", "provenance": None, "headline": "tie", "updated_at": day(3)}, {"record_no": 4, "headline": "undated"},
        {"record_no": 10, "full_name": "Alone"}, {"record_no": 20, "full_name": "-"}, {"record_no": 21, "full_name": None},
    )
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (20, 20), (21, 20)], "record_no bigint, group_no bigint")
    got = {(r.group_no, r.field_name): r.record_no for r in fused_survivors(field_candidates(df, groups), stated_order()).collect()}
    assert got == {(1, "full_name"): 1, (1, "headline"): 2}
    assert fused_survivors(field_candidates(df.limit(0), groups), stated_order()).count() == 0


def test_fusion_discounts_copies(spark):
    """Two sources that copy each other's false values don't outvote two independent ones."""
    r = random.Random(1)
    claims = []
    for g in range(400):
        wrong = f"wrong {g} {r.randrange(10)}"
        for source, right in (("ats_json", r.random() < 0.85), ("github", r.random() < 0.85)):
            claims.append((g, 4 * g + len(source), "full_name", f"right {g}" if right else f"slip {g} {source}", source))
        copied = f"right {g}" if r.random() < 0.3 else wrong
        claims += [(g, 4 * g + 1, "full_name", copied, "resume"), (g, 4 * g + 2, "full_name", copied, "recruiter_notes"), (g, 4 * g + 3, "full_name", copied, "linkedin")]
    df = spark.createDataFrame(claims, "group_no bigint, record_no bigint, field_name string, value string, source string").withColumn("weight", F.lit(0.5)).withColumn("updated_at", F.lit(None).cast("timestamp"))
    got = fused_survivors(df).collect()
    good = sum(x.value == f"right {x.group_no}" for x in got)
    assert len(got) == 400 and good > 340 and all(0 < x.posterior <= 1 for x in got)
    assert fused_survivors(df.limit(0)).count() == 0


def test_fusion_keeps_every_value_and_source(spark):
    import datetime as dt

    claims = [(1, i, "full_name", "Ada Stone", "resume", dt.datetime(2025, 1, 1)) for i in range(49)] + [(1, 99, "full_name", "Ida Stone", "resume", dt.datetime(2025, 1, 2))]
    claims += [(2, 200, "full_name", "Ben Hill", "partner_feed", None), (2, 201, "full_name", "Ben Hill", "legacy_import", None), (2, 202, "full_name", "Bob Hall", "unheard", None)]
    df = spark.createDataFrame(claims, "group_no bigint, record_no bigint, field_name string, value string, source string, updated_at timestamp")
    got = {r.group_no: (r.value, r.support) for r in fused_survivors(df).collect()}
    assert got == {1: ("Ada Stone", 1), 2: ("Ben Hill", 2)}
