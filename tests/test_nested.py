"""Flattening of nested records."""

import json

from unifold.operators.nested import INVALID, child_table, flatten_json

LISTS = ("experience", "skills", "skills.sources")


def test_shapes_labels_and_edges(spark):
    deep = "[" * 100_000
    payloads = [
        json.dumps({"wrap": [{"candidate_id": 1, "skills": [None, "lone", {"name": "A", "sources": ["x", None, "y"]}], "experience": {"company": "C"}, "extras": {"history": [{"note": {"items": [{"v": 1}]}}]}},
                             {"candidate_id": 2, "skills": json.dumps([{"sources": "z"}]), "experience": "", "inner": {"candidate_id": 3}}]}),
        "", "  ", None, '{"candidate_id": 1', '{"candidate_id": NaN}', "null", deep, '{"candidate_id": "\\ud800", "skills": []}',
    ]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)] + [(None, payloads[0], "x")], "n bigint, p string, doc string")
    nodes = flatten_json(df, "n", "p", "candidate_id", LISTS).cache()
    sources = child_table(nodes, "skills.sources").orderBy("doc", "label").collect()
    assert [(r.label, r.parent_label, r.pos, r.value) for r in sources] == [("0.2.0", "0.2", 0, "x"), ("0.2.1", "0.2", 1, None), ("0.2.2", "0.2", 2, "y"), ("1.0.0", "1.0", 0, "z")]
    jobs = child_table(nodes, "experience", ("company",)).orderBy("label").collect()
    assert [(r.label, r.company) for r in jobs] == [("0.0", "C"), ("1.0", None)]
    skills = child_table(nodes, "skills", ("name",)).orderBy("label").collect()
    assert [(r.label, r.name, r.value) for r in skills] == [("0.0", None, None), ("0.1", None, "lone"), ("0.2", "A", None), ("1.0", None, None)]
    assert child_table(nodes, "extras.history.note.items", ("v",)).collect()[0].label == "0.0.0"
    assert sorted(r.candidate_id for r in child_table(nodes, "", ("candidate_id",)).where("doc = 0").collect()) == ["1", "2", "3"]
    assert {r.doc for r in nodes.where(f"table_name = '{INVALID}'").collect()} == {4, 5, 7}
    assert flatten_json(df.limit(0), "n", "p", "candidate_id").count() == 0


def test_found_equals_a_plain_walk(spark, small):
    from unifold.plans.nested_queries import p4_found

    def records(v):
        if isinstance(v, dict):
            yield from ([v] if "candidate_id" in v else [])
            for x in v.values():
                yield from records(x)
        elif isinstance(v, list):
            for x in v:
                yield from records(x)

    def listed(v):
        if isinstance(v, str) and v.startswith("["):
            v = json.loads(v)
        return [] if v is None else v if isinstance(v, list) else [v]

    want = set()
    for r in spark.read.parquet(f"{small}/output_default_json.parquet").collect():
        try:
            root = json.loads(r.payload or "")
        except ValueError:
            continue
        for i, p in enumerate(records(root)):
            for key, field in (("experience", "company"), ("provenance", "field")):
                want |= {(r.dump_no, i, f"{key}.{field}", j, 0) for j, e in enumerate(listed(p.get(key))) if isinstance(e, dict) and (e.get(field) or "").strip()}
            want |= {(r.dump_no, i, "skills.sources", j, k) for j, e in enumerate(listed(p.get("skills"))) if isinstance(e, dict) for k, s in enumerate(listed(e.get("sources"))) if s and s.strip()}
    rows = [tuple(r) for r in p4_found(spark, small).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
