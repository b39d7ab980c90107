"""The pipeline from files to profiles, against profiles worked out by hand."""

import json

import pytest

from unifold.operators.merge import GROUP, merge_records
from unifold.operators.project import json_schema, project
from unifold.operators.resolve import resolve_entities
from unifold.plans.cli import main
from unifold.plans.pipeline import run_pipeline
from unifold.schemas import RAW_DDL
from unifold.sources.readers import read_github, read_resumes, read_sheet

SHEET = "﻿name,email,phone,current_company,title\nAda Stone,ada.stone@mail.example,+1 555-0199,Northmill,Engineer\n\nBen Reed,ben.reed@mail.example,44 7911 123456,Hillgate,\"Lead, \"\"Core\"\"\"\nShort Row,s@mail.example\n"
HOST = {
    "user": {"login": "adastone", "name": "Ada Stone ", "email": "ada.stone@mail.example", "bio": "Builds things.", "location": "Lake City, LC, USA", "html_url": "https://github.com/adastone", "blog": None, "public_repos": None},
    "repos": [{"name": "a", "language": "Python"}, {"name": "b", "language": "python "}, {"name": "c", "language": "Go"}, {"name": "d", "language": None}],
}
RESUME = """ADA STONE
Engineer at heart
Email: ada.stone@mail.example
Phone: 555-010-9999
Location: Lake City, LC, United States
See https://github.com/adastone
Skills:
Languages: JS, Go; SQL
Projects
P a y roll Tool | Spark, dbt
- Wrote it
and ran it
Education:
B.Tech in Physics 2015 -
Lake College, Lake City, CGPA: 9
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "sheet.csv").write_text(SHEET, encoding="utf-8")
    (tmp_path / "host.json").write_text(json.dumps(HOST, indent=1))
    (tmp_path / "cv").mkdir()
    (tmp_path / "cv" / "ada.TXT").write_text(RESUME)
    (tmp_path / "cv" / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "cv" / "empty.txt").write_text("")
    (tmp_path / "cv" / "note.md").write_text("ignored in folders")
    return tmp_path


def test_sheet(spark, files):
    rows = read_sheet(spark, str(files / "sheet.csv")).orderBy("ingest_idx").collect()
    assert [r.full_name for r in rows] == ["Ada Stone", "Ben Reed", "Short Row"]
    assert rows[1].experience[0].title == 'Lead, "Core"' and rows[0].experience[0].end == "Present"
    assert rows[2].phones == [] and rows[2].experience == []
    assert read_sheet(spark, str(files / "sheet.csv"), stop_at_bad_row=True).count() == 2
    assert read_sheet(spark, str(files / "none.csv")).count() == 0


def test_resume(spark, files):
    (r,) = read_resumes(spark, str(files / "cv")).collect()
    assert r.full_name == "ADA STONE" and r.emails == ["ada.stone@mail.example"] and r.phones == ["555-010-9999"]
    assert r.location.asDict() == {"city": "Lake City", "region": "LC", "country": "United States"}
    assert [s.name for s in r.skills] == ["JS", "Go", "SQL"] and r.headline == "Engineer at heart"
    assert r.links.github == "https://github.com/adastone"
    assert [e.asDict() for e in r.education] == [{"institution": "Lake College, Lake City", "degree": "B.Tech in Physics", "field": "Physics", "end_year": 2015}]
    assert [(e.title.replace(" ", ""), e.summary) for e in r.experience] == [("PayrollTool", "Technologies: Spark, dbt. Wrote it and ran it ")]
    assert read_resumes(spark, str(files / "cv" / "note.md")).count() == 1


def test_pdf_hook(spark, files):
    (files / "cv" / "x.pdf").write_bytes(b"%PDF")
    found = read_resumes(spark, str(files / "cv"), lambda b: ("Name\nxx@mail.example", ["mailto:x@mail.example", "https://me.github.io", "https://github.com/xx", "https://other.example"]))
    r = found.where("full_name = 'Name'").first()
    assert r.links.asDict() == {"linkedin": "", "github": "https://github.com/xx", "portfolio": "https://me.github.io", "other": ["https://other.example"]}
    assert r.emails == ["x@mail.example"]  # the longer address only contains the annotated one


def test_pipeline_and_projection(spark, files):
    config = {"fields": [{"path": "full_name", "required": True}, {"path": "mail", "from": "emails[0]", "required": True}, {"path": "skills", "from": "skills[].name", "type": "string[]", "normalize": "canonical"}], "include_confidence": True}
    out = run_pipeline(spark, str(files / "sheet.csv"), str(files / "cv"), str(files / "host.json"), config=config, as_of="2026-07")
    ada, ben, short = out.default.orderBy(GROUP).collect()
    assert ada.full_name == "Ada Stone" and ada.phones == ["+15550109999", "+15550199"] and ada.repository_count == 4
    assert [(s.name, s.confidence, s.sources) for s in ada.skills] == [("Python", 0.8, ["github"]), ("Go", 0.8, ["github", "resume"]), ("JavaScript", 0.7, ["resume"]), ("SQL", 0.7, ["resume"])]
    assert ada.location.asDict() == {"city": "Lake City", "region": "LC", "country": "US"}
    assert [p.field for p in ada.provenance] == ["full_name", "emails", "phones", "location", "links", "headline", "repository_count", "experience", "education", "skills"]
    assert ben.phones == ["+447911123456"] and ben.overall_confidence == 0.4
    assert [r.full_name for r in out.custom.orderBy("full_name").collect()] == ["Ada Stone", "Ben Reed", "Short Row"]
    assert out.rejects.count() == 0 and short.experience == []


def test_enrichment_is_one_hop_and_skips_what_was_fetched(spark, files):
    known = read_github(spark, str(files / "host.json"))
    assert run_pipeline(spark, resume_path=str(files / "cv"), profiles=known).default.first().repository_count == 4
    assert run_pipeline(spark, github="https://github.com/AdaStone/", profiles=known).default.count() == 1


def test_cli(spark, files, capsys):
    assert main([], spark) == 1
    assert main(["--csv", "x", "--config", str(files / "none.json")], spark) == 1
    (files / "c.json").write_text(json.dumps({"fields": [{"path": "phone", "from": "phones[0]"}, {"path": "full_name", "required": True}], "on_missing": "omit"}))
    out, custom = files / "deep" / "d.json", files / "deep" / "c.json"
    assert main(["--csv", str(files / "sheet.csv"), "--config", str(files / "c.json"), "--as-of", "2026-07", "--output-default", str(out), "--output-custom", str(custom)], spark) == 0
    assert [p["full_name"] for p in json.loads(out.read_text())] == ["Ada Stone", "Ben Reed", "Short Row"]
    assert {"full_name": "Short Row"} in json.loads(custom.read_text())


def _raw(spark, rows):
    return spark.createDataFrame([{"ingest_idx": i, **r} for i, r in enumerate(rows)], RAW_DDL)


def test_groups_follow_chains_and_ignore_names(spark):
    rows = [
        {"source": "resume", "emails": ["a@x.example"], "full_name": "Same"}, {"source": "resume", "phones": ["+15550199"]},
        {"source": "github", "emails": [" A@X.example "], "phones": ["(555) 0199"]}, {"source": "resume", "full_name": "Same"},
        {"source": "resume", "full_name": "Same", "emails": None, "phones": [None, ""]},
    ]
    got = dict(resolve_entities(_raw(spark, rows)).select("ingest_idx", "component_id").collect())
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert resolve_entities(_raw(spark, [])).count() == 0


def test_merge_rules(spark):
    job = lambda c, t, s=None, e=None: {"company": c, "title": t, "start": s, "end": e, "summary": " s "}
    rows = [
        {"source": "resume", "full_name": "Low", "emails": ["B@x.example"], "skills": [{"name": "Py"}, {"name": "Go", "confidence": 0.99}], "experience": [job("Acme ", "Dev", "2024-01", "Present"), job("Brick", "Dev", "2021-06", "December 2023"), job("", "None")]},
        {"source": "recruiter_csv", "full_name": "High", "emails": ["a@x.example"], "skills": [{"name": "python"}], "experience": [job("acme", " dev", None, "now")]},
        {"source": None, "full_name": "", "repository_count": 0},
    ]
    from pyspark.sql import functions as F

    (m,) = merge_records(_raw(spark, rows).withColumn("component_id", F.lit(7)), "2026-07").collect()
    assert m.full_name == "High" and m.emails == ["a@x.example", "b@x.example"] and m.repository_count == 0
    assert [(s.name, s.confidence, s.sources) for s in m.skills] == [("Python", 0.9, ["recruiter_csv", "resume"]), ("Go", 0.99, ["resume"])]
    assert [(e.company, e.title, e.start, e.end) for e in m.experience] == [("acme", "dev", None, "2026-07"), ("Brick", "Dev", "2021-06", "2023-12")]
    assert m.years_experience == 2.5 and ("years_experience", "calculated", "date_diff_sum") in [tuple(p) for p in m.provenance]


def test_projection_policies(spark, small):
    df = spark.createDataFrame([("1", "Ada", ["x"], 0.5), ("2", "", [], 0.7)], "candidate_id string, full_name string, emails array<string>, overall_confidence double")
    config = {"fields": [{"path": "full_name", "required": True}, {"path": "mail", "from": "emails[0]"}, {"path": "score", "from": "overall_confidence", "type": "number"}, {"path": "city", "from": "location.city"}], "include_confidence": True}
    valid, rejects = project(df, config)
    assert [tuple(r) for r in valid.collect()] == [("Ada", "x", 0.5, None, 0.5)]
    assert [(r.candidate_id, "full_name" in r.reason) for r in rejects.collect()] == [("2", True)]
    wrong, all_rejected = project(df, {"fields": [{"path": "emails", "type": "string"}]})
    assert wrong.count() == 1 and all_rejected.count() == 1  # an empty list is a missing value, not a wrong one
    assert project(df, config, compat_schema=True)[0].count() == 0
    schema = json_schema({"fields": [{"path": "a", "required": True}, {"path": "b"}, {"path": "c", "type": "string[]"}]})
    assert schema["properties"]["a"] == {"type": "string"} and schema["properties"]["b"] == {"type": ["string", "null"]} and schema["required"] == ["a"]
    assert json_schema({"fields": [{"path": "a", "required": True}, {"path": "b"}]}, compat_schema=True)["properties"]["a"] == {"type": ["string", "null"]}


def test_chains_of_any_length_and_hot_identifiers(spark):
    from pyspark.sql import functions as F

    chain = [{"source": "resume", "emails": [f"m{i}@x.example", f"m{i + 1}@x.example"]} for i in range(120)]
    hot = [{"source": "resume", "phones": ["+1 200 555 0100"]} for _ in range(300)]
    got = dict(resolve_entities(_raw(spark, chain + hot)).select("ingest_idx", "component_id").collect())
    assert got == {i: 0 if i < 120 else 120 for i in range(420)}
    df = _raw(spark, hot).withColumn("component_id", F.lit(1))
    assert merge_records(df).first().phones == ["+12005550100"]


def test_checkpoints_are_replaced(spark):
    import os

    from unifold.runtime import cut_lineage

    first = cut_lineage(spark.range(9).toDF("a"))
    at = first._checkpoint_file.removeprefix("file:")
    assert os.path.isdir(at)
    second = cut_lineage(first.selectExpr("a + 1 as a"), (first,))
    assert not os.path.exists(at) and second.count() == 9


def test_pdf_libraries_are_tried_in_turn(monkeypatch):
    """Stand-ins for the usual libraries: the first that finds text wins, each starts afresh."""
    import sys
    import types

    from unifold.sources.pdf import default_extractor

    def module(name, **members):
        m = types.ModuleType(name)
        m.__dict__.update(members)
        monkeypatch.setitem(sys.modules, name, m)

    class Link:
        def get_object(self):
            return {"/Subtype": "/Link", "/A": {"/URI": "https://me.example"}}

    class Page:
        annotations = [Link()]

        def __init__(self, text):
            self.extract_text = lambda: text

    module("pypdf", PdfReader=lambda f: types.SimpleNamespace(pages=[Page("Ada"), Page(None)]))
    assert default_extractor(b"x") == ("Ada\n\n", ["https://me.example"] * 2)
    module("pypdf", PdfReader=lambda f: types.SimpleNamespace(pages=[Page(" ")]))

    class Open:
        def __init__(self, f):
            self.pages = [Page("Ben")]

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    module("pdfplumber", open=Open)
    assert default_extractor(b"x") == ("Ben\n", ["https://me.example"])
    module("pdfplumber", open=None)
    module("pytesseract", image_to_string=lambda image: f"scan {image}")
    module("pdf2image", convert_from_bytes=lambda b: [1, 2])
    assert default_extractor(b"x")[0] == "scan 1\nscan 2\n"
    module("pytesseract")
    assert default_extractor(b"x")[0] == ""
