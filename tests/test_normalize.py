"""Scalar normalisers against stated cases."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from unifold.functions.identifiers import handle_key, phone_key
from unifold.functions.normalize import github_handle, normalize_country, normalize_date, normalize_phone, normalize_skill, round_half_even, stable_id
from unifold.functions.text import strip
from unifold.functions.trust import trust_weight

CASES = {
    "phone": (normalize_phone, [("+1 555-0199", "+15550199"), ("(555) 0199", "+15550199"), ("+44 7911 123456", "+447911123456"), ("44 7911 123456", "+447911123456"), ("not-a-number", None), ("12345678901234", "+15678901234"), ("12345", None), ("", None), (None, None)]),
    "date": (lambda c: normalize_date(c, "2026-07"), [("January 2024", "2024-01"), ("06/2021", "2021-06"), ("2017", "2017-01"), ("Present", "2026-07"), ("2024-13", "2024-13"), ("summary 2020", "2020-03"), ("13/02/2024", "2024-02"), ("02/30/2024", None), ("2024-1-5", "2024-01"), ("2023-02-15T08:00:00Z", None), ("", None), (None, None)]),
    "country": (normalize_country, [("United States", "US"), ("India", "IN"), ("United Kingdom", "GB"), (" canada ", "CA"), ("China", "CH"), ("Brazil", "BR"), ("", None), (None, None)]),
    "skill": (normalize_skill, [("js", "JavaScript"), ("ReactJS", "React"), ("Python3", "Python"), (" Custom Skill ", "Custom Skill"), ("", ""), (None, "")]),
    "github": (github_handle, [("https://github.com/Foo", "foo"), ("github.com/user/repo", "repo"), ("https://github.com/", "github.com"), ("https://github.com/Foo/?tab=1", None), (" Bare ", "bare"), ("", None), (None, None)]),
    "handle": (handle_key, [("HTTPS://Host.example/Foo/#x", "foo"), ("foo?tab=1", "foo"), ("https://host.example/", None), ("  ", None), (None, None)]),
    "key": (phone_key, [("(200) 555-2502", "+12005552502"), ("1 200 555 2502", "+12005552502"), ("44 5550 030558", "+445550030558"), ("+44 (555) 0030558", "+445550030558"), ("12345", None), ("5550199", "5550199"), ("200.555.2501 x12", "+12005552501"), (None, None)]),
    "strip": (strip, [("  a b 　", "a b"), (None, None)]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    fn, cases = CASES[name]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string")
    got = dict(df.select("i", fn(F.col("v")).alias("r")).collect())
    assert {cases[i][0]: r for i, r in got.items()} == dict(cases)


def test_ids_are_name_based_uuids(spark):
    mails = ["a@x.example", "é@ü.example", "z" * 300]
    got = spark.createDataFrame([(m,) for m in mails], "m string").select("m", stable_id(F.col("m"))).collect()
    assert all(i == str(uuid.uuid5(uuid.NAMESPACE_DNS, m)) for m, i in got)


def test_rounding_is_exact(spark):
    r = random.Random(3)
    values = [0.0, 1.0, 0.245, 0.125, 0.375, 0.005] + [r.random() for _ in range(2000)] + [a / 9 * b / 20 for a in range(10) for b in range(21)]
    got = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", round_half_even(F.col("v"))).collect()
    assert [(v, x) for v, x in got if x != round(v, 2)] == []


def test_unknown_sources_have_the_default_weight(spark):
    got = spark.createDataFrame([("github",), ("elsewhere",), (None,)], "s string").select(trust_weight(F.col("s"))).collect()
    assert [x[0] for x in got] == [0.8, 0.5, 0.5]
