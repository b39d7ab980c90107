"""Normalisers of phones, dates, countries, skills and ids, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from unifold.functions.text import strip

# Country names and codes that are recognised.
COUNTRIES = {
    "US": ["united states", "united states of america", "usa", "us"],
    "IN": ["india", "ind", "in"],
    "GB": ["united kingdom", "uk", "great britain", "gb"],
    "CA": ["canada", "ca"],
    "DE": ["germany", "de"],
    "FR": ["france", "fr"],
    "AU": ["australia", "au"],
    "SG": ["singapore", "sg"],
}
# Spellings of skills that are recognised.
SKILL_NAMES = {
    "JavaScript": ["js", "javascript", "es6", "ecmascript"],
    "TypeScript": ["ts", "typescript"],
    "Python": ["py", "python", "python3"],
    "Go": ["golang", "go", "go lang"],
    "Kubernetes": ["k8s", "kubernetes"],
    "Amazon Web Services": ["aws", "amazon web services"],
    "Docker": ["docker", "containerization"],
    "SQL": ["sql", "postgresql", "mysql", "postgres"],
    "React": ["react", "reactjs", "react.js"],
}
# Month names in the order in which they are looked for.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Calling codes with the lengths their national numbers may have.
CALLING_CODES = {
    "1": [7, 10], "7": [10], "20": [8, 9, 10], "27": [9], "30": [10], "31": [9], "32": [8, 9], "33": [9], "34": [9], "36": [8, 9],
    "39": [6, 7, 8, 9, 10, 11], "40": [9], "41": [9], "43": [7, 8, 9, 10, 11, 12, 13], "44": [7, 9, 10], "45": [8], "46": [7, 8, 9],
    "47": [8], "48": [9], "49": [6, 7, 8, 9, 10, 11], "51": [8, 9], "52": [10], "54": [10, 11], "55": [10, 11], "56": [9], "57": [8, 10],
    "60": [8, 9, 10], "61": [9], "62": [8, 9, 10, 11, 12], "63": [8, 10], "64": [8, 9, 10], "65": [8], "66": [8, 9], "81": [9, 10],
    "82": [8, 9, 10], "84": [9, 10], "86": [10, 11], "90": [10], "91": [10], "92": [9, 10], "93": [9], "94": [9], "95": [7, 8, 9, 10],
    "98": [10], "212": [9], "213": [8, 9], "216": [8], "234": [8, 10], "254": [9], "351": [9], "352": [6, 8, 9], "353": [7, 8, 9],
    "354": [7, 9], "358": [7, 8, 9, 10], "359": [8, 9], "370": [8], "371": [8], "372": [7, 8], "380": [9], "385": [8, 9], "386": [8],
    "420": [9], "421": [9], "852": [8], "880": [8, 9, 10], "886": [8, 9], "966": [9], "971": [8, 9], "972": [8, 9], "974": [8],
}


def _lookup(table: dict[str, list[str]]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for v, keys in table.items() for k in keys))


def is_missing(c: Column, kind: str = "string") -> Column:
    """Null, an empty string or an empty array; zero is a value."""
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def normalize_country(c: Column) -> Column:
    """Known names give their code, others their first two letters in capitals; empty gives null."""
    key = F.lower(strip(c))
    return F.when(c != "", F.coalesce(F.try_element_at(_lookup(COUNTRIES), key), F.upper(F.substring(key, 1, 2))))


def normalize_skill(c: Column) -> Column:
    """Known spellings give the skill's name, others stay but for outer white space."""
    return F.coalesce(F.try_element_at(_lookup(SKILL_NAMES), F.lower(strip(c))), strip(c), F.lit(""))


def possible_number(digits: Column) -> Column:
    """Whether digits with a calling code have a length that the code's numbers may have.

    Calling codes are prefix-free, so at most one of the three prefixes is one.
    """
    table = F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, v))) for k, v in CALLING_CODES.items()))
    fits = [F.coalesce(F.array_contains(F.try_element_at(table, F.substring(digits, 1, n)), F.length(digits) - n), F.lit(False)) for n in (1, 2, 3)]
    return fits[0] | fits[1] | fits[2]


def normalize_phone(c: Column) -> Column:
    """E.164 form, or null.

    Read as a US number first (10 digits, 11 with the leading 1, or the 7 of a local number), or
    by its calling code after ``+``; then as if a ``+`` were missing; then by its digits alone: a
    local number gets area code 650, ten or more digits count as US unless they followed a ``+``.
    Numbers with a trunk zero or vanity letters are not resolved as a numbering library would.
    """
    s = strip(c)
    body = F.regexp_replace(F.regexp_replace(s, r"^[^+\d]+", ""), r"(?i)\s*(?:ext\.?|extension|x)\s*\d+\s*$", "")
    digits = F.regexp_replace(body, r"\D", "")
    n = F.length(digits)
    plus = F.startswith(body, F.lit("+"))
    us = (n == 10) | (n == 7)
    with_one = (n == 11) & F.startswith(digits, F.lit("1"))
    every = F.regexp_replace(s, r"\D", "")
    filled = (
        F.when(F.length(every) == 7, F.concat(F.lit("650"), every))
        .when((F.length(every) == 8) & F.startswith(every, F.lit("1")), F.concat(F.lit("650"), F.substring(every, 2, 7)))
        .otherwise(every)
    )
    international = F.concat(F.lit("+"), digits)
    return (
        F.when(plus & possible_number(digits), international)
        .when(~plus & us, F.concat(F.lit("+1"), digits))
        .when(~plus & with_one, international)
        .when(~F.startswith(s, F.lit("+")) & possible_number(digits), international)
        .when(F.length(filled) >= 10, F.when(F.startswith(s, F.lit("+")), F.concat(F.lit("+"), filled)).otherwise(F.concat(F.lit("+1"), F.substring(filled, -10, 10))))
    )


def normalize_date(c: Column, as_of: str | None = None) -> Column:
    """``YYYY-MM``, or null. "Present" and its like give ``as_of`` (today's month by default)."""
    now = F.lit(as_of) if as_of else F.date_format(F.current_date(), "yyyy-MM")
    s = F.lower(strip(c))

    def found(pattern: str, year: int, month: int | None) -> Column:
        m = F.lpad(F.regexp_extract(s, pattern, month), 2, "0") if month else F.lit("01")
        return F.when(F.rlike(s, F.lit(pattern)), F.concat_ws("-", F.regexp_extract(s, pattern, year), m))

    year = F.regexp_extract(s, r"\b(\d{4})\b", 1)
    named = F.lit(None).cast("string")
    for k in range(len(MONTHS), 0, -1):
        named = F.when(F.contains(s, F.lit(MONTHS[k - 1])), F.lit(f"{k:02d}")).otherwise(named)
    named = F.when((year != "") & named.isNotNull(), F.concat_ws("-", year, named))
    parsed = [F.date_format(F.try_to_timestamp(F.when(F.rlike(s, F.lit(shape)), s), F.lit(fmt)), "yyyy-MM") for shape, fmt in _DATE_FORMS]
    return F.when(s.isin("present", "current", "now"), now).otherwise(
        F.coalesce(found(r"^(\d{4})[-/](\d{1,2})$", 1, 2), found(r"^(\d{1,2})[-/](\d{4})$", 2, 1), found(r"^(\d{4})$", 1, None), named, *parsed)
    )


# Forms of full dates, in the order in which they are tried.
_DATE_FORMS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
]


def stable_id(email: Column) -> Column:
    """The name-based (SHA-1) UUID of an e-mail address in the DNS namespace."""
    space = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(email, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def github_handle(c: Column) -> Column:
    """Handle of a profile link: last path segment of a code-host address, else the value; cut at ? and #."""
    s = F.lower(strip(c))
    parts = F.filter(F.split(s, "/"), lambda p: p != "")
    last = F.when(F.contains(s, F.lit("github.com/")), F.get(parts, F.size(parts) - 1)).otherwise(s)
    handle = strip(F.substring_index(F.substring_index(last, "?", 1), "#", 1))
    return F.when(handle != "", handle)


def round_half_even(value: Column, places: int = 2) -> Column:
    """Round a value in [0, 1] as its exact binary value, ties to even; exact for doubles down to 2**-62."""
    scale = 10**places
    big = "decimal(38,0)"
    t = (value * F.lit(float(2**62))).cast("bigint").cast(big) * F.lit(2 * scale).cast("decimal(6,0)") + F.lit(2**62).cast("decimal(20,0)")
    wide = t.cast("decimal(30,0)")
    two63 = F.lit(2**62).cast("decimal(20,0)") * F.lit(2).cast("decimal(2,0)")
    rest = F.pmod(wide, two63)
    q = ((wide - rest) / two63).cast("bigint")
    return (q - F.when((rest == 0) & (q % 2 == 1), 1).otherwise(0)) / F.lit(float(scale))
