"""Identifier keys: the forms in which two records' contact data are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unifold.functions.text import blank_to_null, strip

#: A number shorter than this is no phone number.
MIN_PHONE_DIGITS = 7
_EXTENSION = r"(?i)\s*(?:;\s*)?(?:ext\.?|extension|x|#)\s*\d+\s*$"


def email_key(c: Column) -> Column:
    """Case and outer blanks are ignored; blank gives null."""
    return blank_to_null(F.lower(c))


def phone_key(c: Column) -> Column:
    """International form as ``+digits``; null where there is no number.

    With ``+`` (or a leading ``00``) the digits include the country code. Without it, 10 digits
    or 11 that start with 1 are US numbers, 12 or more include the country code, and others are
    kept as bare digits, which match only the same bare digits. An extension is cut off.
    """
    s = F.regexp_replace(strip(c), _EXTENSION, "")
    return _international(F.startswith(s, F.lit("+")), F.regexp_replace(s, r"\D", ""))


def phone_keys(arr: Column) -> Column:
    """``phone_key`` of each element; inside a lambda nothing is shared, so each step is an array of its own."""
    bare = F.transform(arr, lambda x: F.regexp_replace(strip(x), _EXTENSION, ""))
    told = F.transform(bare, lambda s: F.struct(F.startswith(s, F.lit("+")).alias("plus"), F.regexp_replace(s, r"\D", "").alias("digits")))
    return F.transform(told, lambda x: _international(x["plus"], x["digits"]))


def _international(plus: Column, digits: Column) -> Column:
    n = F.length(digits)
    return (
        F.when(n < MIN_PHONE_DIGITS, F.lit(None).cast("string"))
        .when(plus, F.concat(F.lit("+"), digits))
        .when(F.startswith(digits, F.lit("00")) & (n > 11), F.concat(F.lit("+"), F.substring(digits, 3, 40)))
        .when(n == 10, F.concat(F.lit("+1"), digits))
        .when((n == 11) & F.startswith(digits, F.lit("1")), F.concat(F.lit("+"), digits))
        .when(n >= 12, F.concat(F.lit("+"), digits))
        .otherwise(digits)
    )


def handle_key(c: Column) -> Column:
    """Last path segment of a profile link, or the bare value, without query and fragment."""
    s = strip(F.lower(c))
    path = F.regexp_replace(F.regexp_replace(s, r"[?#].*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    parts = F.filter(F.split(path, "/"), lambda p: strip(p) != "")
    host_only = F.size(parts) <= 1
    is_url = F.contains(s, F.lit("://")) | F.contains(path, F.lit("/"))
    return blank_to_null(F.when(is_url & host_only, F.lit(None).cast("string")).otherwise(F.get(parts, F.size(parts) - 1)))


def array_of(c: Column) -> Column:
    """A null array counts as an empty one."""
    return F.coalesce(c, F.array().cast("array<string>"))


def identifier_keys(emails: Column, phones: Column, github: Column) -> Column:
    """Distinct keys of a record as ``e:``, ``p:`` and ``g:`` strings; kinds never meet."""
    def keyed(kind: str, arr: Column) -> Column:
        return F.transform(F.filter(arr, lambda x: x.isNotNull()), lambda x: F.concat(F.lit(kind), x))

    return F.array_distinct(
        F.concat(
            keyed("e:", F.transform(array_of(emails), email_key)),
            keyed("p:", F.transform(array_of(phones), phone_key)),
            keyed("g:", F.array(handle_key(github))),
        )
    )
