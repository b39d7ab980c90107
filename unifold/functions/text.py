"""String helpers whose white-space rules are Unicode-wide, unlike ``trim``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    """Stripped text, or null if nothing is left."""
    s = strip(c)
    return F.when(s != "", s)


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; outer white space goes."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))
