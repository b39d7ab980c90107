"""Trust weights of sources."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of each known source; every other source has DEFAULT_TRUST.
TRUST_WEIGHTS = {
    "ats_json": 0.95,
    "recruiter_csv": 0.90,
    "github": 0.80,
    "linkedin": 0.80,
    "resume": 0.70,
    "recruiter_notes": 0.50,
}
DEFAULT_TRUST = 0.50


def trust_weight(source: Column) -> Column:
    """Weight of a source name; null and unknown names have the default."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in TRUST_WEIGHTS.items()))
    return F.coalesce(F.try_element_at(table, F.coalesce(source, F.lit(""))), F.lit(DEFAULT_TRUST))
