"""The registry of the core's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from unifold.plans import core_queries, nested_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**core_queries.QUERIES, **nested_queries.QUERIES}
