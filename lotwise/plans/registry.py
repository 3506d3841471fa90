"""All registered queries of the core and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotwise.plans import function_queries, relational_queries, survey_queries, units_queries  # noqa: F401  (registers its queries)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return units_queries.p7_converted(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p7_found": units_queries.p7_found, "p7_converted": units_queries.p7_converted} | function_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(function_queries.ORACLES)
