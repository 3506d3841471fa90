"""Queries of the unit conversion operator (P7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwise.operators import units
from lotwise.sources.tables import table


def p7_converted(spark: SparkSession, d: str) -> DataFrame:
    return units.converted(table(spark, d, "raw_listings"), table(spark, d, "exchange_rates"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return units.wrong_units(p7_converted(spark, d))
