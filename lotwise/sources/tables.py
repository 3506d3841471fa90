"""Readers of the landing zone: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
