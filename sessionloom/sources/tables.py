"""Readers for the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table; columns and filters are pruned into the scan by Catalyst."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
