"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder; projection and filters of the caller reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
