"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; projections and filters reach the scan through Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

