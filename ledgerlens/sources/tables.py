"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table. Only Spark opens the path, so it may lie in any store."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
