"""Parquet tables with explicit schemas, and the rollup table's refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelake.schemas import TABLES


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table; the scan sees the declared schema, so pruning and pushdown apply."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")
