"""Landed Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder ``folder``; columns and filters are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
