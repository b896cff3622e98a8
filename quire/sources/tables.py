"""Readers of the tables, with the columns that the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder; a reader prunes its columns by selecting them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
