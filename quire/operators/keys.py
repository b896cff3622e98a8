"""Joins that broadcast only what was counted, as the planner's estimates are of compressed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key set of at most this many rows is broadcast (some 20 MB); a larger one is joined by shuffle, where AQE splits skew.
BROADCAST_KEYS = 200_000


def shuffled(rows: DataFrame) -> DataFrame:
    """rows, marked to be joined by shuffle, however small the planner holds them.

    Its estimate is that of the file, compressed and before any explode: an index of words, held to be under 10 MB, was broadcast as 403 MB.
    """
    return rows.hint("merge")


def sized(keys: DataFrame) -> DataFrame:
    """keys, marked for broadcast if its counted rows are few enough, else for a shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else shuffled(keys)


def documents_of(profiles: DataFrame, *origins: str) -> DataFrame:
    """The distinct doc_id of profiles rows with one of the origin types."""
    return profiles.where(F.col("origin_type").isin(*origins) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
