"""Rows that arrive again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_arrivals(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The earliest row of each key, rows without a time last; of rows equally early any, as they repeat each other.

    Null keys are dropped. Rows are sorted as they are given, so derive what is wanted of their texts first.
    """
    order = Window.partitionBy(key).orderBy(F.col(time).asc_nulls_last())
    return rows.where(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
