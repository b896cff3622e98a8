"""The extraction ledger as a stream: each event once, however late it arrives, into an append-only table.

The table is its own memory: it lies in folders by day, and a batch is held against the ids of the days it touches, so
that no state grows with the stream and no event is too late.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import kept_until_end, own_dir


def ledger_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a ledger folder as a stream of events with their day. Events without id or time are left out."""
    schema = spark.read.parquet(path).schema
    every = f"{path[:-1]}[{path[-1]}]"  # a pattern, so that the path may be a folder or one file
    events = spark.readStream.schema(schema).parquet(every).where("event_id is not null and event_ts is not null")
    return events.withColumn("event_ts", F.col("event_ts").cast("timestamp")).withColumn("day", F.to_date("event_ts"))


def _stored(spark: SparkSession, table: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def appended(stream: DataFrame, table: str, checkpoint: str) -> None:
    """What has arrived so far, appended to a Parquet table by day; a later call goes on where this one ended.

    An event is told by its id and day: one that the table or the batch has already is not added, also where a failed
    batch is run again.
    """

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["event_id", "day"])
        if _stored(batch.sparkSession, table):
            known = batch.sparkSession.read.parquet(table).select("event_id", "day")
            touched = batch.select("day").distinct()
            fresh = fresh.join(known.join(F.broadcast(touched), "day", "left_semi"), ["event_id", "day"], "left_anti")
        fresh.write.mode("append").partitionBy("day").parquet(table)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ledger_days(spark: SparkSession, path: str) -> DataFrame:
    """(day, strategy_used, n_events, n_escalated) of the stream's events, by the day they happened."""
    folder = f"{own_dir(spark)}/ledger-{uuid.uuid4().hex}"
    appended(ledger_stream(spark, path), f"{folder}/table", f"{folder}/state")
    kept_until_end(spark)
    kept = spark.read.parquet(f"{folder}/table")
    return kept.groupBy(F.date_format("event_ts", "yyyy-MM-dd").alias("day"), "strategy_used").agg(
        F.count("*").alias("n_events"), F.sum(F.coalesce(F.col("escalated").cast("int"), F.lit(0))).alias("n_escalated")
    )
