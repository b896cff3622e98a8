"""What a run over documents has left behind, a row for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _per_document(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col("doc_id").isNotNull()).select(key, "doc_id").distinct().groupBy("doc_id").agg(F.count("*").alias(name))


def run_summaries(profiles: DataFrame, blocks: DataFrame, units: DataFrame, violations: DataFrame, events: DataFrame) -> DataFrame:
    """(doc_id, strategy_used, confidence, n_blocks, n_units, n_violations, notes, error) of each document of profiles.

    Strategy, confidence and notes are those of the latest event. A document that failed stays as a row with an error:
    that no event tells of it, or that it has no blocks. Repeated rows count once; only keys are shuffled.
    """
    docs = profiles.where("doc_id is not null").select("doc_id").distinct()
    last = events.where("doc_id is not null and event_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("strategy_used", "confidence", "notes"), F.struct("event_ts", "event_id")).alias("e"))
    broken = violations.groupBy("doc_id").agg(F.count("*").alias("n_violations"))
    rows = docs.join(last, "doc_id", "left").join(_per_document(blocks, "block_id", "n_blocks"), "doc_id", "left").join(_per_document(units, "ldu_id", "n_units"), "doc_id", "left").join(broken, "doc_id", "left")
    rows = rows.fillna(0, ["n_blocks", "n_units", "n_violations"])
    error = F.when(F.col("e").isNull(), "not extracted").when(F.col("n_blocks") == 0, "no blocks")
    return rows.select("doc_id", "e.strategy_used", "e.confidence", "n_blocks", "n_units", "n_violations", "e.notes", error.alias("error"))
