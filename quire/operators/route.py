"""Choice of the extraction strategy from candidates' confidences, with its trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Least confidence of strategies A and B by mode, of the steps of strategy C, and its languages.
POLICIES = {"economy": (0.92, 0.85), "balanced": (0.90, 0.80), "quality": (0.88, 0.78)}
MIN_C1, MIN_C2 = 0.60, 0.72
VISION_LANGUAGES = ["am", "ti", "mixed"]


def routed(candidates: DataFrame, mode: str = "balanced", vision: bool = True) -> DataFrame:
    """candidates (doc columns, origin_type, language, conf_a .. conf_c3) with strategy, step, confidence, trace, escalated.

    Missing origins count as not scanned. Scanned documents have no text layer: A is skipped, and B too where only
    the vision step reads the language. Without the vision step the better of C1 and C2 holds, C2 of equals.
    """
    min_a, min_b = POLICIES[mode]
    scanned = F.coalesce(F.col("origin_type"), F.lit("")) == "scanned_image"
    direct = scanned & F.coalesce(F.col("language").isin(VISION_LANGUAGES), F.lit(False))
    a_holds = ~scanned & (F.col("conf_a") >= min_a)
    b_holds = ~direct & (F.col("conf_b") >= min_b)
    in_c = F.when(F.coalesce(F.col("language").isin(VISION_LANGUAGES), F.lit(False)) & F.lit(vision), "C3")
    in_c = in_c.when(F.col("conf_c1") >= MIN_C1, "C1").when(F.col("conf_c2") >= MIN_C2, "C2")
    in_c = in_c.when(F.lit(vision), "C3").when(F.col("conf_c2") >= F.col("conf_c1"), "C2").otherwise("C1")
    step = F.when(a_holds, "A").when(b_holds, "B").otherwise(in_c)
    conf = lambda s: F.col(f"conf_{s.lower()}")
    confidence = F.coalesce(*(F.when(F.col("step") == s, conf(s)) for s in ("A", "B", "C1", "C2", "C3")))
    tried = F.array_compact(F.array(F.when(direct, "A+B-skipped").when(scanned, "A-skipped").otherwise("A"), F.when(~direct & ~a_holds, "B"), F.when(~a_holds & ~b_holds, in_c)))
    return candidates.withColumn("step", step).select(
        *candidates.columns, F.substring("step", 1, 1).alias("strategy"), "step", confidence.alias("confidence"),
        F.array_join(tried, ">").alias("trace"), (F.col("step") != "A").alias("escalated"),
    )



def cache_states(requests: DataFrame, extractions: DataFrame) -> DataFrame:
    """requests (doc_id, ...) with cache_hit and cache_reason from stored extractions (doc_id, payload).

    A stored payload counts if it is one JSON object that names the same document; of repeated ones any that does.
    """
    named = F.get_json_object("payload", "$.doc_id")
    state = F.when(F.col("payload").isNull() | ~F.trim(F.col("payload")).startswith("{") | F.try_parse_json("payload").isNull(), "invalid_cache")
    state = state.when(~named.eqNullSafe(F.col("doc_id")), "doc_id_mismatch").otherwise("cache_hit")
    stored = extractions.where("doc_id is not null").select("doc_id", state.alias("s")).groupBy("doc_id").agg(F.min_by("s", F.when(F.col("s") == "cache_hit", 0).otherwise(1)).alias("cache_reason"))
    both = requests.join(stored, "doc_id", "left").withColumn("cache_reason", F.coalesce("cache_reason", F.lit("cache_miss")))
    return both.withColumn("cache_hit", F.col("cache_reason") == "cache_hit")


def ledger_events(routes: DataFrame) -> DataFrame:
    """(doc_id, strategy_used, confidence, escalated, notes) to append to the ledger: what was chosen, and the way there."""
    return routes.select("doc_id", F.col("strategy").alias("strategy_used"), "confidence", F.col("strategy").isin("B", "C").alias("escalated"), F.col("trace").alias("notes"))
