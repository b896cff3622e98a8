"""Texts of several sources drawn so that each source's share of all tokens meets its target.

Weighted fair queueing: the texts of a source are shuffled, each repetition anew; a text's virtual finish time is
the source's cumulative tokens over its target weight. Texts are drawn in the order of finish times up to the time T at
which the budget is spent: every source has then given its weight times T tokens, or all that its repetitions hold.
Where the text at the cut would overrun its source's part, later ones of the queue that still fit take its place, so
that shares are right to the size of short texts, however long some are.

The budget is a number of tokens. Without a given one it is that of all texts of the sources in the targets. A source
that runs out gives all it may; the others then share what it leaves by their weights, and the report has the share
that was within reach beside the target.

Defined cases: null and empty texts and texts without a known source are not drawn; sources in other spellings
count as their canonical name; a source without texts gives nothing and its weight is spread over the others; a
repeated row of a key counts once; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tokens import RANKS, sized_texts
from quire.session import staged

BUCKET_ROWS = 5000  # texts whose cumulative sizes one window takes; the sums before a bucket come from the bucket totals


def canonical(source: Column) -> Column:
    """A source's name without case and with one sign between words."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-]+", "_"), r"^_|_$", "")


def goals_of(targets: DataFrame) -> DataFrame:
    goals = targets.where("target_share > 0 and max_repeats > 0").select(canonical(F.col("source")).alias("source"), "target_share", "max_repeats")
    return goals.where("source is not null").dropDuplicates(["source"])


def sized_sources(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, ranks: str = RANKS) -> DataFrame:
    """(key, source, n_tokens) of the texts that may be drawn, each once, staged."""
    named = docs.select(key, text, canonical(F.col(source)).alias("source"))
    sized = sized_texts(named, key, text, keep=["source"], ranks=ranks).where("n_tokens > 0").dropDuplicates([key])
    return staged(sized.select(key, "source", "n_tokens").join(F.broadcast(goals_of(targets).select("source")), "source", "left_semi"), "sized-texts")


def planned(rows: DataFrame, targets: DataFrame, budget: float | None = None) -> list[dict]:
    """For each source that has texts: weight, total, tokens that it gives (`goal`), copies needed. One row per target.

    The virtual time of the cut is the one at which the sources' parts add up to the budget, none above its cap.
    """
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n_rows")).join(goals_of(targets), "source").collect()  # one row per target
    whole = sum(r["target_share"] for r in totals)
    wanted = sum(r["total"] for r in totals) if budget is None else budget
    plan = [{"source": r["source"], "weight": r["target_share"] / whole, "total": r["total"], "n_rows": r["n_rows"], "most": r["max_repeats"], "cap": r["total"] * r["max_repeats"]} for r in totals]
    spent, time, live = 0.0, float("inf"), sorted(plan, key=lambda p: p["cap"] / p["weight"])
    while live:  # the source that runs out first, then the next, until the rest can bear what is left
        time = (wanted - spent) / sum(p["weight"] for p in live)
        if live[0]["cap"] >= live[0]["weight"] * time:
            break
        spent += live.pop(0)["cap"]
    for p in plan:
        p["goal"] = float(p["cap"]) if p not in live else p["weight"] * time
        p["copies"] = max(1, min(p["most"], int(p["goal"] // p["total"]) + 1))
    return plan


def drawn_by(rows: DataFrame, plan: list[dict], key: str) -> DataFrame:
    """(key, source, copy_no, n_tokens, finish_time), in the order of drawing, of sized texts by a plan."""
    if not plan:
        return rows.select(key, "source", F.lit(1).alias("copy_no"), "n_tokens", F.lit(0.0).alias("finish_time"))
    table = rows.sparkSession.createDataFrame(
        [(p["source"], p["weight"], p["goal"], p["copies"], max(1, p["n_rows"] // BUCKET_ROWS)) for p in plan], "source string, weight double, goal double, copies int, buckets bigint"
    )
    copies = rows.join(F.broadcast(table), "source").withColumn("copy_no", F.explode(F.sequence(F.lit(1), "copies")))
    shuffled = copies.withColumn("spot", F.xxhash64(F.lit("mix"), "copy_no", F.col(key))).withColumn("bucket", F.pmod(F.shiftrightunsigned("spot", 8), F.col("buckets")))
    sums = shuffled.groupBy("source", "copy_no", "bucket").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.partitionBy("source").orderBy("copy_no", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).select("source", "copy_no", "bucket", "before")
    within = Window.partitionBy("source", "copy_no", "bucket").orderBy("spot", key).rowsBetween(Window.unboundedPreceding, 0)
    timed = shuffled.withColumn("here", F.sum("n_tokens").over(within)).join(before, ["source", "copy_no", "bucket"]).withColumn("given", F.col("before") + F.col("here"))
    timed = staged(timed.select(key, "source", "copy_no", "bucket", "spot", "n_tokens", "weight", "goal", "given"), "queued-texts")
    on_time = timed.where("given <= goal")
    # what the cut leaves of a source's part goes to texts behind the cut, from the bucket that it falls in
    late = timed.where("given > goal")
    cut = late.groupBy("source").agg(F.min(F.struct("copy_no", "bucket")).alias("c")).select("source", "c.*")
    spent = on_time.groupBy("source").agg(F.sum("n_tokens").alias("spent"))
    behind = late.join(F.broadcast(cut), ["source", "copy_no", "bucket"]).join(F.broadcast(spent), "source", "left").fillna(0, ["spent"])

    def fitting(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["spot", key])
        given, goal, kept, at = int(rest["spent"].iloc[0]), float(rest["goal"].iloc[0]), [], []
        for size in rest["n_tokens"]:
            fits = given + size <= goal
            given += size if fits else 0
            kept.append(fits)
            at.append(given)
        return rest.assign(given=at)[kept][[key, "source", "copy_no", "n_tokens", "weight", "given"]]

    columns = [key, "source", "copy_no", "n_tokens", "weight", "given"]
    kinds = dict(timed.dtypes)
    filled = behind.groupBy("source").applyInPandas(fitting, ", ".join(f"{c} {kinds[c]}" for c in columns))
    taken = on_time.select(*columns).unionByName(filled)
    return taken.select(key, "source", "copy_no", "n_tokens", (F.col("given") / F.col("weight")).alias("finish_time")).orderBy("finish_time", key, "copy_no")


def drawn(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, budget: float | None = None, ranks: str = RANKS) -> DataFrame:
    """(key, source, copy_no, n_tokens, finish_time), in the order of drawing: texts for `budget` tokens."""
    rows = sized_sources(docs, targets, key, text, source, ranks)
    return drawn_by(rows, planned(rows, targets, budget), key)


def shares(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, budget: float | None = None, ranks: str = RANKS) -> DataFrame:
    """(source, target_share, reachable_share, n_texts, n_tokens, actual_share, max_copies) of that drawing, a row for each target.

    reachable_share is the target, changed only where a source runs out within its repetitions.
    """
    rows = sized_sources(docs, targets, key, text, source, ranks)
    plan = planned(rows, targets, budget)
    whole = sum(p["goal"] for p in plan) or 1.0
    reach = rows.sparkSession.createDataFrame([(p["source"], p["goal"] / whole) for p in plan], "source string, reachable_share double")
    own = drawn_by(rows, plan, key).groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.max("copy_no").alias("max_copies"))
    goals = targets.select(canonical(F.col("source")).alias("source"), "target_share").dropDuplicates(["source"])
    both = goals.join(F.broadcast(reach), "source", "left").join(own, "source", "left").fillna(0, ["reachable_share", "n_texts", "n_tokens", "max_copies"])
    every = Window.partitionBy()
    return both.withColumn("actual_share", F.coalesce(F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(every), F.lit(0)), F.lit(0.0)))
