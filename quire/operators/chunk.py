"""Logical units from typed blocks, and their chunking under five structure rules.

R1 tables stand alone; R2 a figure takes up a caption that follows it; R3 lists stand alone, long ones are split at
lines; R4 headers stand alone and name the section of what follows; R5 cross-references are kept. Other units are
merged greedily while their contents together stay within a size.

Order within a document is `pos`. A document may hold a large share of all rows: what runs through a document
(the section in force, the runs of units between barriers, the chunk that is open where a bucket ends) is found per
bucket of positions first and carried over buckets as one row each, so that no task holds a document. Roles and
chunks are decided on types and lengths alone; contents are joined once, at the end.

Defined cases: null contents count as empty; repeated units of an id count once; documents without headers have no
section; a unit larger than the size is a chunk of its own; equal positions are ordered by id; a unit without a type
is merged like text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import CAPTION, CROSS_REFERENCE, content_hash, cross_references, stripped, word_count
from quire.operators.arrivals import first_arrivals
from quire.session import staged

# What each block type becomes, and the size of a chunk.
CHUNK_TYPES = {"text": "text", "table": "table", "figure": "figure", "header": "header", "footer": "text", "list": "list", "section_header": "header", "caption": "figure"}
MAX_CHARS = 1200
BUCKET = 512  # positions of a document that one window takes
UNPLACED = 1 << 16  # buckets over which a document's units without a position are spread; they come first, by a hash of their ids


def logical_units(blocks: DataFrame) -> DataFrame:
    """(ldu_id, doc_id, pos, chunk_type, content, token_count, content_hash, first_page, pages, x0..y1) of blocks with text."""
    slim = blocks.select("block_id", "extracted_at", "doc_id", "pos", "block_type", "provenance.spans", stripped(F.coalesce(F.col("text"), F.lit(""))).alias("content"))
    rows = first_arrivals(slim, "block_id", "extracted_at")
    kinds = F.create_map(*[F.lit(x) for pair in CHUNK_TYPES.items() for x in pair])
    spans = F.coalesce(F.col("spans"), F.array())
    pages = F.array_sort(F.array_distinct(F.filter(F.transform(spans, lambda s: s["page"]), lambda p: p > 0)))
    box = F.get(F.filter(F.transform(spans, lambda s: s["bbox"]), lambda b: F.size(b) > 0), F.lit(0))
    side = lambda i, default: F.coalesce(F.get(box, F.lit(i)), F.lit(default))
    digest = content_hash(F.col("content"))
    return rows.where("content <> ''").select(
        F.concat("doc_id", F.lit("-ldu-"), "pos", F.lit("-"), F.substring(digest, 1, 10)).alias("ldu_id"),
        "doc_id", "pos", F.coalesce(kinds[F.col("block_type")], F.lit("text")).alias("chunk_type"), "content",
        word_count(F.col("content")).alias("token_count"), digest.alias("content_hash"),
        F.get(pages, F.lit(0)).alias("first_page"), F.size(pages).alias("n_pages"),
        side(0, 0.0).alias("x0"), side(1, 0.0).alias("y0"), side(2, 612.0).alias("x1"), side(3, 792.0).alias("y1"),
    )


def carried(rows: DataFrame, values: dict[str, Column], back: bool = False, strict: bool = False) -> DataFrame:
    """rows (doc_id, seq, bucket) with, for each name, the last value that is not null at or before each row of its document.

    back: the first one at or after it; strict: the row's own value does not count.
    """
    held = rows.select("*", *(v.alias(f"_v_{n}") for n, v in values.items()))
    edge = F.min_by if back else F.max_by
    last = [edge(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("seq"))).alias(f"_b_{n}") for n in values]
    every = held.groupBy("doc_id", "bucket").agg(*last)
    way = F.desc if back else F.asc
    before = Window.partitionBy("doc_id").orderBy(way("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    passed = every.select("doc_id", "bucket", *(F.last(f"_b_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in values))
    here = Window.partitionBy("doc_id", "bucket").orderBy(way("seq")).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    both = held.join(passed, ["doc_id", "bucket"])
    found = [F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(here), F.col(f"_p_{n}")).alias(n) for n in values]
    return both.select(*rows.columns, *found)


def sequenced(units: DataFrame) -> DataFrame:
    """units, each once, with `seq`: their place in the document without gaps, and its bucket.

    What is given is shuffled and written once: give lengths and flags in place of contents.
    """
    rows = first_arrivals(units, "ldu_id", "ingested_at").where("doc_id is not null").withColumn("_b", F.coalesce(F.floor(F.col("pos") / BUCKET), F.pmod(F.xxhash64("ldu_id"), F.lit(UNPLACED)) - UNPLACED))
    rows = staged(rows, "arrived-units")
    counts = rows.groupBy("doc_id", "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("doc_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("doc_id", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    here = Window.partitionBy("doc_id", "_b").orderBy("pos", "ldu_id")
    placed = rows.join(offsets, ["doc_id", "_b"]).withColumn("seq", F.col("_o") + F.row_number().over(here))
    return placed.withColumn("bucket", F.floor(F.col("seq") / BUCKET)).drop("_b", "_o")


def with_contents(rows: DataFrame, units: DataFrame, *columns: str) -> DataFrame:
    """rows (ldu_id, ingested_at, ...) with columns of the units they stand for; exact copies of a unit come along."""
    held = units.where("ldu_id is not null").select(F.col("ldu_id").alias("_id"), F.col("ingested_at").alias("_at"), *columns)
    return rows.join(held, (F.col("ldu_id") == F.col("_id")) & F.col("ingested_at").eqNullSafe(F.col("_at"))).drop("_id", "_at")


def list_parts(text: Column, size: int = MAX_CHARS) -> Column:
    """The parts of a list, split at lines: a line opens a new part where it would make the part too long."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit(None).cast("string").alias("part"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        full = (acc["n"] + F.length(line) > size) & acc["part"].isNotNull()
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["part"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["part"].isNull(), line).otherwise(F.concat(acc["part"], F.lit("\n"), line)).alias("part"),
            F.when(full, F.length(line)).otherwise(acc["n"] + F.length(line) + 1).cast("int").alias("n"),
        )

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: F.array_compact(F.concat(acc["done"], F.array(acc["part"]))))


def openings(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a chunk opened at each unit of a bucket: where the next opens, and the sum and place of the one open at the end."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    nxt = np.maximum(np.searchsorted(total, total[:-1] + most, side="right") - 1, np.arange(1, n + 1))
    left, last = np.zeros(n, dtype=np.int64), np.arange(n)
    for j in range(n - 1, -1, -1):
        if nxt[j] >= n:
            left[j] = min(total[n] - total[j], most + 1)
        else:
            left[j], last[j] = left[nxt[j]], last[nxt[j]]
    return nxt, left, last


def first_opening(sizes: np.ndarray, held: int, most: int) -> int:
    """The first unit of a bucket that a chunk holding `held` characters (-1: none is open) cannot take; past the end if none."""
    return 0 if held < 0 else max(0, int(np.searchsorted(np.concatenate([[0], np.cumsum(sizes)]), most - held, side="right")) - 1)


def passage(sizes: np.ndarray, seqs: np.ndarray, most: int) -> list[dict]:
    """What a bucket makes of each sum that the chunk open before it may hold, as steps (from, shift, left, opened).

    From that sum on: with shift the sum grows by the bucket's own, else the chunk opened at `opened` holds `left`.
    """
    _, left, last = openings(sizes, most)
    steps = [{"from": -1, "shift": False, "left": int(left[0]), "opened": int(seqs[last[0]])}]
    held, total = 0, int(sizes.sum())
    if total <= most:
        steps.append({"from": 0, "shift": True, "left": total, "opened": -1})
        held = most - total + 1
    for h in range(held, most + 2):
        k = min(first_opening(sizes, h, most), len(sizes) - 1)
        step = {"shift": False, "left": int(left[k]), "opened": int(seqs[last[k]])}
        if {x: steps[-1][x] for x in step} != step or h == 0:
            steps.append({"from": h, **step})
    return steps


def entries(buckets: list[dict]) -> list[tuple[int, int, int]]:
    """(bucket, held, opened): the chunk open before each bucket of a run, given the buckets' passages in order."""
    held, opened, out = -1, -1, []
    for x in buckets:
        out.append((x["b"], held, opened))
        step = [s for s in x["steps"] if s["from"] <= held][-1]
        held, opened = (held + step["left"], opened) if step["shift"] else (step["left"], step["opened"])
    return out


def merged_runs(loose: DataFrame, size: int) -> DataFrame:
    """(doc_id, seq, chunk_seq) of units (doc_id, seq, run, n): the first unit of the chunk that each is merged into.

    Lengths n are added up greedily to at most size along each run. Each bucket's passage from the sum before it to the
    sum after it is found by itself; a run folds one short row of each bucket, and the buckets then cut their chunks.
    """
    packs = loose.groupBy("doc_id", "run", F.floor((F.col("seq") - F.col("run")) / BUCKET).alias("b")).agg(F.array_sort(F.collect_list(F.struct("seq", "n"))).alias("u"))
    packs = staged(packs.select("doc_id", "run", "b", F.transform("u", lambda x: x["seq"]).alias("seqs"), F.transform("u", lambda x: x["n"]).alias("sizes")), "unit-runs")
    long = packs.where("b > 0").select("doc_id", "run").distinct()

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x[["doc_id", "run", "b"]].assign(steps=[passage(np.asarray(n), np.asarray(s), size) for n, s in zip(x["sizes"], x["seqs"])])

    steps = packs.join(long, ["doc_id", "run"], "left_semi").mapInPandas(passages, "doc_id string, run bigint, b bigint, steps array<struct<from:int,shift:boolean,left:int,opened:bigint>>")
    runs = steps.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("b", "steps"))).alias("buckets"))

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(d, r, *e) for d, r, buckets in zip(x["doc_id"], x["run"], x["buckets"]) for e in entries(buckets)]
            yield pd.DataFrame(rows, columns=["doc_id", "run", "b", "held", "opened"])

    before = runs.mapInPandas(folded, "doc_id string, run bigint, b bigint, held int, opened bigint")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            docs, places, starts = [], [], []
            for doc, seqs, sizes, held, opened in zip(x["doc_id"], x["seqs"], x["sizes"], x["held"], x["opened"]):
                seqs = np.asarray(seqs)
                start = np.full(len(seqs), opened, dtype=np.int64)
                if len(seqs) == 1 and held < 0:
                    start[0] = seqs[0]
                else:
                    sizes = np.asarray(sizes)
                    nxt, _, _ = openings(sizes, size)
                    k = first_opening(sizes, held, size)
                    while k < len(seqs):
                        start[k : nxt[k]] = seqs[k]
                        k = nxt[k]
                docs += [doc] * len(seqs)
                places.append(seqs)
                starts.append(start)
            if docs:
                yield pd.DataFrame({"doc_id": docs, "seq": np.concatenate(places), "chunk_seq": np.concatenate(starts)})

    every = packs.join(before, ["doc_id", "run", "b"], "left").fillna(-1, ["held", "opened"])
    return every.mapInPandas(cut, "doc_id string, seq bigint, chunk_seq bigint")


def roles(units: DataFrame, size: int = MAX_CHARS) -> DataFrame:
    """(ldu_id, ingested_at, doc_id, seq, chunk_seq, taken, parent_section): the chunk of each unit, told without contents."""
    bare = stripped(F.coalesce("content", F.lit("")))
    slim = units.select(
        "ldu_id", "doc_id", "pos", "chunk_type", "ingested_at", F.length(F.coalesce("content", F.lit(""))).alias("n"),
        F.when(F.col("chunk_type") == "header", bare).alias("title"), bare.rlike(CAPTION).alias("captions"),
    )
    # each bucket takes the last row of the one before, so that every row sees the one before it
    at = F.col("seq") % BUCKET
    place = lambda shift, role: F.struct((F.col("bucket") + shift).alias("b"), F.lit(role).alias("role"))
    twice = sequenced(slim).select("*", F.inline(F.array_compact(F.array(place(0, 0), F.when(at == BUCKET - 1, place(1, -1))))))
    before = F.lag("chunk_type").over(Window.partitionBy("doc_id", "b").orderBy("seq"))
    rows = twice.withColumn("caption", F.coalesce((before == "figure") & F.col("captions"), F.lit(False))).where("role = 0").drop("b", "role", "captions")
    rows = staged(rows, "unit-flags")
    # a caption is taken up unless its figure was itself taken up: every second one of a run
    rows = carried(rows, {"run_start": F.when(~F.col("caption"), F.col("seq"))})
    rows = rows.withColumn("taken", F.col("caption") & ((F.col("seq") - F.col("run_start")) % 2 == 1))
    alone = F.coalesce(F.col("chunk_type").isin("header", "table", "figure", "list"), F.lit(False)) & ~F.col("taken")
    rows = staged(rows.withColumn("alone", alone).drop("caption", "run_start"), "unit-roles")
    rows = staged(carried(rows, {"barrier": F.when(F.col("alone") | F.col("taken"), F.col("seq")), "parent_section": F.col("title")}).drop("title"), "unit-barriers")
    merged = merged_runs(rows.where("not alone and not taken").select("doc_id", "seq", F.coalesce("barrier", F.lit(0)).alias("run"), "n"), size)
    keep = ["ldu_id", "ingested_at", "doc_id", "seq", "chunk_seq", "taken", "parent_section"]
    stand = rows.where("alone or taken").withColumn("chunk_seq", F.when(F.col("taken"), F.col("seq") - 1).otherwise(F.col("seq")))
    return stand.select(*keep).unionByName(rows.where("not alone and not taken").join(merged, ["doc_id", "seq"]).select(*keep))


def chunked(units: DataFrame, size: int = MAX_CHARS) -> DataFrame:
    """(doc_id, seq, part, ldu_id, chunk_type, content, parent_section, content_hash, n_units, cross_refs) of the chunks."""
    rows = with_contents(roles(units, size), units, "chunk_type", "content", "content_hash").withColumn("content", F.coalesce("content", F.lit("")))
    packs = rows.groupBy("doc_id", "chunk_seq").agg(
        F.array_sort(F.collect_list(F.struct("seq", "taken", "ldu_id", "chunk_type", "content", "content_hash"))).alias("u"), F.max("parent_section").alias("parent_section")
    )
    once = packs.withColumn("u", F.filter("u", lambda x, i: (i == 0) | (F.get("u", i - 1)["seq"] != x["seq"])))
    own = F.filter("u", lambda x: ~x["taken"])
    caption = F.get(F.filter("u", lambda x: x["taken"]), F.lit(0))["content"]
    head = F.get("own", F.lit(0))
    text = F.array_join(F.filter(F.transform("own", lambda x: stripped(x["content"])), lambda x: x != ""), "\n\n")
    named = F.concat(F.regexp_replace(head["content"], r"\s+$", ""), F.lit("\n[Caption]: "), stripped(F.col("caption")))
    several = F.size("own") > 1
    made = once.select("doc_id", F.col("chunk_seq").alias("seq"), "parent_section", own.alias("own"), caption.alias("caption")).select(
        "doc_id", "seq", head["ldu_id"].alias("ldu_id"), F.when(several, "text").otherwise(head["chunk_type"]).alias("chunk_type"),
        F.when(several, text).when(F.col("caption").isNotNull(), named).otherwise(head["content"]).alias("content"),
        "parent_section", F.element_at("own", -1)["content_hash"].alias("content_hash"), F.size("own").alias("n_units"),
    )
    parts = F.when((F.col("chunk_type") == "list") & (F.length("content") > size), list_parts(F.col("content"), size)).otherwise(F.array("content"))
    split = made.withColumn("refs", cross_references(F.col("content"))).select("*", F.size(parts).alias("n_parts"), F.posexplode(parts).alias("part", "piece"))
    return split.select(
        "doc_id", "seq", "part", F.when(F.col("n_parts") > 1, F.concat("ldu_id", F.lit("-part"), "part")).otherwise(F.col("ldu_id")).alias("ldu_id"),
        "chunk_type", F.col("piece").alias("content"), "parent_section", "content_hash", "n_units", F.array_join("refs", "; ").alias("cross_refs"),
    )


def violations(units: DataFrame) -> DataFrame:
    """(doc_id, ldu_id, rule, message) where a unit breaks R4 (section not that of the header before), R1 (empty table) or R5 (references not kept)."""
    bare = stripped(F.coalesce("content", F.lit("")))
    slim = units.select(
        "ldu_id", "doc_id", "pos", "chunk_type", "parent_section", "ingested_at", F.when(F.col("chunk_type") == "header", bare).alias("title"),
        (bare == "").alias("empty"), F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(CROSS_REFERENCE), F.lit(0)).alias("refs"), F.coalesce(F.size("provenance.cross_refs"), F.lit(0)).alias("kept"),
    )
    rows = carried(staged(sequenced(slim), "checked-units"), {"expected": F.col("title")})
    wrong = F.array_compact(
        F.array(
            F.when((F.col("chunk_type") != "header") & (F.col("expected") != "") & ~F.col("expected").eqNullSafe(F.col("parent_section")), "R4"),
            F.when((F.col("chunk_type") == "table") & F.col("empty"), "R1"),
            F.when((F.size("refs") > 0) & (F.col("kept") <= 0), "R5"),
        )
    )
    place = F.col("seq") - 1
    said = (
        F.when(F.col("rule") == "R4", F.format_string("R4 violation at LDU %d (%s): parent_section missing or mismatched (expected '%s', got '%s')", place, "ldu_id", "expected", F.coalesce("parent_section", F.lit("None"))))
        .when(F.col("rule") == "R1", F.format_string("R1 violation at LDU %d: empty table LDU", place))
        .otherwise(F.format_string("R5 violation at LDU %d (%s): cross-refs ['%s'] not stored in meta", place, "ldu_id", F.array_join("refs", "', '")))
    )
    return rows.withColumn("rule", F.explode(wrong)).select("doc_id", "ldu_id", "rule", said.alias("message"))
