"""Facts of the form "field: value" in units, and look-ups in the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import FACT, FACT_UNITS, MONEY_FACT, stripped
from quire.operators.arrivals import first_arrivals


def fact_unit(value: Column) -> Column:
    """The first of the known unit signs that the value contains, whatever its case."""
    found = F.lit(None).cast("string")
    for u in reversed(FACT_UNITS):
        found = F.when(F.lower(value).contains(u.lower()), u).otherwise(found)
    return found


def _numbered(number: int, pattern: str):
    """Of a match, its place and its two groups."""
    part = lambda x, g: F.regexp_extract(x, f"^(?:{pattern})$", g)
    return lambda x, i: F.struct(F.lit(number).alias("pattern_no"), i.alias("match_no"), part(x, 1).alias("f"), part(x, 2).alias("v"))


def extracted(units: DataFrame) -> DataFrame:
    """(ldu_id, pattern_no, match_no, field_name, value, unit, page) of each fact in the units' contents."""
    pairs = []
    for n, (pattern, sign) in enumerate(((FACT, "[:=]"), (MONEY_FACT, "[$£€]"))):
        whole = F.when(F.col("content").rlike(sign), F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).otherwise(F.array())
        pairs.append(F.transform(whole, _numbered(n, pattern)))
    slim = units.where("content is not null").select("ldu_id", "ingested_at", F.get("page_refs", F.lit(0)).alias("page"), F.concat(*pairs).alias("pairs"))
    each = first_arrivals(slim.where(F.size("pairs") > 0), "ldu_id", "ingested_at").select("ldu_id", "page", F.inline("pairs"))
    named = each.select("ldu_id", "pattern_no", "match_no", stripped(F.col("f")).alias("field_name"), stripped(F.col("v")).alias("value"), "page")
    return named.where("length(field_name) >= 3 and value <> ''").withColumn("unit", fact_unit(F.col("value")))


def looked_up(facts: DataFrame, field: str, most: int = 50, doc_id: str | None = None) -> DataFrame:
    """At most `most` facts, by id, whose field name contains the given text, in which % and _ stand for any text and any letter."""
    rows = facts if doc_id is None else facts.where(F.col("doc_id") == doc_id)
    return rows.where(F.lower("field_name").like(f"%{field.lower()}%")).select("id", "doc_id", "field_name", "value", "unit").dropDuplicates(["id"]).orderBy("id").limit(most)


def provenance(units: DataFrame) -> DataFrame:
    """(ldu_id, chunk_type, source_path, content_hash, spans): where each unit stands, its own spans or its pages with its box."""
    refs = F.transform(F.coalesce("page_refs", F.array().cast("array<int>")), lambda p: F.struct(p.alias("page"), F.col("bounding_box").alias("bbox")))
    spans = F.when(F.size("provenance.spans") > 0, F.col("provenance.spans")).otherwise(refs)
    slim = units.select("ldu_id", "ingested_at", "chunk_type", F.col("provenance.source_path").alias("source_path"), "content_hash", spans.alias("spans"))
    return first_arrivals(slim, "ldu_id", "ingested_at").drop("ingested_at")


def with_source(facts: DataFrame, units: DataFrame) -> DataFrame:
    """(id, field_name, value, chunk_type, has_source, document_name, page, x0, y0, x1, y1, content_hash, n_spans) of facts.

    Page and box are those of the unit's first span; a fact whose unit is unknown keeps its own page and hash.
    """
    known = provenance(units).withColumn("known", F.lit(True)).withColumnsRenamed({"source_path": "unit_path", "content_hash": "unit_hash"})
    rows = facts.select("id", "ldu_id", "field_name", "value", F.col("page").alias("own_page"), F.col("content_hash").alias("own_hash"), "source_path").dropDuplicates(["id"])
    first = F.get("spans", F.lit(0))
    path = F.coalesce(F.nullif(F.col("source_path"), F.lit("")), F.col("unit_path"))
    return rows.join(known, "ldu_id", "left").select(
        "id", "field_name", "value", "chunk_type", F.coalesce("known", F.lit(False)).alias("has_source"), F.regexp_extract(path, r"([^/]*)$", 1).alias("document_name"),
        F.when(F.col("known"), first["page"]).otherwise(F.col("own_page")).alias("page"), *(F.get(first["bbox"], F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))),
        F.when(F.col("known"), F.col("unit_hash")).otherwise(F.col("own_hash")).alias("content_hash"), F.when(F.col("known"), F.size("spans")).otherwise(0).alias("n_spans"),
    )


def fact_rows(extracted_facts: DataFrame, units: DataFrame, first_id: int = 0) -> DataFrame:
    """Extracted facts as rows for the fact table: with document, hash, source path and time; ids go on from first_id."""
    where = units.select("ldu_id", "ingested_at", "doc_id", "content_hash", F.coalesce("provenance.source_path", F.lit("")).alias("source_path"))
    own = first_arrivals(where, "ldu_id", "ingested_at").drop("ingested_at")
    rows = extracted_facts.join(own, "ldu_id")
    return rows.select(
        (F.monotonically_increasing_id() + first_id).alias("id"), "doc_id", "ldu_id", "field_name", "value", "unit", "page", "content_hash", "source_path", F.current_timestamp().alias("created_at")
    )


def selected(facts: DataFrame, query: str) -> DataFrame:
    """The result of one SELECT over the fact table, which the query calls {facts}; anything else is refused."""
    if not query.lstrip().upper().startswith("SELECT"):
        raise ValueError("only SELECT queries are allowed")
    return facts.sparkSession.sql(query, facts=facts)
