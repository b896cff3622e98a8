"""Page index and section tree of documents, from their units."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import entities, heading_level, shortened, stripped, summary
from quire.operators.arrivals import first_arrivals
from quire.operators.chunk import BUCKET, carried, sequenced, with_contents
from quire.operators.keys import sized
from quire.session import staged

# Names, figures and sentences of a section's joined contents, as their patterns have them.
NAMES = re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+")
FIGURES = re.compile(r"\$[\d,\.]+\s*(?:million|billion|B|M|K)?|\d[\d,\.]*%", re.I)
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
MOST_ENTITIES, SUMMARY_CHARS, ROOT_UNITS = 8, 300, 50
AROUND = 8  # units before and after a bucket that its texts are read with


def _pages_of(spans: Column) -> Column:
    return F.filter(F.transform(F.coalesce(spans, F.array()), lambda s: s["page"]), lambda p: p > 0)


def _unit_page_numbers() -> Column:
    refs = F.coalesce("page_refs", F.array())
    return F.array_distinct(F.when(F.size(refs) > 0, F.filter(refs, lambda p: p > 0)).otherwise(_pages_of(F.col("provenance.spans"))))


def _page_sizes(rows: DataFrame, key: str, time: str, kind: str, text: str, pages: Column) -> DataFrame:
    """(doc_id, kind, size, page): the length of each row's snippet on each of its pages; rows count once, texts stay behind."""
    slim = rows.select(key, time, "doc_id", F.col(kind).alias("kind"), F.length(shortened(F.col(text))).alias("size"), pages.alias("pages"))
    return first_arrivals(slim, key, time).select("doc_id", "kind", "size", F.explode("pages").alias("page"))


def _counted(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("doc_id", "page").agg(F.count("*").alias("item_count"), F.sum("size").alias("char_count"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("data_types"))


def unit_pages(units: DataFrame) -> DataFrame:
    """(ldu_id, ingested_at, doc_id, pos, chunk_type, snippet, content_hash, box, pages) of each unit; pages are those it lies on."""
    whole = F.when(F.size("bounding_box") == 4, F.col("bounding_box"))
    rows = units.select("ldu_id", "ingested_at", "doc_id", "pos", "chunk_type", shortened(F.col("content")).alias("snippet"), "content_hash", whole.alias("box"), _unit_page_numbers().alias("pages"))
    return first_arrivals(rows, "ldu_id", "ingested_at")


def block_pages(blocks: DataFrame) -> DataFrame:
    """As `unit_pages`, of extracted blocks."""
    box = F.get(F.filter(F.transform(F.coalesce("provenance.spans", F.array()), lambda s: s["bbox"]), lambda b: F.size(b) == 4), F.lit(0))
    rows = blocks.select(
        "block_id", "extracted_at", "doc_id", "pos", F.col("block_type").alias("chunk_type"), shortened(F.col("text")).alias("snippet"),
        F.col("provenance.content_hash").alias("content_hash"), box.alias("box"), F.array_distinct(_pages_of(F.col("provenance.spans"))).alias("pages"),
    )
    return first_arrivals(rows, "block_id", "extracted_at")


def page_index(units: DataFrame) -> DataFrame:
    """(doc_id, page, item_count, char_count, data_types) of each page with units."""
    return _counted(_page_sizes(units, "ldu_id", "ingested_at", "chunk_type", "content", _unit_page_numbers()))


def page_items(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, page, source, unit_id, pos, chunk_type, snippet, content_hash, x0..y1): the items of each page.

    A page's blocks come before its units, each in their order (source, pos, unit_id); units alone keep their id.
    """
    own = block_pages(blocks).select("doc_id", F.lit("extracted_block").alias("source"), F.col("block_id").alias("unit_id"), "pos", "chunk_type", "snippet", "content_hash", "box", F.explode("pages").alias("page"))
    other = unit_pages(units).select("doc_id", F.lit("ldu").alias("source"), F.col("ldu_id").alias("unit_id"), "pos", "chunk_type", "snippet", "content_hash", "box", F.explode("pages").alias("page"))
    sides = [F.get("box", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return own.unionByName(other).where("doc_id is not null").select("doc_id", "page", "source", "unit_id", "pos", "chunk_type", "snippet", "content_hash", *sides)


def document_pages(blocks: DataFrame, units: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, page, item_count, char_count, data_types) of each page of each document: its blocks and its units.

    A document of which neither names a page has the pages 1 to page_count of its profile, without items.
    """
    own = _page_sizes(blocks, "block_id", "extracted_at", "block_type", "text", F.array_distinct(_pages_of(F.col("provenance.spans"))))
    pages = staged(_counted(own.unionByName(_page_sizes(units, "ldu_id", "ingested_at", "chunk_type", "content", _unit_page_numbers())).where("doc_id is not null")), "document-pages")
    counts = profiles.where("doc_id is not null").groupBy("doc_id").agg(F.greatest(F.coalesce(F.max("page_count"), F.lit(1)), F.lit(1)).alias("n"))
    bare = counts.join(pages.select("doc_id").distinct(), "doc_id", "left_anti")
    empty = bare.select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("page"), F.lit(0).cast("bigint").alias("item_count"), F.lit(0).cast("bigint").alias("char_count"), F.lit("").alias("data_types"))
    return pages.unionByName(empty)


def page_lookups(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """asked (doc_id, page, ...) with found, item_count, char_count and data_types of that page; one that the index lacks is not found.

    pages as `document_pages` has them. A null document or page is found nowhere.
    """
    rows = asked.join(pages, ["doc_id", "page"], "left")
    return rows.select(*asked.columns, F.col("item_count").isNotNull().alias("found"), "item_count", "char_count", "data_types")


def document_indexes(pages: DataFrame, tree: DataFrame) -> DataFrame:
    """(doc_id, page_count, item_count, data_types, section_count, summary_mode): what a document's page index says of itself.

    pages as `document_pages` has them, tree as `document_sections`; section_count counts top sections.
    """
    types = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("data_types", ","))))), ",")
    of_pages = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum("item_count").alias("item_count"), F.regexp_replace(types, "^,", "").alias("data_types"))
    tops = tree.where("parent_seq is null").groupBy("doc_id").agg(F.count("*").alias("section_count"))
    return of_pages.join(tops, "doc_id", "left").select("*", F.lit("extractive").alias("summary_mode")).fillna(0, ["section_count"])


def _placed(units: DataFrame) -> DataFrame:
    """The units of documents in their order, without contents, with their first and last page and a header's title and level."""
    header = F.col("chunk_type") == "header"
    refs = F.when(F.size("page_refs") > 0, F.col("page_refs"))
    content = F.coalesce("content", F.lit(""))
    rows = units.select(
        "ldu_id", "doc_id", "pos", "chunk_type", "ingested_at", refs.alias("page_refs"),
        F.when(header, F.substring(stripped(content), 1, 120)).alias("title"), F.when(header, F.coalesce(heading_level(content), F.lit(1))).alias("level"),
    )
    placed = sequenced(rows).withColumn("first_page", F.coalesce(F.get("page_refs", F.lit(0)), F.lit(1))).withColumn("last_page", F.coalesce(F.element_at("page_refs", -1), F.lit(1)))
    return staged(placed, "placed-units")


def sections(units: DataFrame) -> DataFrame:
    """(doc_id, seq, title, level, parent_seq, page_start, page_end, n_units, data_types) of each header's section.

    A header's parent is the last header before it with a smaller level; a section also ends on the page before the
    next header of its level or a smaller one. Units before the first header belong to no section. data_types are the
    types of its other units in the order in which they come. Levels are four, so parents and ends are carried over
    the headers of a document, one column per level.
    """
    return _header_sections(staged(_owned(_placed(units)), "owned-units"))


def _owned(placed: DataFrame) -> DataFrame:
    """The units from the first header on, with the place of the header whose section they are in."""
    return carried(placed, {"owner": F.when(F.col("chunk_type") == "header", F.col("seq"))}).where("owner is not null")


def _header_sections(rows: DataFrame) -> DataFrame:
    kinds = rows.where("chunk_type <> 'header'").groupBy("doc_id", F.col("owner").alias("seq"), "chunk_type").agg(F.min("seq").alias("first"), F.max("last_page").alias("page"), F.count("*").alias("n"))
    member = kinds.groupBy("doc_id", "seq").agg(
        F.max("page").alias("member_page"), F.sum("n").alias("n_units"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "chunk_type"))), lambda x: x["chunk_type"]), ",").alias("data_types"),
    )
    heads = rows.where("chunk_type = 'header'").select("doc_id", "seq", "bucket", "title", "first_page", "last_page", "level")
    heads = carried(heads, {f"up{k}": F.when(F.col("level") < k, F.col("seq")) for k in (2, 3, 4)})
    heads = carried(staged(heads, "header-parents"), {f"end{k}": F.when(F.col("level") <= k, F.col("first_page")) for k in (1, 2, 3, 4)}, back=True, strict=True)
    of_level = lambda name, levels: F.coalesce(*(F.when(F.col("level") == k, F.col(f"{name}{k}")) for k in levels))
    tree = heads.withColumn("parent_seq", of_level("up", (2, 3, 4))).withColumn("closing", of_level("end", (1, 2, 3, 4))).join(member, ["doc_id", "seq"], "left")
    return tree.select(
        "doc_id", "seq", "title", "level", "parent_seq", F.col("first_page").alias("page_start"),
        F.greatest("last_page", "member_page", F.col("closing") - 1).alias("page_end"), (F.coalesce("n_units", F.lit(0)) + 1).alias("n_units"), F.coalesce("data_types", F.lit("")).alias("data_types"),
    )


def document_sections(units: DataFrame) -> DataFrame:
    """As `sections` with the entities and summary of each, and one section 'Document' over all units of each document
    without headers, at seq 1; that one is described by its first 50 units."""
    placed = _placed(units)
    headless = placed.groupBy("doc_id").agg(F.max(F.coalesce(F.col("chunk_type") == "header", F.lit(False))).alias("headed")).where("not headed").select("doc_id")
    headless = staged(headless, "headless-documents")
    pages = F.coalesce("page_refs", F.array(F.lit(1)))
    bare = placed.join(sized(headless), "doc_id", "left_semi")
    root = bare.groupBy("doc_id").agg(
        F.lit(1).cast("bigint").alias("seq"), F.lit("Document").alias("title"), F.lit(1).alias("level"), F.lit(None).cast("bigint").alias("parent_seq"),
        F.coalesce(F.min(F.array_min(pages)), F.lit(1)).alias("page_start"), F.coalesce(F.max(F.array_max(pages)), F.lit(1)).alias("page_end"),
        F.count("*").alias("n_units"), F.array_join(F.array_sort(F.collect_set("chunk_type")), ",").alias("data_types"),
    )
    owned = staged(_owned(placed), "owned-units")
    first = bare.where(F.col("seq") <= ROOT_UNITS).withColumn("owner", F.lit(1).cast("bigint"))
    keep = ["ldu_id", "ingested_at", "doc_id", "seq", "bucket", "owner"]
    notes = section_notes(with_contents(owned.select(*keep).unionByName(first.select(*keep)), units, "content"))
    return _header_sections(owned).unionByName(root).join(notes, ["doc_id", "seq"], "left")


def bucket_notes(before: list[str], own: list[str], after: list[str]) -> tuple[list[str], list[str], list[str]]:
    """The names, figures and first sentences that begin in own, of a text that goes on before and after it."""
    text = " ".join([*before, *own, *after])
    start = len(" ".join(before)) + 1 if before else 0
    stop = start + len(" ".join(own)) + (1 if after else 0)
    found = lambda p: list(dict.fromkeys(m.group() for m in p.finditer(text) if start <= m.start() < stop))[:MOST_ENTITIES]
    whole = text if after else text.rstrip()
    first = 0 if before else len(whole) - len(whole.lstrip())
    begins = [first, *(m.end() for m in SENTENCE_END.finditer(whole, first))]
    ends = [*(m.start() for m in SENTENCE_END.finditer(whole, first)), len(whole)]
    sentences, size = [], 0
    for i, j in zip(begins, ends):
        if start <= i < stop and j - i > 20 and size < SUMMARY_CHARS:
            sentences.append(whole[i : min(j, i + SUMMARY_CHARS + 1)])
            size += j - i + 1
    return found(NAMES), found(FIGURES), sentences


def section_notes(owned: DataFrame) -> DataFrame:
    """(doc_id, seq, entities, summary) of each section, over the joined contents of its units in order.

    Texts are read per bucket of positions, with some units around it for what runs over its edges; a section then
    takes one short row of each of its buckets.
    """
    at = F.col("seq") % BUCKET
    place = lambda shift, role: F.struct((F.col("bucket") + shift).alias("b"), F.lit(role).alias("role"))
    places = F.array_compact(F.array(place(0, 0), F.when(at >= BUCKET - AROUND, place(1, -1)), F.when(at < AROUND, place(-1, 1))))
    rows = owned.select("doc_id", "owner", "seq", F.coalesce("content", F.lit("")).alias("content"), F.inline(places))
    texts = rows.groupBy("doc_id", "owner", "b").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("seq", "role", "content")))).alias("u"))
    part = lambda role: F.transform(F.filter("u", lambda x: x["role"] == role), lambda x: x["content"])
    texts = texts.where(F.exists("u", lambda x: x["role"] == 0)).select("doc_id", "owner", "b", part(-1).alias("before"), part(0).alias("own"), part(1).alias("after"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            notes = [bucket_notes(*map(list, x)) for x in zip(batch["before"], batch["own"], batch["after"])]
            kept = batch[["doc_id", "owner", "b"]]
            yield kept.assign(names=[n for n, _, _ in notes], figures=[f for _, f, _ in notes], sentences=[s for _, _, s in notes])

    read_rows = texts.mapInPandas(read, "doc_id string, owner bigint, b bigint, names array<string>, figures array<string>, sentences array<string>")
    each = read_rows.groupBy("doc_id", F.col("owner").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("b", "names", "figures", "sentences"))).alias("r"))
    flat = lambda c: F.flatten(F.transform("r", lambda x: x[c]))
    grown = F.aggregate(flat("sentences"), F.lit(""), lambda acc, s: F.when(F.length(acc) < SUMMARY_CHARS, F.concat(acc, s, F.lit(" "))).otherwise(acc))
    entities_ = F.slice(F.array_distinct(F.concat(flat("names"), flat("figures"))), 1, MOST_ENTITIES)
    return each.select("doc_id", "seq", F.array_join(entities_, "; ").alias("entities"), F.substring(stripped(grown), 1, SUMMARY_CHARS).alias("summary"))


def unit_notes(units: DataFrame) -> DataFrame:
    """(ldu_id, level, entities, summary) of each unit by itself; `section_notes` has those of whole sections."""
    c = F.col("content")
    notes = units.where("content is not null").select("ldu_id", "ingested_at", heading_level(c).alias("level"), F.array_join(entities(c), "; ").alias("entities"), summary(c).alias("summary"))
    return first_arrivals(notes, "ldu_id", "ingested_at").drop("ingested_at")
