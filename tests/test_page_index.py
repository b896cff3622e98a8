"""Page index and sections of whole documents against plain loops over their rows."""

import datetime
import re

from quire.operators import page_index
from quire.plans import document_queries as R
from quire.sources.tables import table

PROVENANCE = "struct<spans:array<struct<page:int,bbox:array<double>>>>"


def short(text):
    t = (text or "").strip().replace("\n", " ")
    return t[:179].rstrip() + "…" if len(t) > 180 else t


def pages_by_loop(blocks, units, profiles):
    """As the reference builds them: blocks first, then units, else the pages of the profile."""
    span_pages = lambda r: {s.page for s in ((r.provenance and r.provenance.spans) or []) if s and s.page and s.page > 0}
    unit_pages = lambda r: {p for p in r.page_refs if p and p > 0} if r.page_refs else span_pages(r)
    items = {}
    for rows, key, time, of, kind, text in ((blocks, "block_id", "extracted_at", span_pages, "block_type", "text"), (units, "ldu_id", "ingested_at", unit_pages, "chunk_type", "content")):
        first = {}
        for r in sorted((r for r in rows if r[key]), key=lambda r: (r[time] is not None, r[time])):
            first.setdefault(r[key], r)
        for r in first.values():
            for p in of(r) if r.doc_id is not None else ():
                items.setdefault((r.doc_id, p), []).append((r[kind], len(short(r[text]))))
    seen = {d for d, _ in items}
    for r in profiles:
        if r.doc_id is not None and r.doc_id not in seen:
            items |= {(r.doc_id, p): [] for p in range(1, max(1, r.page_count or 1) + 1)}
    return {(d, p, len(x), sum(n for _, n in x), ",".join(sorted({k for k, _ in x if k}))) for (d, p), x in items.items()}


def test_document_pages(spark):
    now = datetime.datetime(2024, 1, 1)
    blocks = [("b1", "d", "section_header", "Head", ([(1, None)],), now), ("b1", "d", "text", "again", ([(9, None)],), now.replace(year=2025)), ("b2", "d", "text", "x" * 200, ([(1, None), (2, None), (2, None), (0, None)],), now), ("b3", "e", "text", "lost", None, now)]
    units = [("u1", "d", "text", "unit", [2, 3], None, now), ("u2", "d", "table", None, [], ([(1, None)],), now)]
    blocks = spark.createDataFrame(blocks, f"block_id string, doc_id string, block_type string, text string, provenance {PROVENANCE}, extracted_at timestamp")
    units = spark.createDataFrame(units, f"ldu_id string, doc_id string, chunk_type string, content string, page_refs array<int>, provenance {PROVENANCE}, ingested_at timestamp")
    profiles = spark.createDataFrame([("d", 7), ("e", 2), ("f", None), (None, 3)], "doc_id string, page_count int")
    got = {tuple(r) for r in page_index.document_pages(blocks, units, profiles).collect()}
    assert got == pages_by_loop(blocks.collect(), units.collect(), profiles.collect())
    assert got == {("d", 1, 3, 184, "section_header,table,text"), ("d", 2, 2, 184, "text"), ("d", 3, 1, 4, "text"), ("e", 1, 0, 0, ""), ("e", 2, 0, 0, ""), ("f", 1, 0, 0, "")}


def test_document_pages_of_the_tables(spark, folder):
    got = [tuple(r) for r in R.document_pages(spark, folder).collect()]
    want = pages_by_loop(*[table(spark, folder, t).collect() for t in ("blocks", "ldus", "profiles")])
    assert len(got) == len(want) and set(got) == want


UNIT = "ldu_id string, doc_id string, pos int, chunk_type string, content string, page_refs array<int>, ingested_at timestamp"


def made(spark, rows):
    """Units (doc_id, chunk_type, content, page_refs) in the order given."""
    return spark.createDataFrame([(f"{d}-{i:05}", d, i, kind, text, pages, datetime.datetime(2024, 1, 1)) for i, (d, kind, text, pages) in enumerate(rows)], UNIT)


def test_documents_without_headers_are_one_section(spark):
    rows = made(spark, [("d", "text", "a", [3, 4]), ("d", "table", "b", [2]), ("d", "text", None, []), ("e", "text", "lost", [1]), ("e", "header", "OVERVIEW", [2]), ("f", "list", "c", None)])
    got = {(r.doc_id, r.seq, r.title, r.level, r.parent_seq, r.page_start, r.page_end, r.n_units, r.data_types) for r in page_index.document_sections(rows).collect()}
    assert got == {("d", 1, "Document", 1, None, 1, 4, 3, "table,text"), ("e", 2, "OVERVIEW", 1, None, 2, 2, 1, ""), ("f", 1, "Document", 1, None, 1, 1, 1, "list")}


def test_every_document_has_sections(spark, folder):
    units = table(spark, folder, "ldus").where("ldu_id is not null and doc_id is not null")
    got = R.document_sections(spark, folder)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in units.select("doc_id").distinct().collect()}
    columns = R.section_tree(spark, folder).columns
    assert {tuple(r) for r in got.select(*columns).where("title <> 'Document'").collect()} == {tuple(r) for r in R.section_tree(spark, folder).where("title <> 'Document'").collect()}


def described(text):
    """Entities and summary of joined contents, as the reference finds them."""
    found = []
    for p, flags in ((r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+", 0), (r"\$[\d,\.]+\s*(?:million|billion|B|M|K)?|\d[\d,\.]*%", re.I)):
        for m in re.finditer(p, text, flags):
            if m.group() not in found:
                found.append(m.group())
    out = ""
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if len(s) > 20:
            out += s + " "
        if len(out) >= 300:
            break
    return "; ".join(found[:8]), out.strip()[:300]


def notes_by_loop(rows):
    """{(doc_id, seq): entities and summary} of rows (doc_id, chunk_type, content) in order."""
    docs, want = {}, {}
    for r in rows:
        docs.setdefault(r[0], []).append(r[1:3])
    for d, units in docs.items():
        parts, owner = {}, None
        for i, (kind, text) in enumerate(units, 1):
            owner = i if kind == "header" else owner
            if owner:
                parts.setdefault(owner, []).append(text or "")
        if not parts:
            parts = {1: [text or "" for _, text in units[:50]]}
        want |= {(d, k): described(" ".join(x)) for k, x in parts.items()}
    return want


def test_sections_are_described_over_their_units(spark):
    rows = [("d", "header", "Loan Portfolio", [1]), ("d", "text", "Development Bank of Tugu reported $5", [1]), ("d", "table", "Million and 12% of all loans. Short one. ", [1]), ("d", "text", None, [1]), ("d", "text", "The second sentence is long enough to be kept.", [1])]
    rows += [("e", "text", f"Unit {i} of Kedi Water Utility has no header, {i}%.", [1]) for i in range(60)]
    rows += [("g", "header", "1. Long", [1])] + [("g", "text", "tiny. no." if i != 600 else "Rare Name Here stands late in this section.", [1]) for i in range(1, 1200)]
    rows += [("h", "header", "x", [1])] + [("h", "text", {510: "first half of Edge", 511: "Name", 512: "Across and $7", 513: "B of sentences that run", 514: "on over the edge."}.get(i, "no."), [1]) for i in range(1, 530)]
    got = {(r.doc_id, r.seq): (r.entities, r.summary) for r in page_index.document_sections(made(spark, rows)).collect()}
    assert got == notes_by_loop(rows)
    assert got["d", 1][0] == "Loan Portfolio Development Bank; $5 Million; 12%" and got["g", 1][0] == "Rare Name Here" and got["h", 1][0].startswith("Edge Name Across; $7 B")


def test_section_notes_of_the_tables(spark, folder):
    rows = table(spark, folder, "ldus").where("ldu_id is not null and doc_id is not null").toPandas().sort_values("ingested_at").drop_duplicates("ldu_id")
    rows = rows.sort_values(["doc_id", "pos", "ldu_id"])
    got = {(r.doc_id, r.seq): (r.entities, r.summary) for r in R.document_sections(spark, folder).collect()}
    assert got == notes_by_loop(rows[["doc_id", "chunk_type", "content"]].itertuples(index=False, name=None))
