"""The registered queries over the stages of a run: profiles, blocks, results, stored rows and look-ups, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import agent, chunk, extract, facts, page_index, route, runs, search, triage
from quire.plans import document_queries as D
from quire.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The units that came before this time are those an earlier ingest has stored.
STORED_BEFORE = "2023-01-02 06:00:00"


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_SIGNS = {"e": r"\x{1200}-\x{137F}", "l": "A-Za-z", "a": r"\x00-\x7F"}
_COUNTS = ", ".join(f"length(regexp_replace(t, '[^{signs}]', '', 'g')) as {name}" for name, signs in _SIGNS.items())
_BY_TEXT = f"case when t = '' then null when greatest(financial, legal, technical, medical) = 0 then 'general' {' '.join(f'when {d} = greatest(financial, legal, technical, medical) then {d!r}' for d in D._HITS)} end"
_AMHARIC = " or ".join(f"contains(lower(doc_id), '{w}')" for w in triage.AMHARIC_NAMES)


@_query(rf"""
with b as (select doc_id, list_filter(list_transform(coalesce(provenance.spans, []), lambda s: s.page), lambda x: x > 0)[1] as page, {D._strip("coalesce(text, '')")} as t from {D._FIRST_BLOCKS}),
c as (select doc_id, max(page) as pages, coalesce(sum(length(t)) filter (page <= 10), 0) as chars, coalesce(string_agg(t, chr(10)) filter (page <= 2 and t <> ''), '') as t from b group by doc_id),
p as (select doc_id, page_count as pc, avg_image_area_ratio as ratio, layout_complexity as layout from profiles where doc_id is not null qualify row_number() over (partition by doc_id order by profiled_at desc, profile_id desc) = 1),
j as (select doc_id, ratio, layout, coalesce(pages, pc, 1) as page_count, coalesce(chars, 0) / greatest(least(coalesce(pages, pc, 1), 10), 1) as chars, coalesce(t, '') as t from p left join c using (doc_id)),
n as (select *, lower(t) as w, greatest(length(t), 1) as n, {_COUNTS}, case when ratio >= 0.55 and chars <= 300 then 'scanned_image' else 'native_digital' end as o, {_AMHARIC} or regexp_matches(doc_id, '[\x{{1200}}-\x{{137F}}]') as am from j),
h as (select *, case when t = '' then null when e >= 5 and l >= 20 then 'mixed' when e >= 5 then 'am' when a / n > 0.95 or l / n > 0.3 then 'en' end as lang,
  case when t = '' then 0.0 when e >= 5 and l >= 20 then 0.85 when e >= 5 and e / n > 0.05 then 0.9 when e >= 5 then 0.8 when a / n > 0.95 or l / n > 0.3 then 0.4 else 0.1 end::double as conf,
  {", ".join(f"{x.replace('contains(t,', 'contains(w,')} as {d}" for d, x in D._HITS.items())} from n),
d as (select *, {_BY_TEXT} as dom from h)
select doc_id, o as origin_type, layout as layout_complexity, case when lang is null and o = 'scanned_image' then if(am, 'am', 'en') else lang end as language,
  case when lang is null and o = 'scanned_image' then if(am, 0.85, 0.4) else conf end::double as language_confidence,
  case when dom is null or dom = 'general' then coalesce(case {D._NAME_DOMAIN} end, dom) else dom end as domain_hint, page_count, chars as avg_text_chars_per_page,
  case when o = 'scanned_image' then 'needs_vision_model' when layout = 'single_column' then 'fast_text_sufficient' else 'needs_layout_model' end as cost_tier from d""")
def document_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of each document told anew from its blocks: origin, language, domain, pages, text and cost class."""
    return triage.document_profiles(table(spark, folder, "blocks"), table(spark, folder, "profiles"))


_LINES = rf"list_filter(list_transform(regexp_split_to_array({D._strip('text')}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {D._strip('x')}), lambda x: length(x) >= 3)"
_LINE_TYPE = r"""case when regexp_matches(x, '^(\d+[\.\d]*\.?\s+[A-Z].{3,80}|[A-Z][A-Z\s,&/:\-()]{5,79})$') and length(x) < 90 then 'header'
  when regexp_matches(x, '(?i)^(Figure|Fig\.?|Table|Exhibit|Chart)\s*\d+') then 'figure' else 'text' end"""
_MADE = f"""{D._ROUTES}, chunks as ({D.SQL["text_chunks"]}),
texts as (select doc_id, step, text from r join documents d using (doc_id) where text is not null),
made as (select doc_id, step, unnest(list_transform({_LINES}, lambda x, i: {{'i': i - 1, 'k': {_LINE_TYPE}, 'x': x}})) as b from texts where step = 'A'
  union all select doc_id, step, unnest(list_transform({D._PARAGRAPHS}, lambda x, i: {{'i': i - 1, 'k': {D._paragraph("x")}, 'x': x}})) from texts where step = 'C2'
  union all select doc_id, step, {{'i': 0, 'k': 'text', 'x': {D._strip("text")}}} from texts where step = 'C1' and {D._strip("text")} <> ''),
blocks_ as (select doc_id, step, b.i::int as pos, b.k as block_type, length(b.x)::int as n_chars, sha256(b.x) as text_hash from made
  union all select doc_id, 'B', chunk_no, 'text', n_chars, chunk_hash from chunks join r using (doc_id) where step = 'B')"""


@_query(f"{_MADE} select * from blocks_")
def routed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of each text by the strategy that it is routed to."""
    rows = extract.routed_blocks(D._routes(spark, folder, "text"), "doc_id", "text")
    return rows.select("doc_id", "step", "pos", "block_type", F.length("text").alias("n_chars"), T.content_hash(F.col("text")).alias("text_hash"))


_TRACE = "array_to_string(list_filter([case when s and v then 'A+B-skipped' when s then 'A-skipped' else 'A' end, case when step <> 'A' and not (s and v) then 'B' end, case when step not in ('A', 'B') then step end], lambda x: x is not null), '>')"


@_query(f"""{_MADE}, counts as (select doc_id, count(*)::int as k from blocks_ group by doc_id),
e as (select r.*, coalesce(k, 0) as n_blocks, case when n = 0 then 'no text' when step = 'C3' then 'no reply of a vision model' when coalesce(k, 0) = 0 then 'no blocks' end as error from r left join counts using (doc_id))
select doc_id, left(step, 1) as strategy_used, case when error is not null then 0.0 else case step when 'A' then conf_a when 'B' then conf_b when 'C1' then conf_c1 when 'C2' then conf_c2 else conf_c3 end end::double as confidence,
  step <> 'A' as escalated, case left(step, 1) when 'A' then 0.001 when 'B' then 0.010 else 0.0 end::double as cost_estimate_usd, n_blocks, error, {_TRACE} as notes from e""")
def run_results(spark: SparkSession, folder: str) -> DataFrame:
    """What extracting each text by its strategy comes to, failures included: an event for the ledger each."""
    return extract.run_results(D._routes(spark, folder, "text"), "doc_id", "text")


@_query(f"""
with v as ({D.SQL["rule_violations"]}), p as (select distinct doc_id from profiles where doc_id is not null),
l as (select * from ledger where doc_id is not null and event_id is not null qualify row_number() over (partition by doc_id order by event_ts desc, event_id desc) = 1),
b as (select doc_id, count(distinct block_id) as n from blocks group by doc_id), u as (select doc_id, count(distinct ldu_id) as n from ldus group by doc_id), w as (select doc_id, count(*) as n from v group by doc_id)
select p.doc_id, strategy_used, confidence, coalesce(b.n, 0) as n_blocks, coalesce(u.n, 0) as n_units, coalesce(w.n, 0) as n_violations, notes,
  case when l.doc_id is null then 'not extracted' when coalesce(b.n, 0) = 0 then 'no blocks' end as error
from p left join l using (doc_id) left join b using (doc_id) left join u using (doc_id) left join w using (doc_id)""")
def run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document: strategy, confidence, blocks, units, broken rules, notes, and what failed."""
    profiles, blocks, units, events = (table(spark, folder, t) for t in ("profiles", "blocks", "ldus", "ledger"))
    return runs.run_summaries(profiles, blocks, units, chunk.violations(units), events)


@_query("""
with p as (select distinct doc_id from profiles where doc_id is not null),
s as (select doc_id, case when payload is null or trim(payload) not like '{%' or not json_valid(payload) then 'invalid_cache' when (case when json_valid(payload) then payload end)->>'$.doc_id' is distinct from doc_id then 'doc_id_mismatch' else 'cache_hit' end as r from page_indexes where doc_id is not null),
m as (select doc_id, case when bool_or(r = 'cache_hit') then 'cache_hit' else min(r) end as lo, max(r) as hi from s group by doc_id)
select doc_id, coalesce(lo, 'cache_miss') as cache_reason, coalesce(lo = 'cache_hit', false) as cache_hit from p left join m using (doc_id)""")
def cache_states(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a page index stored for each document can be used again, and if not, why."""
    requests = table(spark, folder, "profiles").where("doc_id is not null").select("doc_id").distinct()
    return route.cache_states(requests, table(spark, folder, "page_indexes").select("doc_id", "payload"))


@_query(f"""
select ldu_id, left(content, 8000) as text, doc_id, chunk_type, '[' || array_to_string(coalesce(page_refs, []), ',') || ']' as page_refs from {D._FIRST_UNITS}
where trim(content) <> '' and ldu_id not in (select ldu_id from ldus where ldu_id is not null and ingested_at < '{STORED_BEFORE}')""")
def stored_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The units that an ingest adds to those stored by an earlier one."""
    units = table(spark, folder, "ldus")
    stored = units.where(F.col("ingested_at") < F.lit(STORED_BEFORE).cast("timestamp_ntz")).where("ldu_id is not null").select("ldu_id").distinct()
    return search.stored_texts(units, stored)


@_query(f"""
with f as ({D.SQL["extracted_facts"]}) select u.doc_id, ldu_id, field_name, value, unit, f.page, u.content_hash, coalesce(u.provenance.source_path, '') as source_path from f join {D._FIRST_UNITS} u using (ldu_id)""")
def fact_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The facts found in units as rows for the fact table, but for their new ids and times."""
    units = table(spark, folder, "ldus")
    return facts.fact_rows(facts.extracted(units), units).drop("id", "created_at")


@_query(rf"""
with t as (select doc_id, {D._strip("coalesce(text, '')")} as t from documents), n as (select doc_id, t, length(t) as n, {_COUNTS}, length(regexp_replace(t, '[^{extract.ODD_SIGNS}]', '', 'g')) as odd, length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) as k from t)
select doc_id, case when t = '' then null when e >= 5 and l >= 20 then 'mixed' when e >= 5 and e / n > 0.03 then 'am' when l >= 20 and l / n > 0.15 then 'en' end as language,
  case when t = '' then null when e >= 5 and l >= 20 then 'mixed' when e >= 5 and e / n > 0.03 then 'ethiopic' when l >= 20 and l / n > 0.15 then 'latin' end as script,
  case when t = '' then 0.0 when e >= 5 and l >= 20 then 0.85 when e >= 5 and e / n > 0.03 then 0.9 when l >= 20 and l / n > 0.15 then 0.75 else 0.1 end::double as confidence,
  case when t = '' then 'empty extracted markdown' else array_to_string(list_filter([case when odd >= 3 then 'contains unusual OCR symbols' end, case when k / n < 0.35 then 'low alphanumeric ratio' end,
    case when n - a >= 10 and e < 3 and l < 10 then 'non-ascii text without clear script signal' end], lambda x: x is not null), '; ') end as flags from n""")
def markdown_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Language and script of each text as extracted markdown, and what speaks against it."""
    return triage.markdown_quality(table(spark, folder, "documents"), "doc_id", "text")


_DEFAULTS = f"asked as (select distinct index_id, doc_id, unnest([1, 2, 3])::int as question_no, unnest([{', '.join(repr(q) for q in agent.DEFAULT_QUESTIONS)}]) as question from page_indexes where index_id is not null and doc_id is not null)"


@_query(f"with {_DEFAULTS}, {D._ANSWERS} select a.*, coalesce(left(content, 300), '{agent.NO_ANSWER}') as answer, b.ldu_id from asked a left join (select * from best where rank = 1) b using (doc_id, question) left join units u on u.ldu_id = b.ldu_id")
def default_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The questions put to every indexed document, with the answers from its units."""
    return agent.answered(agent.default_questions(table(spark, folder, "page_indexes")), table(spark, folder, "ldus"))


@_query(f"with {_DEFAULTS}, {D._ANSWERS} select count(distinct a.doc_id) as n_docs, count(*) as n_questions, count(b.ldu_id) as n_answered from asked a left join (select * from best where rank = 1) b using (doc_id, question)")
def question_totals(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents, questions and answers those are."""
    return agent.totals(default_answers(spark, folder))


@_query(f"""
with {D._PAGES}, f as (select distinct on (id) id, doc_id, page from facts where id is not null)
select f.id, f.doc_id, f.page, item_count is not null as found, item_count, char_count, data_types from f left join pages p using (doc_id, page)""")
def page_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """The page index entry of the page that each fact names."""
    asked = table(spark, folder, "facts").where("id is not null").select("id", "doc_id", "page").dropDuplicates(["id"])
    pages = page_index.document_pages(table(spark, folder, "blocks"), table(spark, folder, "ldus"), table(spark, folder, "profiles"))
    return page_index.page_lookups(asked, pages)


@_query(f"""
with k as ({D.SQL["keyword_search"]}), u as (select ldu_id, left(content, 300) as snippet, regexp_extract(provenance.source_path, '([^/]*)$', 1) as document_name, content_hash,
  array_to_string([x.page for x in case when len(provenance.spans) > 0 then provenance.spans else list_transform(coalesce(page_refs, []), lambda p: {{'page': p, 'bbox': bounding_box}}) end], ',') as pages from {D._FIRST_UNITS})
select k.*, snippet, document_name, pages, content_hash from k join u using (ldu_id)""")
def search_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The hits of `keyword_search` with what speaks for them: snippet, document, pages and hash."""
    return agent.evidence(D.keyword_search(spark, folder), table(spark, folder, "ldus"))
