"""The registered queries over documents, with their SQL twins where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import agent, chunk, extract, facts, nested, page_index, route, search, triage
from quire.operators.arrivals import first_arrivals
from quire.plans.problem_queries import SECTIONS
from quire.session import staged
from quire.sources.tables import table
from quire.streaming import ledger

#: White space as the other engine writes it.
SQL_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_FIRST_UNITS = "(select * from ldus where ldu_id is not null qualify row_number() over (partition by ldu_id order by ingested_at) = 1)"
_FIRST_BLOCKS = "(select * from blocks where block_id is not null qualify row_number() over (partition by block_id order by extracted_at) = 1)"


@_query(r"""
select distinct source_path, regexp_extract(source_path, '([^/]*)$', 1) as file_name,
       regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') as stem
from profiles where source_path like '%.pdf'""")
def scan_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """The PDF files that were taken in, with the document ids that their names give."""
    path = F.col("source_path")
    return table(spark, folder, "profiles").where(path.endswith(".pdf")).select(path, F.regexp_extract(path, r"([^/]*)$", 1).alias("file_name"), T.file_stem(path).alias("stem")).distinct()


@_query(f"""
with b as (select *, {_strip("coalesce(text, '')")} as content from {_FIRST_BLOCKS}),
p as (select *, list_sort(list_distinct(list_filter(list_transform(coalesce(provenance.spans, []), lambda s: s.page), lambda x: x > 0))) as pages,
      list_filter(list_transform(coalesce(provenance.spans, []), lambda s: s.bbox), lambda x: len(x) > 0)[1] as box from b where content <> '')
select doc_id || '-ldu-' || pos || '-' || left(sha256(content), 10) as ldu_id, doc_id, pos,
  case block_type when 'section_header' then 'header' when 'caption' then 'figure' when 'footer' then 'text'
    when 'text' then 'text' when 'table' then 'table' when 'figure' then 'figure' when 'header' then 'header' when 'list' then 'list' else 'text' end as chunk_type,
  content, len(regexp_split_to_array(content, '{SQL_SPACE}+'))::int as token_count, sha256(content) as content_hash,
  pages[1] as first_page, len(pages)::int as n_pages,
  coalesce(box[1], 0.0)::double as x0, coalesce(box[2], 0.0)::double as y0, coalesce(box[3], 612.0)::double as x1, coalesce(box[4], 792.0)::double as y1
from p""")
def logical_units(spark: SparkSession, folder: str) -> DataFrame:
    """Each block with text as a logical unit: type, hash, size, pages and box."""
    return chunk.logical_units(table(spark, folder, "blocks"))


_NAME_DOMAIN = " ".join(f"when {' or '.join(f'''contains(lower(doc_id), '{w}')''' for w in words)} then '{d}'" for d, words in triage.NAME_DOMAINS)


@_query(f"""
with o as (select distinct on (profile_id) *, case when avg_image_area_ratio >= 0.55 and avg_text_chars_per_page <= 300 then 'scanned_image' else 'native_digital' end as o from profiles where profile_id is not null)
select profile_id, doc_id, o as origin_type,
  case when o = 'scanned_image' then 'needs_vision_model' when layout_complexity = 'single_column' then 'fast_text_sufficient' else 'needs_layout_model' end as cost_tier,
  case when domain_hint is null or domain_hint = 'general' then coalesce(case {_NAME_DOMAIN} end, domain_hint) else domain_hint end as domain_hint
from o""")
def triage_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Origin, cost class and domain of each profile, told anew from its signals and name."""
    return triage.triaged(table(spark, folder, "profiles"))


@_query(r"""
with t as (select doc_id, """ + _strip("coalesce(text, '')") + r""" as t from documents),
n as (select doc_id, t, length(regexp_replace(t, '[^\x{1200}-\x{137F}]', '', 'g')) as e, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as l,
      length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) as a, greatest(length(t), 1) as n from t)
select doc_id, case when t = '' then null when e >= 5 and l >= 20 then 'mixed' when e >= 5 then 'am' when a / n > 0.95 or l / n > 0.3 then 'en' end as script_language,
  case when t = '' then 0.0 when e >= 5 and l >= 20 then 0.85 when e >= 5 and e / n > 0.05 then 0.9 when e >= 5 then 0.8 when a / n > 0.95 or l / n > 0.3 then 0.4 else 0.1 end::double as script_confidence
from n""")
def script_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each text by its script alone, without a model."""
    rows = triage.counted(table(spark, folder, "documents"), "doc_id", "text")
    v = triage.language_of(*(F.col(c) for c in triage.COUNTS))
    return rows.select("doc_id", v.alias("v")).select("doc_id", F.col("v.language").alias("script_language"), F.col("v.language_confidence").alias("script_confidence"))


_HITS = {d: " + ".join(f"contains(t, '{w}')::int" for w in words) for d, words in triage.DOMAIN_WORDS.items()}


@_query(f"""
with t as (select doc_id, lower(coalesce(text, '')) as t from documents), h as (select doc_id, t, {", ".join(f"{x} as {d}" for d, x in _HITS.items())} from t)
select doc_id, case when t = '' then null when greatest(financial, legal, technical, medical) = 0 then 'general'
  {" ".join(f"when {d} = greatest(financial, legal, technical, medical) then '{d}'" for d in _HITS)} end as domain from h""")
def text_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Domain of each text by its keywords."""
    return table(spark, folder, "documents").select("doc_id", triage.domain_of(F.col("text")).alias("domain"))


@_query(rf"""
with l as (select block_id, unnest(list_transform(regexp_split_to_array({_strip("text")}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x, i: {{'no': i - 1, 'line': {_strip("x")}}})) as r
  from {_FIRST_BLOCKS} where text is not null)
select block_id, r.no::int as line_no, r.line as line,
  case when regexp_matches(r.line, '^(\d+[\.\d]*\.?\s+[A-Z].{{3,80}}|[A-Z][A-Z\s,&/:\-()]{{5,79}})$') and length(r.line) < 90 then 'header'
       when regexp_matches(r.line, '(?i)^(Figure|Fig\.?|Table|Exhibit|Chart)\s*\d+') then 'figure' else 'text' end as block_type
from l where length(r.line) >= 3""")
def line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of each page text as a typed block."""
    texts = table(spark, folder, "blocks").where("text is not null").select("block_id", "extracted_at", "text")
    return extract.line_blocks(first_arrivals(texts, "block_id", "extracted_at"), "block_id", "text")


_UPPER = r"regexp_matches({0}, '\p{{Lu}}') and not regexp_matches({0}, '[\p{{Ll}}\p{{Lt}}]')"


def _paragraph(p: str) -> str:
    return (
        f"case when length({p}) < 120 and (({_UPPER.format(p)}) or {p} like '%:' or regexp_matches({p}, '^[A-Z][A-Za-z0-9\\s,&/\\-()]{{3,}}$')) then 'header' "
        f"when contains({p}, ':') or len(list_filter(string_split({p}, chr(10)), lambda x: regexp_matches(x, '\\d'))) >= 3 then 'table' else 'text' end"
    )


_PARAGRAPHS = rf"list_filter(list_transform(regexp_split_to_array({_strip('text')}, '\n\s*\n'), lambda x: {_strip('x')}), lambda x: x <> '')"


@_query(f"""
with p as (select doc_id, unnest(list_transform({_PARAGRAPHS}, lambda x, i: {{'no': i - 1, 'p': x}})) as r from documents where text is not null)
select doc_id, r.no::int as paragraph_no, length(r.p)::int as n_chars, {_paragraph("r.p")} as block_type from p""")
def paragraph_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Each paragraph of each text as a typed block."""
    return extract.paragraph_blocks(table(spark, folder, "documents"), "doc_id", "text")


@_query(rf"""
with h as (select doc_id, unnest(string_split(regexp_replace({_strip("text")}, '\n(\s{{0,3}}#{{1,6}}\s+\S)', chr(57344) || '\1', 'g'), chr(57344))) as part, generate_subscripts(string_split(regexp_replace({_strip("text")}, '\n(\s{{0,3}}#{{1,6}}\s+\S)', chr(57344) || '\1', 'g'), chr(57344)), 1) as k from documents where text is not null),
p as (select doc_id, flatten(list(list_filter(list_transform(regexp_split_to_array({_strip("part")}, '\n\s*\n'), lambda x: {_strip("x")}), lambda x: x <> '') order by k)) as parts from h group by doc_id),
s as (select doc_id, flatten(list_transform(parts, lambda p: list_transform(range(0, (length(p) - 1) // 1200 + 1), lambda i: {_strip("substring(p, i * 1200 + 1, 1200)")}))) as c from p),
f as (select doc_id, unnest(list_transform(list_filter(c, lambda x: x <> ''), lambda x, i: {{'no': i - 1, 'c': x}})) as r from s)
select doc_id, r.no::int as chunk_no, length(r.c)::int as n_chars, sha256(r.c) as chunk_hash from f""")
def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each text cut at headings and blank lines into chunks of at most 1200 characters."""
    rows = extract.markdown_chunks(table(spark, folder, "documents"), "doc_id", "text")
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), T.content_hash(F.col("chunk")).alias("chunk_hash"))


_CANDIDATES = f"""
select doc_id, source, length({_strip("coalesce(text, '')")}) as n, list_transform({_PARAGRAPHS.replace("text", "coalesce(text, '')", 1)}, lambda p: {_paragraph("p")}) as k from documents"""
_CONF = """
case when n < 30 then 0.25 else least(0.95, 0.6 + n / 2000) end::double as conf_a,
case when n >= 5000 and len(k) >= 15 then 0.9 when n >= 2000 and len(k) >= 8 then 0.85 when n >= 800 and len(k) >= 4 then 0.78 when n >= 300 then 0.65 when n >= 80 then 0.45 else 0.25 end::double as conf_b,
case when n >= 3000 then 0.82 when n >= 1200 then 0.72 when n >= 400 then 0.6 when n >= 150 then 0.45 when n >= 60 then 0.3 else 0.1 end::double as conf_c1,
least(85, 15 + 20 * (n >= 300)::int + 20 * (n >= 1000)::int + 15 * (n >= 2500)::int + 10 * list_contains(k, 'table')::int + 10 * list_contains(k, 'header')::int) / 100::double as conf_c2,
case when n >= 3000 then 0.88 when n >= 1200 then 0.8 when n >= 400 then 0.7 when n >= 150 then 0.55 when n >= 60 then 0.35 else 0.2 end::double as conf_c3"""


@_query(f"with c as ({_CANDIDATES}) select doc_id, n::int as n_chars, {_CONF} from c")
def strategy_confidences(spark: SparkSession, folder: str) -> DataFrame:
    """What each extraction strategy would claim for each text."""
    return extract.candidates(table(spark, folder, "documents"), "doc_id", "text")


_SCANNED = "coalesce(source, '') in ('field_scans', 'archive_film')"


_ROUTES = f"""
with c as ({_CANDIDATES}), f as (select doc_id, lang, {_SCANNED.replace("source", "d.source")} as s from documents d), x as (select c.doc_id, n, s, coalesce(lang in ('am', 'ti', 'mixed'), false) as v, {_CONF} from c join f using (doc_id)),
r as (select *, case when not s and conf_a >= 0.9 then 'A' when not (s and v) and conf_b >= 0.8 then 'B' when v then 'C3' when conf_c1 >= 0.6 then 'C1' when conf_c2 >= 0.72 then 'C2' else 'C3' end as step from x)"""


@_query(f"""{_ROUTES}
select doc_id, step, left(step, 1) as strategy, case step when 'A' then conf_a when 'B' then conf_b when 'C1' then conf_c1 when 'C2' then conf_c2 else conf_c3 end as confidence,
  array_to_string(list_filter([case when s and v then 'A+B-skipped' when s then 'A-skipped' else 'A' end, case when step <> 'A' and not (s and v) then 'B' end, case when step not in ('A', 'B') then step end], lambda x: x is not null), '>') as trace,
  step <> 'A' as escalated from r""")
def strategy_routes(spark: SparkSession, folder: str) -> DataFrame:
    """The strategy that each text would be extracted by, texts of the scanning sources having no text layer."""
    return _routes(spark, folder).select("doc_id", "step", "strategy", "confidence", "trace", "escalated")


def _routes(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    scanned = F.when(F.coalesce("source", F.lit("")).isin("field_scans", "archive_film"), "scanned_image").otherwise("native_digital")
    return route.routed(extract.candidates(table(spark, folder, "documents"), "doc_id", "text", keep=(F.col("lang").alias("language"), scanned.alias("origin_type"), *keep)))


@_query(rf"""{_ROUTES},
t as (select d.doc_id, {_strip("coalesce(text, '')")} as t, left(step, 1) as g from documents d join r using (doc_id)), m as (select doc_id, t, length(t) as n, len(regexp_extract_all(lower(t), '\bunknown\b|\bunsure\b|\bcannot\b')) as u, g from t),
s as (select *, case when t = '' then 0 else greatest(0, 100 - 35 * (n < 200)::int - 35 * (n < 50)::int - 20 * (u >= 5)::int - 20 * (g = 'C' and n < 120)::int) end as s from m)
select doc_id, s / 100::double as qa_score, s < 65 as needs_review, case when t = '' then 'no blocks' else array_to_string(list_filter([case when n < 200 then 'very short extracted text' end, case when n < 50 then 'almost empty extracted text' end,
  case when u >= 5 then 'many uncertainty markers' end, case when g = 'C' and n < 120 then 'vision output too small' end], lambda x: x is not null), '; ') end as reasons from s""")
def text_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of each text as the result of the strategy it is routed to, whether it needs a review, and why."""
    rows = _routes(spark, folder, "text").select("doc_id", extract.quality(F.col("text"), F.col("strategy")).alias("v"))
    return rows.select("doc_id", "v.qa_score", "v.needs_review", "v.reasons")


@_query(rf"""
with t as (select doc_id, {_strip("coalesce(text, '')")} as t from documents), n as (select doc_id, t, lower(t) as w, length(t) as n from t),
s as (select doc_id, t, 15 + 15 * (n >= 100)::int + 15 * (n >= 400)::int + 15 * (n >= 1200)::int
  + 15 * (length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / greatest(n, 1) >= 0.35)::int + 10 * (length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / greatest(n, 1) >= 0.55)::int
  + 10 * (len(list_distinct(regexp_extract_all(w, '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_\-/%().,:]*[\p{{L}}\p{{N}}_])?'))) >= 20)::int
  + 10 * (len(list_distinct(regexp_extract_all(w, '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_\-/%().,:]*[\p{{L}}\p{{N}}_])?'))) >= 80)::int
  + 5 * (regexp_matches(t, '\p{{Nd}}') and regexp_matches(w, '\b(total|amount|revenue|tax|profit|year)\b'))::int
  - least(20, 5 * len(regexp_extract_all(w, '\bunknown\b|\bunclear\b|\bunreadable\b|\bunsure\b'))) - least(15, 5 * len(regexp_extract_all(t, '[#`]{{3,}}|\\u[0-9a-fA-F]{{4}}'))) as s from n)
select doc_id, case when t = '' then 0.0 else greatest(0, least(100, s)) / 100 end::double as extraction_score from s""")
def extraction_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of each text as extracted content."""
    return table(spark, folder, "documents").select("doc_id", extract.extraction_score(F.col("text")).alias("extraction_score"))


@_query(rf"""
with r as (select ldu_id, doc_id, regexp_extract_all(content, '(?i)\b(?:see|refer to|as shown in|cf\.?|table|figure|fig\.?|equation|section)\s+(?:[A-Z]?\d+(?:\.\d+)*|[A-Z])') as refs from {_FIRST_UNITS})
select ldu_id, doc_id, array_to_string(list_filter(refs, lambda x, i: list_position(refs, x) = i), '; ') as cross_refs from r where len(refs) > 0""")
def cross_references(spark: SparkSession, folder: str) -> DataFrame:
    """The references to tables, figures and sections in each unit, in order and each once."""
    refs = table(spark, folder, "ldus").select("ldu_id", "ingested_at", "doc_id", T.cross_references(F.col("content")).alias("refs"))
    return first_arrivals(refs.where(F.size("refs") > 0), "ldu_id", "ingested_at").select("ldu_id", "doc_id", F.array_join("refs", "; ").alias("cross_refs"))


def _unique(refs: str) -> str:
    return f"array_to_string(list_filter({refs}, lambda x, i: list_position({refs}, x) = i), '; ')"


_REFS = r"(?i)\b(?:see|refer to|as shown in|cf\.?|table|figure|fig\.?|equation|section)\s+(?:[A-Z]?\d+(?:\.\d+)*|[A-Z])"
#: A list's parts: lines are added to the part while it stays within 1200 characters, a line and its break counting together.
_PARTS = """list_transform(list_reduce(list_transform(string_split(c, chr(10)), lambda l: {'p': [l], 'n': length(l) + 1}),
  lambda a, x: case when a.n + x.n - 1 > 1200 then {'p': list_concat(a.p, x.p), 'n': x.n - 1} else {'p': list_concat(a.p[:-2], [a.p[-1] || chr(10) || x.p[1]]), 'n': a.n + x.n} end).p, lambda x: x)"""


@_query(rf"""
with o as (select ldu_id, doc_id, chunk_type, content_hash, coalesce(content, '') as c, {_strip("coalesce(content, '')")} as t, row_number() over (partition by doc_id order by pos, ldu_id) as seq from {_FIRST_UNITS} where doc_id is not null),
f as (select *, coalesce(lag(chunk_type) over w = 'figure' and regexp_matches(t, '(?i)^(Figure|Fig\.?|Table|Exhibit|Chart)\s*\d+'), false) as caption from o window w as (partition by doc_id order by seq)),
k as (select *, caption and (seq - max(case when not caption then seq end) over (partition by doc_id order by seq rows unbounded preceding)) % 2 = 1 as taken from f),
a as (select *, coalesce(chunk_type in ('header', 'table', 'figure', 'list'), false) and not taken as alone from k),
b as (select *, coalesce(max(case when alone or taken then seq end) over w, 0) as barrier, last_value(case when chunk_type = 'header' then t end ignore nulls) over w as parent_section,
  lead(taken) over (partition by doc_id order by seq) as takes, lead(t) over (partition by doc_id order by seq) as cap from a window w as (partition by doc_id order by seq rows unbounded preceding)),
single as (select doc_id, seq, ldu_id, chunk_type, case when takes then regexp_replace(c, '\s+$', '') || chr(10) || '[Caption]: ' || cap else c end as c, parent_section, content_hash, 1 as n_units from b where alone),
runs as (select doc_id, barrier, list(seq order by seq) as seqs, list(length(c) order by seq) as sizes from b where not alone and not taken group by all),
cuts as (select doc_id, seqs, list_reduce(list_transform(sizes, lambda n: {{'g': [0], 's': n}}), lambda x, y: case when x.s + y.s > 1200 then {{'g': list_append(x.g, x.g[-1] + 1), 's': y.s}} else {{'g': list_append(x.g, x.g[-1]), 's': x.s + y.s}} end).g as g from runs),
each as (select doc_id, unnest(seqs) as seq, unnest(g) as g, seqs[1] as run from cuts),
merged as (select doc_id, min(seq) as seq, min_by(ldu_id, seq) as ldu_id, case when count(*) > 1 then 'text' else min_by(chunk_type, seq) end as chunk_type,
  case when count(*) > 1 then coalesce(string_agg(nullif(t, ''), chr(10) || chr(10) order by seq), '') else min_by(c, seq) end as c, max(parent_section) as parent_section, max_by(content_hash, seq) as content_hash, count(*)::int as n_units
  from each join b using (doc_id, seq) group by doc_id, run, g),
every as (select *, regexp_extract_all(c, '{_REFS}') as refs, case when chunk_type = 'list' and n_units = 1 and length(c) > 1200 then {_PARTS} else [c] end as parts from (select * from single union all select * from merged)),
s as (select *, unnest(parts) as piece, generate_subscripts(parts, 1) - 1 as part from every)
select doc_id, seq, part::int as part, case when len(parts) > 1 then ldu_id || '-part' || part else ldu_id end as ldu_id, chunk_type, length(piece)::int as n_chars, sha256(piece) as text_hash, parent_section, content_hash, n_units,
  {_unique("refs")} as cross_refs from s""")
def chunked_units(spark: SparkSession, folder: str) -> DataFrame:
    """The units of each document chunked under the structure rules."""
    rows = chunk.chunked(table(spark, folder, "ldus"))
    return rows.select("doc_id", "seq", "part", "ldu_id", "chunk_type", F.length("content").alias("n_chars"), T.content_hash(F.col("content")).alias("text_hash"), "parent_section", "content_hash", "n_units", "cross_refs")


_ORDERED = f"(select *, row_number() over (partition by doc_id order by pos, ldu_id) as seq from {_FIRST_UNITS} where doc_id is not null)"


@_query(rf"""
with u as (select *, last_value(case when chunk_type = 'header' then {_strip("coalesce(content, '')")} end ignore nulls) over (partition by doc_id order by seq rows unbounded preceding) as expected from {_ORDERED}),
v as (select doc_id, ldu_id, seq - 1 as i, expected, parent_section, regexp_extract_all(coalesce(content, ''), '(?i)\b(?:see|refer to|as shown in|cf\.?|table|figure|fig\.?|equation|section)\s+(?:[A-Z]?\d+(?:\.\d+)*|[A-Z])') as refs, unnest([case when chunk_type <> 'header' and expected <> '' and expected is distinct from parent_section then 'R4' end,
  case when chunk_type = 'table' and {_strip("coalesce(content, '')")} = '' then 'R1' end,
  case when regexp_matches(coalesce(content, ''), '(?i)\b(?:see|refer to|as shown in|cf\.?|table|figure|fig\.?|equation|section)\s+(?:[A-Z]?\d+(?:\.\d+)*|[A-Z])') and coalesce(len(provenance.cross_refs), 0) = 0 then 'R5' end]) as rule from u)
select doc_id, ldu_id, rule, case rule when 'R4' then 'R4 violation at LDU ' || i || ' (' || ldu_id || '): parent_section missing or mismatched (expected ' || chr(39) || expected || chr(39) || ', got ' || chr(39) || coalesce(parent_section, 'None') || chr(39) || ')'
  when 'R1' then 'R1 violation at LDU ' || i || ': empty table LDU' else 'R5 violation at LDU ' || i || ' (' || ldu_id || '): cross-refs [' || chr(39) || array_to_string(refs, chr(39) || ', ' || chr(39)) || chr(39) || '] not stored in meta' end as message from v where rule is not null""")
def rule_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The structure rules that stored units break."""
    return chunk.violations(table(spark, folder, "ldus"))


_SHORT = rf"case when length(f) > 180 then regexp_replace(left(f, 179), '{SQL_SPACE}+$', '') || '…' else f end"


@_query(rf"""
with u as (select doc_id, chunk_type, replace({_strip("coalesce(content, '')")}, chr(10), ' ') as f, unnest(list_distinct(case when coalesce(len(page_refs), 0) > 0 then list_filter(page_refs, lambda x: x > 0)
  else list_filter(list_transform(coalesce(provenance.spans, []), lambda s: s.page), lambda x: x > 0) end)) as page from {_FIRST_UNITS})
select doc_id, page, count(*) as item_count, sum(length({_SHORT}))::bigint as char_count, array_to_string(list_sort(list(distinct chunk_type)), ',') as data_types from u group by all""")
def page_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The page index: items, characters and types of each page."""
    return page_index.page_index(table(spark, folder, "ldus"))


_SPAN_PAGES = "list_distinct(list_filter(list_transform(coalesce(provenance.spans, []), lambda s: s.page), lambda x: x > 0))"
_UNIT_PAGES = f"case when coalesce(len(page_refs), 0) > 0 then list_distinct(list_filter(page_refs, lambda x: x > 0)) else {_SPAN_PAGES} end"
_FLAT = lambda text: f"""replace({_strip(f"coalesce({text}, '')")}, chr(10), ' ')"""
_PAGES = f"""items as (select doc_id, kind, length({_SHORT}) as size, page from (select doc_id, block_type as kind, {_FLAT("text")} as f, unnest({_SPAN_PAGES}) as page from {_FIRST_BLOCKS}
  union all select doc_id, chunk_type, {_FLAT("content")}, unnest({_UNIT_PAGES}) from {_FIRST_UNITS}) where doc_id is not null),
named as (select doc_id, page, count(*) as item_count, sum(size)::bigint as char_count, array_to_string(list_sort(list(distinct kind)), ',') as data_types from items group by all),
pages as (select * from named union all select doc_id, unnest(range(1, greatest(coalesce(max(page_count), 1), 1) + 1))::int as page, 0, 0, '' from profiles where doc_id is not null and doc_id not in (select doc_id from named) group by doc_id)"""


@_query(f"with {_PAGES} select * from pages")
def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The page index of whole documents: extracted blocks and units of each page, and the pages that have neither."""
    return page_index.document_pages(table(spark, folder, "blocks"), table(spark, folder, "ldus"), table(spark, folder, "profiles"))


@_query(f"""
with i as (select doc_id, 'extracted_block' as source, block_id as unit_id, pos, block_type as chunk_type, {_FLAT("text")} as f, provenance.content_hash as content_hash,
  list_filter(list_transform(coalesce(provenance.spans, []), lambda s: s.bbox), lambda x: len(x) = 4)[1] as box, unnest({_SPAN_PAGES}) as page from {_FIRST_BLOCKS}
  union all select doc_id, 'ldu', ldu_id, pos, chunk_type, {_FLAT("content")}, content_hash, case when len(bounding_box) = 4 then bounding_box end, unnest({_UNIT_PAGES}) from {_FIRST_UNITS})
select doc_id, page, source, unit_id, pos, chunk_type, {_SHORT} as snippet, content_hash, box[1] as x0, box[2] as y0, box[3] as x1, box[4] as y1 from i where doc_id is not null""")
def page_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items of each page, blocks before units: type, snippet, hash and box."""
    return page_index.page_items(table(spark, folder, "blocks"), table(spark, folder, "ldus"))


_T = _strip("coalesce(content, '')")
_LEVEL = (
    "case when regexp_matches(t, '^\\d+\\.\\s') then least(length(regexp_replace(string_split(t, ' ')[1], '[^.]', '', 'g')) + 1, 4) "
    f"when ({_UPPER.format('t')}) and length(t) > 3 and length(t) < 80 then 1 "
    "when length(t) < 80 and regexp_matches(t, '^\\p{Lu}') and t not like '%.' then 2 end"
)


_TREE = f"""o as (select *, {_T} as t, case when coalesce(len(page_refs), 0) > 0 then page_refs[1] else 1 end as p1, case when coalesce(len(page_refs), 0) > 0 then page_refs[len(page_refs)] else 1 end as p2 from {_ORDERED}),
r as (select *, max(case when chunk_type = 'header' then seq end) over (partition by doc_id order by seq rows unbounded preceding) as owner, coalesce({_LEVEL}, 1) as level from o),
y as (select doc_id, owner as seq, chunk_type, min(seq) as f, max(p2) as mp, count(*) as n from r where chunk_type <> 'header' and owner is not null group by all),
m as (select doc_id, seq, max(mp) as mp, sum(n) as n, array_to_string(list(chunk_type order by f), ',') as types from y group by all),
h as (select doc_id, seq, t, level, p1, p2 from r where chunk_type = 'header'),
k as (select a.doc_id, a.seq, max(b.seq) as parent_seq from h a join h b on a.doc_id = b.doc_id and b.seq < a.seq and b.level < a.level group by all),
c as (select a.doc_id, a.seq, min_by(b.p1, b.seq) as closing from h a join h b on a.doc_id = b.doc_id and b.seq > a.seq and b.level <= a.level group by all),
tree as (select doc_id, seq, left(t, 120) as title, level, parent_seq, p1 as page_start, greatest(p2, coalesce(mp, p2), coalesce(closing - 1, p2)) as page_end, (coalesce(n, 0) + 1)::bigint as n_units, coalesce(types, '') as data_types
from h left join m using (doc_id, seq) left join k using (doc_id, seq) left join c using (doc_id, seq))"""


@_query(f"with {_TREE} select * from tree")
def section_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Each header's section: level, parent, pages and units."""
    return page_index.sections(table(spark, folder, "ldus"))


_NOTES = r"""regexp_extract_all(c, '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?: [A-Z][a-z]+)+)', 1) || regexp_extract_all(c, '(?i)\$[\p{Nd},\.]+SPACE*(?:million|billion|B|M|K)?|\p{Nd}[\p{Nd},\.]*%')""".replace("SPACE", SQL_SPACE)
_SUMMARY = f"""left({_strip("list_reduce(list_prepend('', s), lambda acc, x: case when length(acc) < 300 and length(x) > 20 then acc || x || ' ' else acc end)")}, 300)"""
_DOCUMENT_TREE = f"""{_TREE},
bare as (select doc_id from o group by doc_id having not bool_or(coalesce(chunk_type = 'header', false))),
roots as (select doc_id, 1::bigint as seq, 'Document' as title, 1 as level, null::bigint as parent_seq, min(list_min(case when coalesce(len(page_refs), 0) > 0 then page_refs else [1] end)) as page_start,
  max(list_max(case when coalesce(len(page_refs), 0) > 0 then page_refs else [1] end)) as page_end, count(*) as n_units, array_to_string(list_sort(list(distinct chunk_type)), ',') as data_types from o join bare using (doc_id) group by doc_id),
parts as (select doc_id, owner as seq, string_agg(coalesce(content, ''), ' ' order by r.seq) as c from r where owner is not null group by all
  union all select doc_id, 1, string_agg(coalesce(content, ''), ' ' order by seq) from o join bare using (doc_id) where seq <= 50 group by doc_id),
noted as (select doc_id, seq, {_NOTES} as e, regexp_split_to_array(regexp_replace({_strip("c")}, '([.!?]){SQL_SPACE}+', '\\1' || chr(57344), 'g'), chr(57344)) as s from parts),
whole as (select t.*, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i)[1:8], '; ') as entities, {_SUMMARY} as summary from (select * from tree union all select * from roots) t left join noted using (doc_id, seq))"""


@_query(f"with {_DOCUMENT_TREE} select * from whole")
def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of every document with their entities and summaries, documents without headers as one section."""
    return page_index.document_sections(table(spark, folder, "ldus"))


@_query(f"""with {_DOCUMENT_TREE}, {_PAGES}, heads as (select doc_id, count(*) as section_count from whole where parent_seq is null group by doc_id)
select doc_id, count(*) as page_count, sum(item_count)::bigint as item_count, array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(data_types, ','))), lambda x: x <> ''))), ',') as data_types,
  coalesce(any_value(section_count), 0) as section_count, 'extractive' as summary_mode from pages left join heads using (doc_id) group by doc_id""")
def document_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """What each document's page index says of itself: pages, items, types, top sections."""
    blocks, units, profiles = (table(spark, folder, t) for t in ("blocks", "ldus", "profiles"))
    return page_index.document_indexes(page_index.document_pages(blocks, units, profiles), page_index.document_sections(units))


@_query(rf"""
with u as (select ldu_id, content, {_T} as t, regexp_extract_all(content, '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-z]+(?: [A-Z][a-z]+)+)', 1) || regexp_extract_all(content, '(?i)\$[\d,\.]+\s*(?:million|billion|B|M|K)?|\d[\d,\.]*%') as e from {_FIRST_UNITS} where content is not null),
f as (select *, list_filter(e, lambda x, i: list_position(e, x) = i) as d, regexp_split_to_array(regexp_replace(t, '([.!?])\s+', '\1' || chr(57344), 'g'), chr(57344)) as s from u)
select ldu_id, {_LEVEL} as level, array_to_string(d[1:8], '; ') as entities,
  left({_strip("list_reduce(list_prepend('', s), lambda acc, x: case when length(acc) < 300 and length(x) > 20 then acc || x || ' ' else acc end)")}, 300) as summary from f""")
def unit_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Heading level, names and figures, and a summary of each unit."""
    return page_index.unit_notes(table(spark, folder, "ldus"))


def _fact(pattern: str, n: int) -> str:
    return f"select ldu_id, page, {n} as pattern_no, unnest(list_transform(list_zip(regexp_extract_all(content, '{pattern}', 1), regexp_extract_all(content, '{pattern}', 2)), lambda x, i: {{'i': i - 1, 'f': x[1], 'v': x[2]}})) as m from u"


_UNIT_CASE = " ".join(f"when contains(lower(value), '{u.lower()}') then '{u}'" for u in T.FACT_UNITS)


@_query(f"""
with u as (select ldu_id, content, page_refs[1] as page from {_FIRST_UNITS} where content is not null),
m as ({_fact(T.FACT, 0)} union all {_fact(T.MONEY_FACT, 1)}), s as (select ldu_id, page, pattern_no, m.i::int as match_no, {_strip("m.f")} as field_name, {_strip("m.v")} as value from m)
select *, case {_UNIT_CASE} end as unit from s where length(field_name) >= 3 and value <> ''""")
def extracted_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The facts that the patterns find in the units."""
    return facts.extracted(table(spark, folder, "ldus"))


@_query("select distinct on (id) id, doc_id, field_name, value, unit from facts where contains(lower(field_name), 'revenue') order by id limit 50")
def fact_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty facts about revenue."""
    return facts.looked_up(table(spark, folder, "facts"), "revenue")


@_query(f"""
with u as (select ldu_id, chunk_type, content_hash, provenance.source_path as path, case when len(provenance.spans) > 0 then provenance.spans
  else list_transform(coalesce(page_refs, []), lambda p: {{'page': p, 'bbox': bounding_box}}) end as spans from {_FIRST_UNITS})
select f.id, f.field_name, f.value, u.chunk_type, u.ldu_id is not null as has_source, regexp_extract(coalesce(nullif(f.source_path, ''), u.path), '([^/]*)$', 1) as document_name,
  case when u.ldu_id is not null then spans[1].page else f.page end as page, spans[1].bbox[1] as x0, spans[1].bbox[2] as y0, spans[1].bbox[3] as x1, spans[1].bbox[4] as y1,
  case when u.ldu_id is not null then u.content_hash else f.content_hash end as content_hash, coalesce(len(spans), 0)::int as n_spans
from (select distinct on (id) * from facts) f left join u using (ldu_id)""")
def facts_with_source(spark: SparkSession, folder: str) -> DataFrame:
    """Each fact with the unit it was taken from and where that stands: page, box, hash and document."""
    return facts.with_source(table(spark, folder, "facts"), table(spark, folder, "ldus"))


@_query("select doc_id, count(*) as n_facts, count(distinct field_name) as n_fields from facts group by doc_id")
def fact_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts per document, by a query of the user over the fact table."""
    return facts.selected(table(spark, folder, "facts"), "select doc_id, count(*) as n_facts, count(distinct field_name) as n_fields from {facts} group by doc_id")


@_query(r"""
with q as (select distinct trim(regexp_replace(field_name, '[,(].*$', '')) as question from facts where field_name is not null),
w as (select question, unnest(regexp_split_to_array(lower(question), '\s+')) as word from q),
s as (select question, ldu_id, sum((length(c) - length(replace(c, word, ''))) // length(word)) / count(*) as score from w, (select ldu_id, lower(content) as c from """ + _FIRST_UNITS + r""" where content is not null) group by all)
select question, row_number() over (partition by question order by score desc, ldu_id) as rank, ldu_id, score from s where score > 0 qualify rank <= 5""")
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    """For each measure named in the fact table, the five units that speak of it most."""
    return search.keyword_top(table(spark, folder, "ldus"), _measures(spark, folder))


@_query("""
with s as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as c from embeddings q, embeddings v where q.vec_id % 20 = 0 and v.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by c desc, vec_id) as rank, vec_id from s qualify rank <= 10""")
def vector_search(spark: SparkSession, folder: str) -> DataFrame:
    """For every vector whose id is divisible by 20, its ten nearest vectors."""
    vectors = table(spark, folder, "embeddings")
    return search.vector_top(vectors, vectors.where("vec_id % 20 = 0"))


@_query("""
with l as (select distinct event_id, doc_id, strategy_used, confidence, escalated, processing_time_s from ledger where event_id is not null)
select strategy_used, count(*) as n_events, count(distinct doc_id) as n_docs, sum((strategy_used in ('B', 'C'))::int)::bigint as n_escalated from l group by strategy_used""")
def ledger_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Events, documents and escalations of each strategy in the ledger, repeated events once."""
    rows = table(spark, folder, "ledger").where("event_id is not null").select("event_id", "doc_id", "strategy_used").distinct()
    return rows.groupBy("strategy_used").agg(
        F.count("*").alias("n_events"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.col("strategy_used").isin("B", "C").cast("int")).alias("n_escalated")
    )


@_query(f"select doc_id, chunk_type, count(*) as n_units, sum(length(content))::bigint as n_chars from {_FIRST_UNITS} group by all")
def unit_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Units and characters of each type in each document."""
    sizes = table(spark, folder, "ldus").select("ldu_id", "ingested_at", "doc_id", "chunk_type", F.length("content").alias("n"))
    return first_arrivals(sizes, "ldu_id", "ingested_at").groupBy("doc_id", "chunk_type").agg(F.count("*").alias("n_units"), F.sum("n").alias("n_chars"))


@_query("""
with e as (select distinct on (event_id) * from ledger where event_id is not null and event_ts is not null)
select strftime(event_ts, '%Y-%m-%d') as day, strategy_used, count(*) as n_events, sum(coalesce(escalated::int, 0))::bigint as n_escalated from e group by all""")
def ledger_days(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger read as a stream into an append-only table, counted by day and strategy."""
    return ledger.ledger_days(spark, f"{folder}/ledger.parquet")


def _measures(spark: SparkSession, folder: str) -> DataFrame:
    """The measures named in the fact table, as questions."""
    named = table(spark, folder, "facts").where("field_name is not null").select(F.trim(F.regexp_replace("field_name", r"[,(].*$", "")).alias("question"))
    return named.where("question <> ''").distinct()


_MEASURES = r"select distinct trim(regexp_replace(field_name, '[,(].*$', '')) as question from facts where field_name is not null and trim(regexp_replace(field_name, '[,(].*$', '')) <> ''"
_IN = lambda t, w: f"(length({t}) - length(replace({t}, {w}, ''))) // length({w})"


def _section_hits(asked: str, own: str, by: str) -> str:
    """The three best sections of each question; asked has the questions, `own` the columns that they share with sections."""
    return f"""texts as (select index_id, node_path, pre, lower(coalesce(title, '')) as t, lower(coalesce(summary, '')) as s, lower(replace(key_entities, '; ', chr(10))) as e from section),
words as (select question{own}, lower(question) as topic, unnest(list_filter(regexp_split_to_array(lower(trim(question)), '\\s+'), lambda x: x <> '')) as word from ({asked})),
counts as (select question{own if own else ', index_id'}, node_path, pre, any_value({_IN("t", "topic")}) * 3 + sum({_IN("t", "word")} * 2 + {_IN("s", "word")} * 0.5 + {_IN("e", "word")}) as score from words join texts {by} group by all),
found as (select question, row_number() over (partition by question{own} order by score desc, index_id, pre) as rank, index_id, node_path, score::double as score from counts where score > 0 qualify rank <= 3)"""


@_query(f"{SECTIONS}, {_section_hits(_MEASURES, '', 'on true')} select * from found")
def section_search(spark: SparkSession, folder: str) -> DataFrame:
    """For each measure named in the fact table, the three sections that speak of it most."""
    section = nested.node_tables(table(spark, folder, "page_indexes"))["section"]
    return agent.section_top(section, _measures(spark, folder))


_GENERIC = " or ".join(f"contains(lower(t), '{w}')" for w in agent.NO_TOPICS)
_CUES = {d: " or ".join(f"contains(x, '{w}')" for w in words) for d, words in agent.DOMAIN_CUES.items()}
_DOMAIN = " ".join(f"when {cues} then '{d}'" for d, cues in _CUES.items())
_TEMPLATE = " ".join(f"when '{d}' then [{', '.join(repr(t) for t in ts)}]" for d, ts in agent.TEMPLATES.items())
_QUESTIONS = f"""{SECTIONS}, titled as (select *, trim(coalesce(title, '')) as t from section),
judged as (select *, length(t) < 8 or {_GENERIC} or (regexp_matches(t, '^\\d+[.\\s]') and length(t) < 20) as dropped from titled),
seen as (select *, max(case when dropped then post end) over (partition by index_id order by pre rows between unbounded preceding and 1 preceding) as above, coalesce(lead(depth) over (partition by index_id order by pre) <= depth, true) as leaf from judged),
live as (select * from seen where not dropped and (above is null or above < post) and (depth > 1 or leaf) qualify row_number() over (partition by index_id, left(lower(t), 40) order by pre) = 1),
own as (select index_id, list(t order by pre)[1:3] as topics from live group by index_id),
tops_ as (select index_id, string_agg(coalesce(title, ''), ' ' order by pre) as titles from section where depth = 1 group by index_id),
docs as (select distinct on (index_id) index_id, doc_id from page_indexes where index_id is not null and doc_id is not null),
told as (select index_id, doc_id, lower(doc_id || ' ' || coalesce(titles, '')) as x, coalesce(topics, []) as f, list_filter(regexp_extract_all(regexp_replace(doc_id, '[_-]', ' ', 'g'), '[A-Za-z]{{4,}}'), lambda w: length(w) > 5) as w from docs left join tops_ using (index_id) left join own using (index_id)),
padded as (select index_id, doc_id, case {_DOMAIN} else 'general' end as domain, case when len(f) < 3 then f || w else f end as p from told),
three as (select index_id, doc_id, case domain {_TEMPLATE} end as templates, ((case when len(p) = 0 then ['the main subject', 'key findings', 'financial data'] else p end) || ['{agent.LAST_TOPIC}', '{agent.LAST_TOPIC}', '{agent.LAST_TOPIC}'])[1:3] as topics from padded),
asked as (select index_id, doc_id, i::int as question_no, replace(templates[i], '{{topic}}', topics[i]) as question from three, (select unnest([1, 2, 3]) as i))"""
_ANSWERS = f"""asks as (select doc_id, question, unnest(list_filter(regexp_split_to_array(trim(lower(question)), '\\s+'), lambda x: x <> '')) as word from (select distinct doc_id, question from asked)),
units as (select doc_id, ldu_id, content, lower(content) as c, content_hash, [x.page for x in case when len(provenance.spans) > 0 then provenance.spans else list_transform(coalesce(page_refs, []), lambda p: {{'page': p, 'bbox': bounding_box}}) end] as pages from {_FIRST_UNITS} where content is not null),
scored as (select doc_id, question, ldu_id, sum({_IN("c", "word")}) / count(*) as score from asks join units using (doc_id) group by all),
best as (select *, row_number() over (partition by doc_id, question order by score desc, ldu_id) as rank from scored where score > 0 qualify rank <= 3)"""
_NUMBERS = r"(?i)\b(?:revenue|profit|loss|expenditure|total|amount|cost|budget|income|tax|rate|ratio|value|year|quarter|q\d)\b"
_FACTS = f"""topics as (select distinct lower(regexp_extract(question, '{_NUMBERS}')) as topic from asked where regexp_matches(question, '{_NUMBERS}')),
firsts as (select topic, row_number() over (partition by topic order by id) as rank, id from topics join (select distinct on (id) id, lower(field_name) as f from facts where field_name is not null) on contains(f, topic) qualify rank <= 5)"""


@_query(f"{_QUESTIONS} select * from asked")
def document_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Three questions about each indexed document, from its sections."""
    indexes = table(spark, folder, "page_indexes")
    return agent.questions(indexes, nested.node_tables(indexes)["section"])


@_query(f"""{_QUESTIONS}, {_ANSWERS} select a.*, coalesce(left(content, 300), '{agent.NO_ANSWER}') as answer, b.ldu_id from asked a left join (select * from best where rank = 1) b using (doc_id, question) left join units u on u.ldu_id = b.ldu_id""")
def document_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Those questions with their answers from the documents' units."""
    return agent.answered(document_questions(spark, folder), table(spark, folder, "ldus"))


@_query(rf"""
with c as (select distinct on (id) id, doc_id, field_name || ' ' || value as claim from facts where id % 20 = 0 and field_name is not null and value is not null),
w as (select id, doc_id, claim, unnest(list_filter(regexp_split_to_array(trim(lower(claim)), '\s+'), lambda x: x <> '')) as word from c),
t as (select doc_id, ldu_id, content, lower(content) as c from {_FIRST_UNITS} where content is not null),
s as (select id, claim, t.ldu_id, any_value(content) as content, sum((length(c) - length(replace(c, word, ''))) // length(word)) / count(*) as score from w join t using (doc_id) group by id, claim, t.ldu_id),
k as (select *, row_number() over (partition by id order by score desc, ldu_id) as rank from s where score > 0 qualify rank <= 8),
o as (select id, ldu_id, rank, list_distinct(regexp_extract_all(lower(claim), '[\p{{L}}\p{{M}}\p{{N}}_]{{4,}}')) as m, list_distinct(regexp_extract_all(lower(left(content, 300)), '[\p{{L}}\p{{M}}\p{{N}}_]{{4,}}')) as h from k),
v as (select id, ldu_id, len(list_intersect(m, h)) / greatest(len(m), 1) as overlap, row_number() over (partition by id order by len(list_intersect(m, h)) / greatest(len(m), 1) desc, rank) as best from o qualify best = 1)
select c.id, c.doc_id, c.claim, case when coalesce(overlap, 0) >= 0.5 then 'verified' when coalesce(overlap, 0) >= 0.2 then 'unverifiable' else 'not_found' end as verdict,
  coalesce(overlap, 0.0)::double as overlap, case when overlap > 0.1 then ldu_id end as evidence_ldu from c left join v using (id)""")
def verified_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Every fact whose id is divisible by 20, as a claim held against its document."""
    claims = table(spark, folder, "facts").where("id % 20 = 0 and field_name is not null and value is not null").dropDuplicates(["id"])
    return agent.verified(claims.select("id", "doc_id", F.concat_ws(" ", "field_name", "value").alias("claim")), table(spark, folder, "ldus"))


@_query(f"{_QUESTIONS}, {_FACTS} select a.*, topic, rank, id from asked a join firsts on topic = lower(regexp_extract(question, '{_NUMBERS}'))")
def question_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Those questions that ask for numbers, with the first facts about what they ask for."""
    return agent.question_facts(document_questions(spark, folder), table(spark, folder, "facts"))


@_query(f"""{_QUESTIONS}, {_ANSWERS}, {_FACTS}, {_section_hits("select distinct index_id, question from asked", ", index_id", "using (index_id)")},
h as (select doc_id, question, min_by(left(content, 300), rank) as answer, string_agg(ldu_id, '; ' order by rank) as ldu_ids, string_agg(array_to_string(pages, ','), '; ' order by rank) as pages, string_agg(content_hash, '; ' order by rank) as hashes from best join units using (doc_id, ldu_id) group by all),
g as (select question, index_id, string_agg(node_path, '; ' order by rank) as sections from found group by all), f as (select topic, string_agg(id::varchar, '; ' order by rank) as fact_ids from firsts group by all)
select a.*, coalesce(answer, '{agent.NO_ANSWER}') as answer, coalesce(ldu_ids, '') as ldu_ids, coalesce(pages, '') as pages, coalesce(hashes, '') as hashes, coalesce(sections, '') as sections, coalesce(fact_ids, '') as fact_ids,
  case when regexp_matches(question, '{_NUMBERS}') then 'pageindex_navigate, semantic_search, structured_query' else 'pageindex_navigate, semantic_search' end as tools
from asked a left join h using (doc_id, question) left join g using (index_id, question) left join f on topic = lower(regexp_extract(question, '{_NUMBERS}'))""")
def answered_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Those questions answered in full: answer, evidence with its provenance, sections, facts, and the tools that found them."""
    indexes = table(spark, folder, "page_indexes")
    section = staged(nested.node_tables(indexes)["section"], "sections")
    return agent.ask(agent.questions(indexes, section), table(spark, folder, "ldus"), section, table(spark, folder, "facts"))
