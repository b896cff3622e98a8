"""The registered queries of the general problems: nested records and quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import nested, quantities
from quire.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each section, page and item node of each page index, with its place and its parent."""
    labelled = nested.nodes(table(spark, folder, "page_indexes"), with_fields=False)
    return nested.linked(labelled).select("index_id", "node_kind", "node_path", "parent_path")


def p3_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The flat section table with its fields and interval labels; lists are written with semicolons."""
    rows = nested.node_tables(table(spark, folder, "page_indexes"))["section"]
    lists = ["key_entities", "data_types_present", "ldu_ids"]
    return rows.select(*(F.coalesce(F.array_join(c, "; "), F.lit("")).alias(c) if c in lists else c for c in rows.columns))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each facts row that states one measured quantity, in the common unit of its measure."""
    out = quantities.converted(table(spark, folder, "facts"), table(spark, folder, "ldus"), table(spark, folder, "unit_reference"))
    return out.select("id", "common_unit", "value_milli")


def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many facts are converted, and why the others are not."""
    out = quantities.readings(table(spark, folder, "facts"), table(spark, folder, "ldus"), table(spark, folder, "unit_reference"))
    return out.groupBy(F.coalesce("why", F.lit("converted")).alias("reason")).agg(F.count("*").alias("n_facts"))


def _json(x: str) -> str:
    """A value, or what it holds where it is JSON written as text."""
    return f"case when json_type({x}) = 'VARCHAR' then case when json_valid(json_extract_string({x}, '$')) then json_extract_string({x}, '$')::json end else {x} end"


def _entries(x: str, own: str) -> str:
    """The entries of a list, of a map from places to entries, or of a single object, which has one of its own keys."""
    p = f"({_json(x)})"
    return (
        f"case json_type({p}) when 'ARRAY' then json_extract({p}, '$[*]') when 'OBJECT' then case when len(json_keys({p})) = 0 then []::json[] "
        f"when len(list_intersect(json_keys({p}), [{own}])) > 0 or len(list_filter(json_keys({p}), lambda k: not regexp_matches(k, '^\\d+$'))) > 0 then [{p}] "
        f"else list_transform(json_keys({p}), lambda k: json_extract({p}, '$.\"' || k || '\"')) end else []::json[] end"
    )


def _field(name: str, camel: str) -> str:
    return f"coalesce(nullif(json_extract(node, '$.{name}'), 'null'::json), json_extract(node, '$.{camel}'))"


def _whole(name: str, camel: str) -> str:
    return f"case when json_type({_field(name, camel)}) in ('UBIGINT', 'BIGINT') then ({_field(name, camel)})::int end as {name}"


def _list(name: str, camel: str) -> str:
    return f"case when json_type({_field(name, camel)}) = 'ARRAY' then array_to_string(json_extract_string({_field(name, camel)}, '$[*]'), '; ') else '' end as {name}"


_CHILDREN = _entries("coalesce(nullif(json_extract(node, '$.child_sections'), 'null'::json), json_extract(node, '$.childSections'))", "'title', 'ldu_id', 'lduId', 'chunk_type'")
#: Common table expressions that end in `section`: the sections of all page indexes, as `p3_sections` has them.
SECTIONS = f"""with recursive payloads as (select distinct index_id, ltrim(payload, chr(65279)) as t from page_indexes where index_id is not null and payload is not null),
parsed as (select index_id, case when json_valid(t) then t::json end as v from payloads), unwrapped as (select index_id, {_json("v")} as v from parsed),
trees as (select index_id, case when json_type({_json("json_extract(v, '$.page_index')")}) = 'OBJECT' then {_json("json_extract(v, '$.page_index')")} else v end as v from unwrapped where json_type(v) = 'OBJECT'),
tops as (select index_id, {_entries("json_extract(v, '$.sections')", "'title', 'page_start', 'pageStart'")} as e from trees),
walk as (select index_id, path, node from (select index_id, [generate_subscripts(e, 1)] as path, unnest(e) as node from tops) where node is not null and json_type(node) <> 'NULL'
  union all select index_id, path, node from (select index_id, list_append(path, generate_subscripts(e, 1)) as path, unnest(e) as node from (select index_id, path, {_CHILDREN} as e from walk)) where node is not null and json_type(node) <> 'NULL'),
numbered as (select *, row_number() over (partition by index_id order by path) as pre, len(path) as depth from walk),
sizes as (select a.index_id, a.pre, count(*) as n from numbered a join numbered b on a.index_id = b.index_id and b.path[1:a.depth] = a.path group by all),
sheets as (select index_id, node from (select index_id, unnest({_entries("json_extract(v, '$.root')", "'page', 'items'")}) as node from trees) where node is not null and json_type(node) <> 'NULL'),
before as (select index_id, count(*) + sum(len(list_filter({_entries("json_extract(node, '$.items')", "'title', 'ldu_id', 'lduId', 'chunk_type'")}, lambda x: x is not null and json_type(x) <> 'NULL'))) as first from sheets group by index_id),
section as (select c.index_id, array_to_string(c.path, '.') as node_path, array_to_string(c.path[:-2], '.') as parent_path, c.path[-1]::int as place, c.depth::int as depth, (c.pre + coalesce(first, 0))::int as pre, (c.pre + n - c.depth + coalesce(first, 0))::int as post, (p.pre + coalesce(first, 0))::int as parent_pre,
  json_extract_string(c.node, '$.title') as title, {_whole("page_start", "pageStart").replace("node", "c.node")}, {_whole("page_end", "pageEnd").replace("node", "c.node")}, {_whole("level", "level").replace("node", "c.node")}, json_extract_string(c.node, '$.summary') as summary,
  {_list("key_entities", "keyEntities").replace("node", "c.node")}, {_list("data_types_present", "dataTypesPresent").replace("node", "c.node")}, {_list("ldu_ids", "lduIds").replace("node", "c.node")}
  from numbered c join sizes using (index_id, pre) left join before using (index_id) left join numbered p on p.index_id = c.index_id and p.path = c.path[:-2])"""

QUERIES = {"p3_found": p3_found, "p3_sections": p3_sections, "p5_found": p5_found, "p5_reasons": p5_reasons}
SQL = {"p3_sections": f"{SECTIONS} select * from section"}
