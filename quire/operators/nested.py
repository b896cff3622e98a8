"""Deeply nested page-index records as flat tables that keep parent-child links.

A payload is one JSON text: `root` (pages with items) and `sections` (with child sections to any depth).
A depth-first traversal gives every node a pre-order and a post-order number; a node contains another when
its interval (pre, post) encloses the other's. The tables of nodes are linked by that containment.

Defined cases: a null, blank or truncated payload gives no rows; a null entry takes a place but is no node;
a list written as a single object counts as a list of one; a nested list written as JSON text is read;
payloads wrapped in an envelope and keys in camel case are read like the plain form.
Repeated rows of an index_id give each node once. Extra columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "index_id bigint, node_kind string, node_path string, place int, depth int, pre int, post int, fields string"
)
SECTION_FIELDS = (
    "title string, page_start int, page_end int, level int, summary string, key_entities array<string>, "
    "data_types_present array<string>, ldu_ids array<string>"
)
PAGE_FIELDS = "page int, data_types_present array<string>, char_count int, item_count int"
ITEM_FIELDS = (
    "ldu_id string, chunk_type string, snippet string, content_hash string, "
    "bbox struct<x0:double,y0:double,x1:double,y1:double>"
)
CHILDREN = {"section": ("child_sections", "childSections"), "page": ("items",)}


def _snake(key: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in key)


def _parsed(text):
    if not isinstance(text, str):
        return text
    try:
        return json.loads(text.lstrip("﻿"))
    except ValueError:
        return None


def _first(record: dict, keys: tuple[str, ...]):
    return next((record[k] for k in keys if record.get(k) is not None), None)


def _entries(value, object_keys: tuple[str, ...]) -> list[tuple[str | None, object]]:
    """(key, entry) of a list, of a map from place to entry, or of a single object in place of a list."""
    value = _parsed(value)
    if isinstance(value, dict):
        if not value or any(k in value for k in object_keys) or not all(str(k).isdigit() for k in value):
            return [(None, value)] if value else []
        return list(value.items())
    return [(None, x) for x in value] if isinstance(value, list) else []


def traverse(payload: str | None, with_fields: bool = True, kinds: tuple[str, ...] | None = None) -> list[tuple]:
    """(kind, path, place, depth, pre, post, fields) of each node of one payload, in pre-order; with kinds, of those alone, numbered as among all."""
    tree = _parsed(payload)
    tree = _parsed(tree)
    if isinstance(tree, dict) and isinstance(_parsed(tree.get("page_index")), dict):
        tree = _parsed(tree["page_index"])
    if not isinstance(tree, dict):
        return []
    out: list[list] = []
    clock = post = 0

    def frontier(kind: str, entries: list, prefix: str, depth: int) -> Iterator[tuple]:
        for place, (key, entry) in enumerate(entries, 1):
            if entry is not None:
                number = entry.get("page") if kind == "page" and isinstance(entry, dict) else None
                name = str(place if kind != "page" else number if number is not None else key or place)
                yield kind, entry, place, f"{prefix}.{name}" if prefix else name, depth

    stack: list[tuple[Iterator, list | None]] = [
        (frontier("section", _entries(tree.get("sections"), ("title", "page_start", "pageStart")), "", 1), None),
        (frontier("page", _entries(tree.get("root"), ("page", "items")), "", 1), None),
    ]
    while stack:  # explicit, as depth is not bounded
        nodes, owner = stack[-1]
        node = next(nodes, None)
        if node is None:
            stack.pop()
            if owner is not None:
                owner[5] = post = post + 1
            continue
        kind, entry, place, path, depth = node
        clock += 1
        keys = CHILDREN.get(kind, ())
        fields = None
        wanted = kinds is None or kind in kinds
        if with_fields and wanted:
            kept = {_snake(k): v for k, v in entry.items() if k not in keys} if isinstance(entry, dict) else {}
            fields = json.dumps(kept, ensure_ascii=False)
        row = [kind, path, place, depth, clock, 0, fields]
        if wanted:
            out.append(row)
        below = _first(entry, keys) if isinstance(entry, dict) else None
        child = "section" if kind == "section" else "item"
        stack.append((frontier(child, _entries(below, ("title", "ldu_id", "lduId", "chunk_type")), path, depth + 1), row))
    return [tuple(r) for r in out]


def nodes(page_indexes: DataFrame, with_fields: bool = True, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One row per node, of the given kinds or all, with its interval (pre, post); index_id and payload are the columns read."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *n) for i, p in zip(batch["index_id"], batch["payload"]) for n in traverse(p, with_fields, kinds)]
            yield pd.DataFrame(rows, columns=["index_id", "node_kind", "node_path", "place", "depth", "pre", "post", "fields"])

    valid = page_indexes.select("index_id", "payload").where("index_id is not null and payload is not null")
    return valid.mapInPandas(label, NODE_SCHEMA)


def linked(labelled: DataFrame) -> DataFrame:
    """Nodes with parent_pre and parent_path: the last node one level up, in pre-order, whose interval holds the node's.

    Each node enters the window of its own level as a child and that of the next level as a possible parent, so
    that one sort per (record, level) finds all links without pairing nodes. Repeated records collapse here.
    """
    both = labelled.select(
        "*",
        F.explode(F.array(F.struct(F.lit(1).alias("role"), F.col("depth").alias("lvl")), F.struct(F.lit(0).alias("role"), (F.col("depth") + 1).alias("lvl")))).alias("r"),
    ).select("*", "r.role", "r.lvl")
    order = Window.partitionBy("index_id", "lvl").orderBy("pre", "role").rowsBetween(Window.unboundedPreceding, 0)
    holder = F.struct("pre", "post", "node_path")
    above = both.where("role = 1 or node_kind <> 'item'").withColumn("up", F.last(F.when(F.col("role") == 0, holder), ignorenulls=True).over(order)).where("role = 1")
    held = (F.col("up.pre") < F.col("pre")) & (F.col("up.post") > F.col("post"))
    found = above.select(
        "index_id", "lvl", "node_kind", "node_path", "place", "depth", "pre", "post", "fields",
        F.when(held, F.col("up.pre")).alias("parent_pre"),
        F.coalesce(F.when(held, F.col("up.node_path")), F.lit("")).alias("parent_path"),
    )
    return found.dropDuplicates(["index_id", "lvl", "node_kind", "node_path", "parent_path"]).drop("lvl")


def node_tables(page_indexes: DataFrame) -> dict[str, DataFrame]:
    """The tables `section`, `page` and `item`, each with its own fields and the link columns.

    Each table emits and links only the kinds of nodes that it needs, so that sections do not pay for items.
    """
    keys = ["index_id", "node_path", "parent_path", "place", "depth", "pre", "post", "parent_pre"]
    tables = {}
    for kind, schema in (("section", SECTION_FIELDS), ("page", PAGE_FIELDS), ("item", ITEM_FIELDS)):
        rows = linked(nodes(page_indexes, kinds=("page", "item") if kind == "item" else (kind,))).where(F.col("node_kind") == kind)
        tables[kind] = rows.select(*keys, F.from_json("fields", schema).alias("f")).select(*keys, "f.*")
    return tables
