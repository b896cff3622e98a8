"""Nested records: traversal, interval labels and links, against a plain recursive walk."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import nested

SECTION = st.deferred(lambda: st.fixed_dictionaries({"title": st.text(max_size=5)}, optional={"child_sections": st.lists(st.none() | SECTION, max_size=3) | st.none()}))
PAYLOAD = st.fixed_dictionaries({"sections": st.lists(st.none() | SECTION, max_size=4), "root": st.lists(st.fixed_dictionaries({"page": st.integers(1, 99), "items": st.lists(st.none() | st.just({"ldu_id": "x"}), max_size=3)}), max_size=3, unique_by=lambda p: p["page"])})


def walk(payload):
    """Paths of all nodes by plain recursion."""
    out = set()

    def down(entries, prefix):
        for i, e in enumerate(entries or [], 1):
            if e is not None:
                path = f"{prefix}.{i}" if prefix else str(i)
                out.add(("section", path))
                down(e.get("child_sections"), path)

    down(payload["sections"], "")
    for page in payload["root"]:
        out.add(("page", str(page["page"])))
        out |= {("item", f"{page['page']}.{i}") for i, x in enumerate(page["items"], 1) if x is not None}
    return out


@settings(max_examples=60, deadline=None)
@given(PAYLOAD)
def test_traversal_finds_every_node_and_labels_nest(payload):
    rows = nested.traverse(json.dumps(payload))
    assert {(r[0], r[1]) for r in rows} == walk(payload)
    for kind, path, _place, depth, pre, post, _ in rows:
        inside = [r for r in rows if r[4] > pre and r[5] < post]
        assert all(r[3] > depth for r in inside)
        below = [r for r in rows if r[0] in (kind, "item") and r[1].startswith(path + ".") and kind != "item" and (r[0] == kind or kind == "page")]
        assert {id(r) for r in below} <= {id(r) for r in inside}


def test_writer_versions_and_broken_payloads(spark):
    deep = {"title": "0"}
    for i in range(1, 300):
        deep = {"title": str(i), "childSections": [deep]}
    cases = [
        (1, json.dumps({"sections": [{"title": "a", "child_sections": {"title": "b"}}, None, {"title": "c"}], "root": {"7": {"items": {"ldu_id": "u"}}}})),
        (2, json.dumps({"schema": 2, "page_index": {"sections": json.dumps([{"title": "x"}]), "root": [{"page": 3, "items": [None, {"ldu_id": "v"}]}]}})),
        (3, '{"sections": [{"title": "cut'),
        (4, None),
        (5, ""),
        (6, "[]"),
        (7, json.dumps({"sections": [deep], "root": None})),
        (1, json.dumps({"sections": [{"title": "a", "child_sections": {"title": "b"}}, None, {"title": "c"}], "root": {"7": {"items": {"ldu_id": "u"}}}})),
        (None, "{}"),
    ]
    df = spark.createDataFrame([(i, p, "extra") for i, p in cases], "index_id bigint, payload string, node_path string")
    rows = nested.linked(nested.nodes(df, with_fields=False)).select("index_id", "node_kind", "node_path", "parent_path").collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    assert {r for r in got if r[0] == 1} == {(1, "section", "1", ""), (1, "section", "1.1", "1"), (1, "section", "3", ""), (1, "page", "7", ""), (1, "item", "7.1", "7")}
    assert {r for r in got if r[0] == 2} == {(2, "section", "1", ""), (2, "page", "3", ""), (2, "item", "3.2", "3")}
    assert {r[0] for r in got} == {1, 2, 7} and sum(r[0] == 7 for r in got) == 300


def test_tables_by_kind_keep_fields_and_an_empty_table(spark):
    one = spark.createDataFrame([(1, json.dumps({"sections": [{"title": "t", "pageStart": 2, "lduIds": ["a"]}], "root": [{"page": 1, "items": [{"lduId": "q", "chunkType": "text"}]}]}))], "index_id bigint, payload string")
    tables = nested.node_tables(one)
    s = tables["section"].first()
    assert (s.title, s.page_start, s.ldu_ids) == ("t", 2, ["a"])
    i = tables["item"].first()
    assert (i.ldu_id, i.chunk_type) == ("q", "text") and i.parent_pre == tables["page"].first().pre
    assert nested.linked(nested.nodes(one.limit(0))).count() == 0


def test_some_kinds_are_numbered_as_among_all():
    payload = json.dumps({"root": [{"page": 1, "items": [{"snippet": "x"}]}], "sections": [{"title": "a", "child_sections": [{"title": "b"}]}]})
    every = nested.traverse(payload)
    for kinds in (("section",), ("page", "item"), ("page",)):
        assert nested.traverse(payload, kinds=kinds) == [n for n in every if n[0] in kinds]
