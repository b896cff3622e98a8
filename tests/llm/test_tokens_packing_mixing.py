"""Token sizes against the tokenizer, containers against their rules, drawing against a plain queue."""

import collections
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import mixing, packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def sizer():
    return tokens.Sizer()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZ 's'tre'll \n\t .,!?-#$12½ééا،ሀ።ก้界😀　")) | st.characters(), min_size=1, max_size=40), min_size=1, max_size=8))
def test_sizes_are_exact(sizer, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    got, _ = sizer.measure(texts)
    assert got.tolist() == [len(sizer.encoding.encode_ordinary(t)) for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text number {i} " * (i % 40), ["Bank-Reports", "web_mirror", " tax notes ", None, "other"][i % 5]) for i in range(400)]
    rows += [(1000 + i, "same copy of a text " * 9, "web_mirror") for i in range(200)] + [(2000, "w" * 3 + " word" * 3000, "web_mirror"), (2001, None, "web_mirror"), (2002, "", "web_mirror"), (None, "x", "web_mirror")]
    return spark.createDataFrame([(*r, 1) for r in rows + rows[:30]], "doc_id bigint, text string, source string, n_tokens int")


def test_containers(spark, docs):
    specs = spark.createDataFrame([("small", 128), ("large", 1000), ("bad", 0), (None, 5)], "container_name string, capacity_tokens int")
    out = packing.packed(docs, specs, "doc_id", "text")
    rows = out.collect()
    sizes = {r.doc_id: r.n_tokens for r in tokens.sized_texts(docs, "doc_id", "text").collect() if r.n_tokens}
    for name, cap in (("small", 128), ("large", 1000)):
        own = [r for r in rows if r.container_name == name]
        filled, parts = collections.Counter(), collections.defaultdict(list)
        for r in own:
            filled[r.container_id] += r.n_tokens
            parts[r.doc_id].append((r.first_token, r.n_tokens))
        assert max(filled.values()) <= cap
        assert set(parts) == set(sizes)
        for d, p in parts.items():
            p.sort()
            assert sum(n for _, n in p) == sizes[d] and [a for a, _ in p] == [i * cap for i in range(len(p))]
            assert len(p) == 1 or sizes[d] > cap
        assert sum(filled.values()) / (len(filled) * cap) > 0.9
    assert {r.container_name for r in rows} == {"small", "large"}
    report = packing.fill_report(out, specs)
    assert {r.container_name for r in report.collect()} == {"small", "large"}
    assert packing.packed(docs.limit(0), specs, "doc_id", "text").count() == 0
    assert packing.packed(docs, specs.limit(0), "doc_id", "text").count() == 0


def test_containers_hang_on_the_data_alone(spark, docs, monkeypatch):
    """Cells of a few texts, several levels: the same containers whatever the partitions, and neighbours together."""
    import numpy as np

    monkeypatch.setattr(packing, "CELL", 16)
    monkeypatch.setattr(packing, "AHEAD", 12)
    specs = spark.createDataFrame([("small", 700)], "container_name string, capacity_tokens int")
    rows = lambda d: {(r.doc_id, r.piece_no): r.container_id for r in packing.packed(d, specs, "doc_id", "text").collect()}
    first = rows(docs)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert rows(docs.repartition(5)) == first
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    place = {r.doc_id: r.curve for r in packing.curve_keys(tokens.sized_texts(docs, "doc_id", "text"), "doc_id").collect()}
    order = {d: i for i, (_, d) in enumerate(sorted((c, d) for d, c in place.items()))}
    own = collections.defaultdict(list)
    for (d, _), c in first.items():
        own[c].append(order[d])
    span = lambda groups: np.mean([np.subtract(*np.percentile(g, [75, 25])) for g in groups if len(g) > 2])
    dealt = np.random.default_rng(1).permutation([x for g in own.values() for x in g])
    shuffled = np.split(dealt, np.cumsum([len(g) for g in own.values()])[:-1])
    assert span(own.values()) < 0.5 * span(shuffled)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80), st.integers(1, 20))
def test_fill_keeps_every_item_within_capacity(sizes, ahead):
    put = packing.fill(sizes, 100, ahead)
    filled = collections.Counter()
    for size, c in zip(sizes, put):
        filled[c] += size
    assert max(filled.values()) <= 100 and sorted(filled) == list(range(len(filled)))
    firsts = [put.index(c) for c in range(len(filled))]
    assert firsts == sorted(firsts)


def test_hilbert_neighbours_touch():
    """Along a small cube every step of the curve changes one coordinate by one."""
    import numpy as np

    cells = np.array([[a, b, c, d] for a in range(4) for b in range(4) for c in range(4) for d in range(4)])
    order = cells[np.argsort(packing.hilbert(cells))]
    assert len(set(packing.hilbert(cells).tolist())) == 256
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


TARGETS = [("bank_reports", 0.5, 1), ("web_mirror", 0.2, 1), ("tax_notes", 0.2, 3), ("absent", 0.1, 2)]


@pytest.mark.parametrize("budget", [None, 900, 6000])
def test_drawing(spark, docs, budget):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    rows = [r.asDict() for r in mixing.drawn(docs, targets, "doc_id", "text", "source", budget=budget).collect()]
    assert [r["finish_time"] for r in rows] == sorted(r["finish_time"] for r in rows)
    assert max(collections.Counter((r["source"], r["doc_id"], r["copy_no"]) for r in rows).values()) == 1
    times = collections.Counter((r["source"], r["doc_id"]) for r in rows)
    assert all(n <= {"bank_reports": 1, "web_mirror": 1, "tax_notes": 3}[s] for (s, _), n in times.items())
    total, spent = sum(r["n_tokens"] for r in rows), collections.Counter()
    for r in rows:
        spent[r["source"]] += r["n_tokens"]
        assert abs(r["finish_time"] * {"bank_reports": 5 / 9, "web_mirror": 2 / 9, "tax_notes": 2 / 9}[r["source"]] - spent[r["source"]]) < 1e-6 * total + 1e-6
    report = {r.source: r for r in mixing.shares(docs, targets, "doc_id", "text", "source", budget=budget).collect()}
    assert report["absent"].n_tokens == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    for s, r in report.items():
        assert r.n_tokens == spent[s] and abs(r.actual_share - r.reachable_share) < 0.01, (s, r)
    if budget:
        assert budget * 0.99 <= total <= budget
        assert all(abs(report[s].reachable_share - w) < 1e-9 for s, w in (("bank_reports", 5 / 9), ("web_mirror", 2 / 9), ("tax_notes", 2 / 9))) or budget > 900


def test_a_source_that_runs_out_leaves_its_part_to_the_others(spark):
    docs = spark.createDataFrame([(i, "a few words of text " * 5, "x" if i < 10 else "y" if i < 400 else "z") for i in range(1000)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("x", 0.5, 2), ("y", 0.3, 1), ("z", 0.2, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: (r.n_texts, round(r.reachable_share, 3), round(r.actual_share, 3)) for r in mixing.shares(docs, targets, "doc_id", "text", "source", budget=10000).collect()}
    whole = sum(n for n, _, _ in got.values())
    assert got["x"][0] == 20 and all(abs(r - a) < 0.01 for _, r, a in got.values())
    assert abs(got["y"][0] / (whole - 20) - 0.6) < 0.01


def test_drawing_with_budget_and_empty_tables(spark, docs):
    targets = spark.createDataFrame([("web_mirror", 0.6, 1), ("tax_notes", 0.4, 2)], "source string, target_share double, max_repeats int")
    rows = mixing.drawn(docs, targets, "doc_id", "text", "source", budget=500.0).collect()
    assert 0 < sum(r.n_tokens for r in rows) <= 500
    assert mixing.drawn(docs.limit(0), targets, "doc_id", "text", "source").count() == 0
    assert mixing.drawn(docs, targets.limit(0), "doc_id", "text", "source").count() == 0
