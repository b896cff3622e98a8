"""Blocks by each strategy, results and summaries of runs, profiles from blocks, language replies, sinks and rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from quire.operators import agent, extract, page_index, replies, runs, triage
from quire.sources import files

NOW = datetime.datetime(2024, 1, 1)
PAGE = "doc_id string, page int, text string, words array<struct<x0:double,top:double,x1:double,bottom:double>>, tables array<array<array<string>>>, page_count int"


def test_page_blocks_take_tables_first(spark):
    rows = [
        ("d", 1, "1. Revenue and costs\nab\nFigure 2 shows\nplain text", [(5.0, 6.0, 7.0, 8.0), (1.0, 9.0, 2.0, 10.0)], [[["a", None], [" b ", "c"]], [[], ["lost"]], [["x"]], None], 9),
        ("d", 2, None, None, None, 9), ("e", 1, "  ", [], [[["only", "table"]]], 9),
    ]
    got = {(r.doc_id, r.page, r.pos): (r.block_type, r.text, r.bbox) for r in extract.page_blocks(spark.createDataFrame(rows, PAGE)).collect()}
    box = [1.0, 6.0, 7.0, 10.0]
    assert got == {
        ("d", 1, 0): ("table", "a | \nb | c", box), ("d", 1, 1): ("header", "1. Revenue and costs", box), ("d", 1, 2): ("figure", "Figure 2 shows", box),
        ("d", 1, 3): ("text", "plain text", box), ("e", 1, 0): ("table", "only | table", None),
    }
    assert [(r.doc_id, r.page) for r in extract.layer_blocks(spark.createDataFrame(rows, PAGE)).collect()] == [("d", 1)]
    assert extract.page_blocks(spark.createDataFrame([], PAGE)).count() == 0


def test_markdown_blocks_may_stand_on_any_page(spark):
    docs = spark.createDataFrame([("d", 3, "# A\n\nx\n# B"), ("e", None, "y"), ("f", 2, None), ("g", 0, "")], "doc_id string, page_count int, markdown string")
    got = [(r.doc_id, r.pos, r.block_type, r.text, [s.page for s in r.spans]) for r in extract.markdown_blocks(docs).orderBy("doc_id", "pos").collect()]
    assert got == [("d", 0, "text", "# A", [1, 2, 3]), ("d", 1, "text", "x", [1, 2, 3]), ("d", 2, "text", "# B", [1, 2, 3]), ("e", 0, "text", "y", [1])]


def test_routed_blocks_and_results(spark):
    text = "1. Revenue and costs\n\nPaid: 5\n\nab"
    rows = [(s, t, s[0], 0.5, s) for s in ("A", "B", "C1", "C2", "C3") for t in (text, " ", None)]
    routes = spark.createDataFrame(rows, "step string, t string, strategy string, confidence double, trace string").withColumn("k", F.concat("step", F.coalesce(F.length("t").cast("string"), F.lit("-"))))
    got = {}
    for r in extract.routed_blocks(routes, "k", "t").orderBy("k", "pos").collect():
        got.setdefault(r.step, []).append((r.block_type, r.text))
    assert got == {
        "A": [("header", "1. Revenue and costs"), ("text", "Paid: 5")], "B": [("text", "1. Revenue and costs"), ("text", "Paid: 5"), ("text", "ab")],
        "C1": [("text", text)], "C2": [("text", "1. Revenue and costs"), ("table", "Paid: 5"), ("text", "ab")],
    }
    out = {r.k: (r.n_blocks, r.error, r.confidence, r.escalated) for r in extract.run_results(routes, "k", "t").collect()}
    n = str(len(text))
    assert out["A" + n] == (2, None, 0.5, False) and out["C2" + n] == (3, None, 0.5, True) and out["C3" + n] == (0, "no reply of a vision model", 0.0, True)
    assert out["B1"] == out["B-"] == (0, "no text", 0.0, True)
    short = routes.where("step = 'A'").withColumn("t", F.lit("ab"))
    assert {r.error for r in extract.run_results(short, "k", "t").collect()} == {"no blocks"}


def test_reply_languages(spark):
    cases = {
        '{"language": "AM "}': "am", '```json\n{"language": "fr"}\n```': "fr", 'Sure: {"x": 1, "language": "en"} ok': "en", "The language is Amharic": "am", "it is Tigrinya": "am",
        "mixed english text": "mixed", "mixed": "mixed", "latin script": "en", "ሰላም": "am", "x\nEN.": "en", "other": None, '{"language": "other"}': None, "?": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string")
    assert {r.raw: r.l for r in rows.select("raw", replies.reply_language(F.col("raw")).alias("l")).collect()} == cases | {None: None}


def test_replies_tell_scanned_documents_that_nothing_else_tells(spark):
    signals = spark.createDataFrame([(d, 1, 0.0, 1.0) for d in ("a", "b", "c", "amharic-d")], "doc_id string, page_count int, avg_text_chars_per_page double, avg_image_area_ratio double")
    none = spark.createDataFrame([], "doc_id string, approx_column_count int, tableish_score double, figureish_score double")
    samples = spark.createDataFrame([], "doc_id string, sample string")
    said = spark.createDataFrame([("a", "am"), ("b", '{"language": "fr"}'), ("c", "?"), ("amharic-d", "english")], "doc_id string, raw string")
    got = {r.doc_id: (r.language, r.language_confidence) for r in triage.profiled(signals, none, samples, replies=said).collect()}
    assert got == {"a": ("am", 0.9), "b": ("fr", 0.75), "c": ("en", 0.4), "amharic-d": ("am", 0.85)}


def test_document_profiles(spark):
    block = "block_id string, doc_id string, text string, provenance struct<spans:array<struct<page:int,bbox:array<double>>>>, extracted_at timestamp_ntz"
    at = lambda p: ([(p, None)],)
    long = "The court heard a patient. " * 40
    rows = [("1", "d", long, at(1), NOW), ("1", "d", long, at(1), NOW), ("2", "d", "tax", at(3), NOW), ("3", "d", None, None, NOW), ("4", "s", " ", at(1), None), ("5", None, "x", at(1), NOW)]
    profile = "profile_id bigint, doc_id string, page_count int, avg_image_area_ratio double, layout_complexity string, profiled_at timestamp_ntz"
    told = [(1, "d", 9, 1.0, "multi_column", NOW), (2, "d", 9, 0.0, "single_column", NOW), (3, "s", 7, 0.9, "figure_heavy", NOW), (4, "amharic", None, 0.9, None, None), (5, None, 1, 0.9, None, None)]
    got = {r.doc_id: r for r in triage.document_profiles(spark.createDataFrame(rows, block), spark.createDataFrame(told, profile)).collect()}
    d = got["d"]
    assert (d.origin_type, d.layout_complexity, d.language, d.domain_hint, d.page_count, d.cost_tier) == ("native_digital", "single_column", "en", "legal", 3, "fast_text_sufficient")
    assert d.avg_text_chars_per_page == pytest.approx((len(long.strip()) + 3) / 3)
    assert (got["s"].origin_type, got["s"].language, got["s"].page_count, got["s"].domain_hint) == ("scanned_image", "en", 1, None)
    assert (got["amharic"].language, got["amharic"].language_confidence, got["amharic"].cost_tier) == ("am", 0.85, "needs_vision_model") and len(got) == 3


def test_words_of_a_domain_as_bits(spark):
    texts = ["Tax and profit", "court and tax", "nothing", "", "patient diagnosis tax"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(triage.domain_of(F.col("t")).alias("a"), triage.domain_of_bits(F.when(F.col("t") != "", triage.domain_bits(F.col("t")))).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_run_summaries_keep_failed_documents(spark):
    profiles = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "doc_id string")
    blocks = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "a"), (None, "b")], "block_id string, doc_id string")
    units = spark.createDataFrame([("u", "a"), ("u", "a")], "ldu_id string, doc_id string")
    broken = spark.createDataFrame([("a", "R1")], "doc_id string, rule string")
    events = spark.createDataFrame([(1, "a", "A", 0.3, None, NOW), (2, "a", "B", 0.8, "up", NOW), (3, "b", "C", 0.1, None, None)], "event_id bigint, doc_id string, strategy_used string, confidence double, notes string, event_ts timestamp_ntz")
    got = {r.doc_id: tuple(r)[1:] for r in runs.run_summaries(profiles, blocks, units, broken, events).collect()}
    assert got == {"a": ("B", 0.8, 2, 1, 1, "up", None), "b": ("C", 0.1, 0, 0, 0, None, "no blocks"), "c": (None, None, 0, 0, 0, None, "not extracted")}


def test_page_lookups_and_totals(spark):
    pages = spark.createDataFrame([("d", 1, 2, 30, "text")], "doc_id string, page int, item_count bigint, char_count bigint, data_types string")
    asked = spark.createDataFrame([(1, "d", 1), (2, "d", 2), (3, None, 1), (4, "d", None)], "id int, doc_id string, page int")
    assert {r.id: (r.found, r.item_count) for r in page_index.page_lookups(asked, pages).collect()} == {1: (True, 2), 2: (False, None), 3: (False, None), 4: (False, None)}
    answers = spark.createDataFrame([("d", "u"), ("d", None), ("e", "v")], "doc_id string, ldu_id string")
    assert tuple(agent.totals(answers).first()) == (2, 3, 2) and tuple(agent.totals(answers.limit(0)).first()) == (0, 0, 0)


def test_append_new_stores_each_key_once(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", None, "y")], "k string, n int, v string")
    files.append_new(rows, path, "k", "n")
    files.append_new(rows.unionByName(spark.createDataFrame([("a", 2, "z")], rows.schema)), path, "k", "n")
    assert sorted((r.k, r.n or 0, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1, "x"), ("a", 2, "z"), ("b", 0, "y")]


def test_rules(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("triage:\n  image_share: 0.5\n  names: [a, ሀ]\n")
    (tmp_path / "e.yaml").write_text("# none\n")
    assert files.rules(spark, str(tmp_path / "r.yaml")) == {"triage": {"image_share": 0.5, "names": ["a", "ሀ"]}} and files.rules(spark, str(tmp_path / "e.yaml")) == {}
