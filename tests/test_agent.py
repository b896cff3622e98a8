"""Questions, answers, claims, section search, model replies and page signals."""

import datetime
import json

from pyspark.sql import functions as F

from quire.operators import agent, nested, replies

NOW = datetime.datetime(2024, 1, 1)


def indexes(spark, *docs):
    return spark.createDataFrame([(i, d, json.dumps({"sections": s})) for i, d, s in docs], "index_id bigint, doc_id string, payload string")


def test_questions_skip_generic_titles_with_their_subtrees(spark):
    tree = [{"title": "Introduction", "child_sections": [{"title": "Lost below it"}]}, {"title": "Revenue growth", "child_sections": [{"title": "Regional branches"}, {"title": "REGIONAL branches"}]}, {"title": "1. Short"}, {"title": "Capital works"}]
    df = indexes(spark, (1, "neri_minutes-2020", tree), (2, "audit-x", []), (3, None, []))
    got = {}
    for r in agent.questions(df, nested.node_tables(df)["section"]).orderBy("index_id", "question_no").collect():
        got.setdefault(r.index_id, []).append(r.question)
    assert got[1] == ["What is the total Regional branches reported in this document?", "What are the key figures for Capital works?", "What does the document say about minutes?"]
    assert got[2] == ["What audit findings are reported for the main subject?", "What recommendations were made about key findings?", "Were there any irregularities or issues found in financial data?"]
    assert set(got) == {1, 2}


def test_answers_and_claims_stay_within_their_document(spark):
    units = spark.createDataFrame([("a1", "a", "Revenue was 42 in the north."), ("a2", "a", "Nothing else here."), ("b1", "b", "Revenue revenue revenue was 7."), ("a1", "a", "Revenue was 42 in the north."), ("c1", "c", None)], "ldu_id string, doc_id string, content string").withColumn("ingested_at", F.lit(NOW))
    asked = spark.createDataFrame([("a", "revenue north"), ("b", "revenue"), ("c", "revenue"), ("a", "zzz")], "doc_id string, question string")
    got = {(r.doc_id, r.question): (r.answer, r.ldu_id) for r in agent.answered(asked, units).collect()}
    assert got[("a", "revenue north")] == ("Revenue was 42 in the north.", "a1") and got[("b", "revenue")][1] == "b1"
    assert got[("c", "revenue")] == (agent.NO_ANSWER, None) == got[("a", "zzz")]
    claims = spark.createDataFrame([("a", "revenue north region"), ("b", "revenue north region"), ("b", "zzzz")], "doc_id string, claim string")
    verdicts = {(r.doc_id, r.claim): (r.verdict, r.evidence_ldu) for r in agent.verified(claims, units).collect()}
    assert verdicts == {("a", "revenue north region"): ("verified", "a1"), ("b", "revenue north region"): ("unverifiable", "b1"), ("b", "zzzz"): ("not_found", None)}
    assert agent.verified(claims.limit(0), units).count() == 0


def test_section_scores(spark):
    df = indexes(spark, (1, "d", [{"title": "Tax and tax", "summary": "on tax", "key_entities": ["Tax Office"]}, {"title": "Other", "summary": None}]))
    rows = agent.section_top(nested.node_tables(df)["section"], spark.createDataFrame([("tax",), ("zzz",)], "question string")).collect()
    assert [(r.question, r.node_path, r.score) for r in rows] == [("tax", "1", 2 * 3 + 2 * 2 + 0.5 + 1)]


def test_replies(spark):
    good = {"doc_type": "Report", "full_text": "All.", "sections": [{"heading": "H", "body": "All."}, {"heading": None, "body": "B"}], "tables": [{"caption": "T", "rows": [["a", None], ["c", "d"]]}], "key_fields": [{"name": "n", "value": "v"}, {"name": "only", "value": None}]}
    rows = [("d", 1, "```json\n" + json.dumps(good) + "\n```"), ("d", 2, "noise " + json.dumps({"full_text": "x"}) + " more"), ("d", 3, "no json"), ("d", 4, None), ("d", 5, "[1]")]
    got = {}
    for r in replies.reply_blocks(spark.createDataFrame(rows, "doc_id string, page int, raw string")).orderBy("page", "pos").collect():
        got.setdefault(r.page, []).append((r.block_type, r.text))
    assert got[1] == [("section_header", "Report"), ("text", "All."), ("section_header", "H"), ("text", "B"), ("table", "T\na | \nc | d"), ("table", "n: v\nonly")]
    assert got[2] == [("text", "x")] and got[3] == [("text", "no json")] and got[5] == [("text", "[1]")] and 4 not in got


def test_page_signals(spark):
    schema = "doc_id string, page int, width double, height double, text string, images array<struct<x0:double,y0:double,x1:double,y1:double>>"
    pages = spark.createDataFrame([("d", 1, 10.0, 10.0, " abc ", [(0.0, 0.0, 5.0, 10.0)]), ("d", 2, 10.0, 10.0, None, None), ("d", 11, 10.0, 10.0, "x" * 99, None), ("e", 1, 0.0, 0.0, "", [])], schema)
    got = {r.doc_id: (r.page_count, r.avg_text_chars_per_page, r.avg_image_area_ratio) for r in replies.page_signals(pages).collect()}
    assert got == {"d": (3, 1.5, 0.25), "e": (1, 0.0, 0.0)}
    edges = spark.createDataFrame([([10.0, 12.0, 50.0, 300.0, 320.0],), ([],), ([0.0, 40.0, 80.0, 120.0, 160.0],)], "x array<double>")
    assert [r[0] for r in edges.select(replies.column_count(F.col("x"))).collect()] == [3, 1, 4]


def test_facts_for_questions(spark):
    asked = spark.createDataFrame([(1, "What is the Total revenue?"), (2, "Who signed?"), (3, None)], "k int, question string")
    facts = spark.createDataFrame([(i, f) for i, f in [(5, "Total deposits"), (2, "Subtotal"), (3, "Net profit"), (4, None), (2, "Subtotal")]], "id bigint, field_name string")
    assert [(r.k, r.topic, r.rank, r.id) for r in agent.question_facts(asked, facts).orderBy("rank").collect()] == [(1, "total", 1, 2), (1, "total", 2, 5)]


def test_ingest_adds_new_rows_only(spark):
    from quire.operators import search, triage

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "ldu_id string, n int")
    assert [r.ldu_id for r in search.new_rows(rows, rows.where("n = 1"), "ldu_id").collect()] == ["b"]
    names = spark.createDataFrame([("x-e.c-2",), ("ሰነድ",), ("report",)], "d string")
    assert [r[0] for r in names.select(triage.named_language(F.col("d"))).collect()] == ["am", "am", "en"]


def test_few_and_many_words_are_counted_alike(spark, monkeypatch):
    from quire.operators import search

    texts = [("a1", "a", "Tax taxes and TAX of the\tnorth"), ("a1", "a", "Tax taxes and TAX of the\tnorth"), ("a2", "a", "no. No north"), ("b1", "b", "ታክስ tax"), ("b2", "b", ""), ("b3", "b", None), (None, "b", "tax"), ("c1", None, "tax")]
    units = spark.createDataFrame(texts, "ldu_id string, doc_id string, content string")
    asked = spark.createDataFrame([("a", "tax north tax"), ("a", "no"), ("b", "ታክስ of tax"), (None, "tax"), ("z", "tax"), ("a", None), ("b", " ")], "doc_id string, question string")
    found = {}
    for few in (0, 2, 64):
        monkeypatch.setattr(search, "FEW_WORDS", few)
        found[few] = sorted((r.doc_id, r.question, r["rank"], r.ldu_id, r.score) for r in search.keyword_top(units, asked, within="doc_id").collect())
    assert found[0] == found[2] == found[64] and ("a", "tax north tax", 1, "a1", 7 / 3) in found[64] and ("a", "no", 1, "a2", 3.0) in found[64]
    assert search.keyword_top(units, asked.limit(0), within="doc_id").count() == 0
