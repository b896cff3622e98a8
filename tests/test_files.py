"""Files in and out, cache states, ledger events, layout signals and extraction scores."""

import json

from pyspark.sql import functions as F

from quire.operators import agent, extract, facts, replies, route, search
from quire.sources import files
from quire.streaming import ledger


def test_pdf_files(spark, tmp_path):
    for name in ("b.pdf", "a.b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"%PDF" + name.encode())
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.pdf").write_bytes(b"%PDF")
    assert [r.doc_id for r in files.pdf_files(spark, str(tmp_path)).collect()] == ["a.b", "b"]
    assert [r.doc_id for r in files.pdf_files(spark, str(tmp_path), recursive=True, limit=2).collect()] == ["a.b", "b"]
    assert files.pdf_files(spark, str(tmp_path), recursive=True).count() == 3


def test_artefacts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text(json.dumps([{"doc_id": "a", "n": 1}, {"doc_id": "b", "n": 2}], indent=2))
    (tmp_path / "in" / "y.json").write_text(json.dumps({"doc_id": "ሀ", "n": 3}, indent=2, ensure_ascii=False))
    rows = files.json_artefacts(spark, str(tmp_path / "in"))
    assert {(r.doc_id, r.n) for r in rows.collect()} == {("a", 1), ("b", 2), ("ሀ", 3)}
    out = str(tmp_path / "out")
    files.write_artefacts(rows, out)
    files.write_artefacts(rows.where("doc_id = 'a'").withColumn("n", F.lit(9)), out)
    assert {(r.doc_id, r.n) for r in spark.read.json(out).collect()} == {("a", 9), ("b", 2), ("ሀ", 3)}
    files.append_lines(rows, str(tmp_path / "lines"))
    files.append_lines(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 6


def test_cache_states(spark):
    asked = spark.createDataFrame([(d,) for d in ("hit", "miss", "bad", "other", "both")], "doc_id string")
    stored = spark.createDataFrame([("hit", '{"doc_id": "hit"}'), ("bad", "[1"), ("other", '{"doc_id": "x"}'), ("both", None), ("both", '{"doc_id": "both"}'), (None, "{}")], "doc_id string, payload string")
    got = {r.doc_id: (r.cache_hit, r.cache_reason) for r in route.cache_states(asked, stored).collect()}
    assert got == {"hit": (True, "cache_hit"), "miss": (False, "cache_miss"), "bad": (False, "invalid_cache"), "other": (False, "doc_id_mismatch"), "both": (True, "cache_hit")}


def test_ledger_goes_on_where_it_ended(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("source", "table", "state"))
    schema = "event_id bigint, event_ts timestamp_ntz, strategy_used string, escalated boolean"
    row = lambda i, day: f"select cast({i} as bigint) event_id, timestamp_ntz'2024-01-{day:02d} 00:00:00' event_ts, 'A' strategy_used, false escalated"
    spark.sql(row(1, 3)).unionByName(spark.sql(row(1, 3))).unionByName(spark.createDataFrame([(None, None, "A", False)], schema)).write.parquet(source)
    ledger.appended(ledger.ledger_stream(spark, source), table, state)
    assert spark.read.parquet(table).count() == 1
    spark.sql(row(1, 3)).unionByName(spark.sql(row(2, 1))).write.mode("append").parquet(source)
    ledger.appended(ledger.ledger_stream(spark, source), table, state)
    assert {r.event_id for r in spark.read.parquet(table).collect()} == {1, 2} and spark.read.parquet(table).count() == 2
    late = "select cast(3 as bigint) event_id, timestamp_ntz'2022-05-01 00:00:00' event_ts, 'B' strategy_used, true escalated"
    spark.sql(late).unionByName(spark.sql(late)).unionByName(spark.sql(row(2, 1))).write.mode("append").parquet(source)
    ledger.appended(ledger.ledger_stream(spark, source), table, state)
    assert sorted(r.event_id for r in spark.read.parquet(table).collect()) == [1, 2, 3]


def test_ledger_events(spark):
    rows = spark.createDataFrame([("d", "A", 0.9, "A"), ("e", "C", 0.5, "A>B>C1")], "doc_id string, strategy string, confidence double, trace string")
    assert [(r.strategy_used, r.escalated) for r in route.ledger_events(rows).collect()] == [("A", False), ("C", True)]


def test_layout_signals(spark):
    schema = "doc_id string, page int, width double, height double, images array<struct<x0:double,y0:double,x1:double,y1:double>>, n_lines int, n_rects int, lefts array<double>"
    pages = spark.createDataFrame([("d", 1, 10.0, 10.0, [(0.0, 0.0, 20.0, 20.0)], 300, 1, [1.0, 50.0]), ("d", 2, 10.0, 10.0, None, 0, None, None), ("d", 9, 1.0, 1.0, None, 999, 0, None)], schema)
    r = replies.layout_signals(pages).first()
    assert (r.approx_column_count, r.tableish_score, r.figureish_score) == (2, 0.5, 0.5)


def test_extraction_scores(spark):
    good = "The audit report states total revenue of 4.2 million and profit of 1.1 million for the year. Management reviewed the tax statements. The independent auditor found no material misstatement in the annual accounts of the bank."
    bad = "unknown unreadable ### ###\nunclear"
    rows = spark.createDataFrame([(1, ""), (2, good), (3, bad), (4, None)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", extract.extraction_score(F.col("t")).alias("s")).collect()}
    assert got[1] == got[4] == 0.0 and got[2] >= 0.55 and got[3] < 0.35


def test_sinks_of_facts_texts_and_default_questions(spark):
    schema = "ldu_id string, ingested_at timestamp_ntz, doc_id string, chunk_type string, content string, content_hash string, page_refs array<int>, provenance struct<source_path:string>"
    now = __import__("datetime").datetime(2024, 1, 1)
    rows = [("a", now, "d", "text", "Total tax: 5 million. " * 500, "ha", [1, 2], ("x/d.pdf",)), ("b", now, "d", "text", " ", "hb", None, None), ("c", now, "d", "text", "old", "hc", [], None)]
    units = spark.createDataFrame(rows + rows[:1], schema)
    stored = search.stored_texts(units, spark.createDataFrame([("c",)], "ldu_id string")).collect()
    assert [(r.ldu_id, len(r.text), r.page_refs) for r in stored] == [("a", 8000, "[1,2]")]
    made = facts.fact_rows(facts.extracted(units.where("ldu_id = 'a'").limit(1)), units, first_id=7).collect()
    assert len(made) == 500 and len({r.id for r in made}) == 500 and {(r.doc_id, r.field_name, r.source_path, r.content_hash) for r in made} == {("d", "Total tax", "x/d.pdf", "ha")}
    asked = agent.default_questions(spark.createDataFrame([(1, "d", "p"), (1, "d", "p"), (2, None, "p")], "index_id bigint, doc_id string, payload string")).collect()
    assert [(r.index_id, r.question_no) for r in sorted(asked, key=lambda r: r.question_no)] == [(1, 1), (1, 2), (1, 3)]
