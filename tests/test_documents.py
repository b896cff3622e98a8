"""Document operators: rules on small documents, brute force for folds, SQL twins on the smallest tables."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunk, extract, page_index, route, search, triage

UNIT = "ldu_id string, doc_id string, pos int, chunk_type string, content string, parent_section string, page_refs array<int>, content_hash string, provenance struct<spans:array<struct<page:int,bbox:array<double>>>,cross_refs:array<string>>, ingested_at timestamp"


def units(spark, rows, doc="d"):
    now = datetime.datetime(2024, 1, 1)
    made = [(f"{doc}-{i}", doc, i, kind, content, section, [1], f"h{i}", ([], None), now) for i, (kind, content, section) in enumerate((*r, None)[:3] for r in rows)]
    return spark.createDataFrame(made, UNIT)


def chunks(spark, rows):
    return [r.asDict() for r in chunk.chunked(units(spark, rows)).orderBy("seq", "part").collect()]


def test_table_stands_alone(spark):
    out = chunks(spark, [("text", "Some introductory text."), ("table", "Col A | Col B\nVal 1 | Val 2"), ("text", "Text after the table.")])
    assert [r["chunk_type"] for r in out] == ["text", "table", "text"]


def test_figure_takes_its_caption(spark):
    out = chunks(spark, [("figure", "Figure 1"), ("text", "Figure 1: Annual revenue growth trend."), ("text", "Following paragraph.")])
    assert [r["content"] for r in out] == ["Figure 1\n[Caption]: Figure 1: Annual revenue growth trend.", "Following paragraph."]


def test_a_run_of_figures_takes_every_second(spark):
    out = chunks(spark, [("figure", "Figure 1"), ("figure", "Figure 2"), ("figure", "Figure 3"), ("text", "end")])
    assert [r["content"] for r in out] == ["Figure 1\n[Caption]: Figure 2", "Figure 3", "end"]


def test_short_list_whole_long_list_split(spark):
    long = "\n".join("• " + "x" * 70 for _ in range(25))
    out = chunks(spark, [("list", "• a\n• b"), ("list", long)])
    assert out[0]["content"] == "• a\n• b" and len(out) > 2
    assert all(len(r["content"]) <= 1200 for r in out) and "\n".join(r["content"] for r in out[1:]) == long


def test_headers_name_sections(spark):
    out = chunks(spark, [("text", "before"), ("header", "3. Financial Overview"), ("text", "a"), ("header", "2. Methodology"), ("text", "b"), ("text", None)])
    assert [(r["chunk_type"], r["parent_section"]) for r in out] == [("text", None), ("header", "3. Financial Overview"), ("text", "3. Financial Overview"), ("header", "2. Methodology"), ("text", "2. Methodology")]


def test_references_are_kept(spark):
    assert chunks(spark, [("text", "As shown in Table 3, revenue grew significantly. See Figure 2.")])[0]["cross_refs"] == "As shown in T; See F"


def greedy(sizes, most):
    groups, total = [], 0
    for n in sizes:
        if groups and total + n <= most:
            groups[-1].append(n)
            total += n
        else:
            groups.append([n])
            total = n
    return groups


def test_merging_against_a_plain_loop(spark):
    rnd = random.Random(3)
    sizes = [rnd.choice([10, 200, 500, 700, 1300]) for _ in range(400)]
    out = chunks(spark, [("text", "y" * n) for n in sizes])
    assert [r["n_units"] for r in out] == [len(g) for g in greedy(sizes, 1200)]


def test_long_runs_against_a_plain_loop(spark):
    rnd = random.Random(5)
    docs = {d: [rnd.choice(kinds) for _ in range(n)] for d, n, kinds in (("a", 1500, [0, 10, 200, 700, 1300]), ("b", 1300, [0]), ("c", 2100, [0, 0, 0, 1]), ("e", 513, [5, 1199]))}
    rows = None
    for d, sizes in docs.items():
        made = units(spark, [("text", "y" * n) for n in sizes], d)
        rows = made if rows is None else rows.unionByName(made)
    got = {}
    for r in chunk.chunked(rows.unionByName(rows.where("pos % 7 = 0"))).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.n_units)
    assert got == {d: [len(g) for g in greedy(sizes, 1200)] for d, sizes in docs.items()}


def test_units_without_position_or_type(spark):
    rows = units(spark, [("text", "a"), (None, "b"), ("header", "1. Head"), ("text", None)])
    rows = rows.withColumn("pos", F.when(F.col("ldu_id") != "d-0", F.col("pos")))
    out = chunk.chunked(rows).orderBy("seq").collect()
    assert [(r.chunk_type, r.content, r.n_units) for r in out] == [("text", "a\n\nb", 2), ("header", "1. Head", 1), ("text", "", 1)]
    assert chunk.chunked(rows.limit(0)).count() == 0


def test_violations(spark):
    rows = units(spark, [("header", "5. Budget Analysis"), ("text", "plain", "WRONG SECTION"), ("table", " ", "5. Budget Analysis"), ("text", "see Table 1", "5. Budget Analysis")])
    assert {(r.ldu_id, r.rule) for r in chunk.violations(rows).collect()} == {("d-1", "R4"), ("d-2", "R1"), ("d-3", "R5")}


def test_positions_over_many_buckets(spark):
    rows = [("header", f"{i}. H")if i % 700 == 0 else ("list", "x") for i in range(1500)]
    seq = chunk.sequenced(units(spark, rows))
    out = chunk.carried(seq, {"section": F.when(F.col("chunk_type") == "header", F.col("content"))}).orderBy("pos").collect()
    assert [r.seq for r in out] == list(range(1, 1501))
    assert [r.section for r in out] == [f"{i // 700 * 700}. H" for i in range(1500)]


def test_section_tree(spark):
    rows = units(spark, [("text", "lost"), ("header", "OVERVIEW"), ("text", "a"), ("header", "Part two"), ("table", "b"), ("header", "1. Next"), ("header", "ANNEX")])
    got = [(r.title, r.level, r.parent_seq, r.n_units) for r in page_index.sections(rows).orderBy("seq").collect()]
    assert got == [("OVERVIEW", 1, None, 2), ("Part two", 2, 2, 2), ("1. Next", 2, 2, 1), ("ANNEX", 1, None, 1)]


def test_triage(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0007, 2616.5), (0.55, 300.0), (0.9, 301.0)], "image double, chars double")
    assert [r[0] for r in rows.select(triage.origin_type(F.col("image"), F.col("chars"))).collect()] == ["scanned_image", "native_digital", "scanned_image", "native_digital"]
    layout = spark.createDataFrame([(0.1, 0.9, 1), (0.12, 0.05, 2), (0.6, 0.9, 3), (0.0, 0.0, 1)], "t double, f double, c int")
    assert [r[0] for r in layout.select(triage.layout_complexity(F.col("t"), F.col("f"), F.col("c"))).collect()] == ["figure_heavy", "multi_column", "table_heavy", "single_column"]


def test_profiles_from_signals(spark):
    signals = spark.createDataFrame([("a", 3, 0.0, 1.0), ("b", 155, 2616.5, 0.0007), ("report_e.c-2011", 2, 0.0, 0.9), ("tax", 1, 500.0, None)], "doc_id string, page_count int, avg_text_chars_per_page double, avg_image_area_ratio double")
    layout = spark.createDataFrame([("a", 1, 0.1, 0.9), ("b", 2, 0.12, 0.05)], "doc_id string, approx_column_count int, tableish_score double, figureish_score double")
    pages = spark.createDataFrame([("b", 2, "and the income statement"), ("b", 1, " Balance sheet "), ("b", 3, "court"), ("a", 1, None)], "doc_id string, page int, text string")
    got = {r.doc_id: (r.origin_type, r.layout_complexity, r.language, r.language_confidence, r.domain_hint, r.page_count, r.cost_tier) for r in triage.profiled(signals, layout, triage.text_samples(pages)).collect()}
    assert got == {
        "a": ("scanned_image", "figure_heavy", "en", 0.4, None, 3, "needs_vision_model"),
        "b": ("native_digital", "multi_column", "en", 0.4, "financial", 155, "needs_layout_model"),
        "report_e.c-2011": ("scanned_image", "single_column", "am", 0.85, "technical", 2, "needs_vision_model"),
        "tax": ("native_digital", "single_column", None, 0.0, "financial", 1, "fast_text_sufficient"),
    }


def test_markdown_language_and_flags(spark):
    rows = spark.createDataFrame([(1, None), (2, "ሪፖርቱ ቀረበ ዛሬ"), (3, "A plain report of the year in English."), (4, "ሪፖርቱ ቀረበ and a long English remark here"), (5, "※ ① ② ∞ - - - - - - - -"), (6, "дддддддддддд")], "k int, t string")
    got = {r.k: (r.language, r.script, r.confidence, r.flags) for r in triage.markdown_quality(rows, "k", "t").collect()}
    assert got == {
        1: (None, None, 0.0, "empty extracted markdown"), 2: ("am", "ethiopic", 0.9, ""), 3: ("en", "latin", 0.75, ""), 4: ("mixed", "mixed", 0.85, ""),
        5: (None, None, 0.1, "contains unusual OCR symbols; low alphanumeric ratio"), 6: (None, None, 0.1, "non-ascii text without clear script signal"),
    }


@pytest.mark.parametrize("a,b,origin,lang,step,trace", [(0.95, 0.8, None, None, "A", "A"), (0.3, 0.82, None, None, "B", "A>B"), (0.3, 0.5, None, None, "C1", "A>B>C1"), (0.95, 0.9, "scanned_image", "am", "C3", "A+B-skipped>C3"), (0.95, 0.9, "scanned_image", "en", "B", "A-skipped>B")])
def test_routes(spark, a, b, origin, lang, step, trace):
    rows = spark.createDataFrame([("d", a, b, 0.7, 0.1, 0.5, origin, lang)], "doc_id string, conf_a double, conf_b double, conf_c1 double, conf_c2 double, conf_c3 double, origin_type string, language string")
    r = route.routed(rows).first()
    assert (r.step, r.trace, r.escalated) == (step, trace, step != "A")


def test_text_functions(spark):
    rows = spark.createDataFrame([(1, "1. X"), (2, "1.1 Xyz"), (3, "ALL CAPS LINE"), (4, "Title line"), (5, "ends."), (6, ""), (7, None)], "i int, t string")
    got = {r.i: r.level for r in rows.select("i", T.heading_level(F.col("t")).alias("level")).collect()}
    assert got == {1: 2, 2: None, 3: 1, 4: 2, 5: None, 6: None, 7: None}
    r = spark.range(1).select(T.shortened(F.lit("a" * 200)).alias("s"), T.word_count(F.lit(" a  b　c ")).alias("w"), T.word_count(F.lit(None).cast("string")).alias("z"), T.summary(F.lit("Short. This sentence is long enough. No.")).alias("u")).first()
    assert r.s == "a" * 179 + "…" and (r.w, r.z) == (3, 0) and r.u == "This sentence is long enough."


def test_blocks(spark):
    rows = spark.createDataFrame([(1, "1. Introduction Text\nTable 3 shows\nab\n plain words "), (2, None), (3, "")], "k int, t string")
    assert [(r.k, r.block_type) for r in extract.line_blocks(rows, "k", "t").orderBy("k", "line_no").collect()] == [(1, "header"), (1, "figure"), (1, "text")]
    md = spark.createDataFrame([(1, "# A\ntext\n\nmore\n## B\n" + "z" * 2500)], "k int, t string")
    assert [len(r.chunk) for r in extract.markdown_chunks(md, "k", "t").orderBy("chunk_no").collect()] == [8, 4, 1200, 1200, 105]


def test_keyword_search_counts_inside_words(spark):
    docs = units(spark, [("text", "tax taxes Tax"), ("text", "income tax"), ("text", "none"), ("text", None)])
    asked = spark.createDataFrame([("income tax",), ("zzz",)], "question string")
    assert [(r.ldu_id, r.score) for r in search.keyword_top(docs, asked).orderBy("rank").collect()] == [("d-0", 1.5), ("d-1", 1.0)]


def test_vector_search_is_exact(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(900, None), (901, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in search.vector_top(df, df.where("vec_id % 20 = 0"), most=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    vecs = {i: v for i, v in rows if v}
    for q in range(0, 300, 20):
        assert got[q] == sorted((i for i in vecs if i != q), key=lambda i: -cos(vecs[q], vecs[i]))[:3]


def test_equal_vectors_rank_by_id(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [0.6, 0.8]) for i in range(40, 0, -1)] + [(50, [1.0, 0.01]), (50, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [r.vec_id for r in search.vector_top(df, df.where("vec_id = 0"), most=10).orderBy("rank").collect()]
    assert got == [50, *range(1, 10)]


def test_section_sorted_by_first_type(spark):
    rows = units(spark, [("header", "1. A"), ("text", "x"), ("list", "y"), ("figure", "z"), ("text", "w")])
    assert page_index.sections(rows).first().data_types == "text,list,figure"


def test_every_core_query_equals_its_sql(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from quire.plans import document_queries, pipeline_queries

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    say = lambda v: "-" if pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)
    made = document_queries.QUERIES | pipeline_queries.QUERIES
    for name, sql in (document_queries.SQL | pipeline_queries.SQL).items():
        a, b = made[name](spark, folder).toPandas(), con.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns), name
        rows = lambda df: sorted(tuple(say(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())
        assert rows(a) == rows(b), name
