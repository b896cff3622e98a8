"""Typed blocks from page text by each extraction strategy, and the strategies' confidence in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import CAPTION, HEADING, TITLE, UNCERTAIN, is_upper, occurrences, stripped

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def line_type(line: Column) -> Column:
    """header, figure or text, of one line of a page."""
    return F.when(line.rlike(HEADING) & (F.length(line) < 90), "header").when(line.rlike(CAPTION), "figure").otherwise("text")


def lines_of(text: Column) -> Column:
    """The lines of a page as an array, without white space around them; blank and short ones among them."""
    return F.transform(F.split(stripped(text), LINE_END), stripped)


def line_blocks(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, block_type, line) of each line of at least three characters; null pages have none."""
    rows = pages.where(F.col(text).isNotNull()).select(key, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))
    return rows.where("length(line) >= 3").select(key, "line_no", line_type(F.col("line")).alias("block_type"), "line")


def paragraph_type(t: Column) -> Column:
    """header, table or text, of one paragraph without white space around it."""
    numeric = F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\d")))
    heading = (F.length(t) < 120) & (is_upper(t) | t.endswith(":") | t.rlike(TITLE))
    return F.when(t == "", "text").when(heading, "header").when(t.contains(":") | (numeric >= 3), "table").otherwise("text")


def paragraphs_of(text: Column) -> Column:
    """The texts between blank lines as an array."""
    return F.filter(F.transform(F.split(stripped(text), r"\n\s*\n"), stripped), lambda p: p != "")


def paragraph_blocks(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph_no, block_type, n_chars) of the paragraphs between blank lines."""
    parts = paragraphs_of(F.col(text))
    rows = pages.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("paragraph_no", "paragraph"))
    return rows.select(key, "paragraph_no", paragraph_type(F.col("paragraph")).alias("block_type"), F.length("paragraph").alias("n_chars"))


def chunks_of(text: Column, size: int = 1200) -> Column:
    """The chunks of markdown as an array: cut at headings, then at blank lines, then into slices of at most size."""
    sections = F.split(stripped(text), r"\n(?=\s{0,3}#{1,6}\s+\S)")
    parts = F.flatten(F.transform(sections, lambda s: F.split(stripped(s), r"\n\s*\n")))
    parts = F.filter(F.transform(parts, stripped), lambda p: p != "")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size)), lambda i: stripped(F.substring(p, (i * size + 1).cast("int"), F.lit(size))))
    slices = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(cut(p))))
    return F.filter(slices, lambda c: c != "")


def markdown_chunks(docs: DataFrame, key: str, text: str, size: int = 1200) -> DataFrame:
    """(key, chunk_no, chunk) of each text's chunks; null texts have none."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(chunks_of(F.col(text), size)).alias("chunk_no", "chunk"))


def word_box(words: Column) -> Column:
    """[x0, top, x1, bottom] around a page's words; null where it has none."""
    side = lambda least, name: least(F.transform(words, lambda w: w[name]))
    return F.when(F.size(words) > 0, F.array(side(F.array_min, "x0"), side(F.array_min, "top"), side(F.array_max, "x1"), side(F.array_max, "bottom")))


def table_text(rows: Column) -> Column:
    """A table's rows as lines of cells between bars; null for one without a first row or of fewer than five characters."""
    line = lambda row: F.array_join(F.transform(F.coalesce(row, F.array()), lambda c: stripped(F.coalesce(c, F.lit("")))), " | ")
    text = stripped(F.array_join(F.transform(rows, line), "\n"))
    return F.when((F.size(F.get(rows, F.lit(0))) > 0) & (F.length(text) >= 5), text)


def page_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page, pos, block_type, text, bbox) of pages (doc_id, page, text, words, tables): tables first, then typed lines.

    Every block has the box around all words of its page. Null texts, words and tables count as none.
    """
    block = lambda kind, text: F.struct(kind.alias("block_type"), text.alias("text"))
    tables = F.filter(F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), table_text), lambda t: t.isNotNull())
    lines = F.filter(lines_of(F.coalesce("text", F.lit(""))), lambda x: F.length(x) >= 3)
    blocks = F.concat(F.transform(tables, lambda t: block(F.lit("table"), t)), F.transform(lines, lambda x: block(line_type(x), x)))
    rows = pages.select("doc_id", "page", word_box(F.col("words")).alias("bbox"), F.posexplode(blocks).alias("pos", "b"))
    return rows.select("doc_id", "page", "pos", "b.block_type", "b.text", "bbox")


def layer_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page, block_type, text) of pages (doc_id, page, text): the text layer of each page that is not blank as one block."""
    rows = pages.select("doc_id", "page", F.lit("text").alias("block_type"), stripped(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.where("text <> ''")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, block_type, text, spans) of docs (doc_id, page_count, markdown): chunks that may stand on any page of the document."""
    pages = F.transform(F.sequence(F.lit(1), F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1))), lambda p: F.struct(p.alias("page"), F.lit(None).cast("array<double>").alias("bbox")))
    rows = docs.where("markdown is not null").select("doc_id", pages.alias("spans"), F.posexplode(chunks_of(F.col("markdown"))).alias("pos", "text"))
    return rows.select("doc_id", "pos", F.lit("text").alias("block_type"), "text", "spans")


def _as_blocks(step: Column, text: Column) -> Column:
    """The blocks (block_type, text) that a step makes of a text layer; C3, which reads replies, makes none of it."""
    t = stripped(F.coalesce(text, F.lit("")))
    typed = lambda parts, kind: F.transform(parts, lambda x: F.struct(kind(x).alias("block_type"), x.alias("text")))
    plain = lambda x: F.lit("text")
    return (
        F.when(step == "A", typed(F.filter(lines_of(t), lambda x: F.length(x) >= 3), line_type)).when(step == "B", typed(chunks_of(t), plain))
        .when((step == "C1") & (t != ""), typed(F.array(t), plain)).when(step == "C2", typed(paragraphs_of(t), paragraph_type))
    )


def routed_blocks(routes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, step, pos, block_type, text) of routed texts: the blocks of the step that each is extracted by, in one pass and without a shuffle."""
    rows = routes.select(key, "step", F.posexplode(_as_blocks(F.col("step"), F.col(text))).alias("pos", "b"))
    return rows.select(key, "step", "pos", "b.block_type", "b.text")


# What a document costs by each strategy, in dollars.
COSTS = {"A": 0.001, "B": 0.010, "C": 0.0}


def run_results(routes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, strategy_used, confidence, escalated, cost_estimate_usd, n_blocks, error, notes): a row for each text, failed ones included.

    A text without blocks has confidence 0 and an error: that it is blank, or that no reply was given for it.
    """
    n = F.coalesce(F.size(_as_blocks(F.col("step"), F.col(text))), F.lit(0))
    error = F.when(stripped(F.coalesce(F.col(text), F.lit(""))) == "", "no text").when(F.col("step") == "C3", "no reply of a vision model").when(n <= 0, "no blocks")
    cost = F.create_map(*[F.lit(x) for pair in COSTS.items() for x in pair])[F.col("strategy")]
    rows = routes.select("*", F.greatest(n, F.lit(0)).alias("n_blocks"), error.alias("error"))
    return rows.select(
        key, F.col("strategy").alias("strategy_used"), F.when(F.col("error").isNull(), F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.col("strategy").isin("B", "C").alias("escalated"), cost.alias("cost_estimate_usd"), "n_blocks", "error", F.col("trace").alias("notes"),
    )


def _steps(value: Column, steps: list[tuple[int, float]], least: float) -> Column:
    ladder = None
    for floor, score in steps:
        ladder = F.when(value >= floor, score) if ladder is None else ladder.when(value >= floor, score)
    return ladder.otherwise(least)


def confidences(chars: Column, chunks: Column, tables: Column, headers: Column) -> list[Column]:
    """Each strategy's confidence from the characters, chunks, tables and headers that it found."""
    a = F.when(chars < 30, 0.25).otherwise(F.least(F.lit(0.95), 0.6 + chars / 2000))
    b = (
        F.when((chars >= 5000) & (chunks >= 15), 0.9).when((chars >= 2000) & (chunks >= 8), 0.85)
        .when((chars >= 800) & (chunks >= 4), 0.78).otherwise(_steps(chars, [(300, 0.65), (80, 0.45)], 0.25))
    )
    c1 = _steps(chars, [(3000, 0.82), (1200, 0.72), (400, 0.6), (150, 0.45), (60, 0.3)], 0.1)
    points = lambda test, n: F.when(test, n).otherwise(0)
    c2 = F.least(F.lit(85), 15 + points(chars >= 300, 20) + points(chars >= 1000, 20) + points(chars >= 2500, 15) + points(tables > 0, 10) + points(headers > 0, 10)) / 100
    c3 = _steps(chars, [(3000, 0.88), (1200, 0.8), (400, 0.7), (150, 0.55), (60, 0.35)], 0.2)
    return [a.alias("conf_a"), b.alias("conf_b"), c1.alias("conf_c1"), c2.alias("conf_c2"), c3.alias("conf_c3")]


def candidates(docs: DataFrame, key: str, text: str, keep: tuple[str | Column, ...] = ()) -> DataFrame:
    """(key, kept columns, n_chars, conf_a .. conf_c3) of each document: what every strategy would claim for its text."""
    parts = paragraphs_of(F.coalesce(F.col(text), F.lit("")))
    kinds = docs.select(key, *keep, F.length(stripped(F.coalesce(F.col(text), F.lit("")))).alias("n_chars"), F.transform(parts, paragraph_type).alias("kinds"))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind))
    kept = [c for c in kinds.columns if c not in (key, "n_chars", "kinds")]
    return kinds.select(key, *kept, "n_chars", *confidences(F.col("n_chars"), F.size("kinds"), count("table"), count("header")))


def quality(text: Column, strategy: Column) -> Column:
    """struct(qa_score, needs_review, reasons): penalties for little text and for many words of doubt, in hundredths; a blank text, which has no blocks, scores 0."""
    t = stripped(F.coalesce(text, F.lit("")))
    n = F.length(t)
    lost = lambda test, points: F.when(test, points).otherwise(0)
    tests = {
        "very short extracted text": (n < 200, 35), "almost empty extracted text": (n < 50, 35), "many uncertainty markers": (occurrences(F.lower(t), UNCERTAIN) >= 5, 20),
        "vision output too small": (F.coalesce(strategy == "C", F.lit(False)) & (n < 120), 20),
    }
    score = F.lit(100)
    for test, points in tests.values():
        score = score - lost(test, points)
    score = F.when(t == "", 0).otherwise(F.greatest(score, F.lit(0)))
    reasons = F.when(t == "", F.array(F.lit("no blocks"))).otherwise(F.array_compact(F.array(*(F.when(test, why) for why, (test, _) in tests.items()))))
    return F.struct((score / 100).alias("qa_score"), (score < 65).alias("needs_review"), F.array_join(reasons, "; ").alias("reasons"))


# Signs that recognition leaves in markdown.
ODD_SIGNS = "∞①②③④⑤⑥⑦⑧⑨○●◉◌※"


def markdown_flags(n: Column, ethiopic: Column, latin: Column, plain: Column, odd: Column, alnum: Column) -> Column:
    """What speaks against extracted markdown, by its counts: nothing there, odd signs, few letters and digits, or no clear script."""
    flags = F.array(
        F.when(odd >= 3, "contains unusual OCR symbols"), F.when(alnum / n < 0.35, "low alphanumeric ratio"),
        F.when((n - plain >= 10) & (ethiopic < 3) & (latin < 10), "non-ascii text without clear script signal"),
    )
    return F.when(n <= 0, F.array(F.lit("empty extracted markdown"))).otherwise(F.array_compact(flags))


def extraction_score(text: Column) -> Column:
    """Quality of extracted text from 0 to 1: for length, letters, different words and figures of finance, less for doubt and junk."""
    t = stripped(F.coalesce(text, F.lit("")))
    low, n = F.lower(t), F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) / F.greatest(n, F.lit(1))
    words = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-/%().,:]*[\p{L}\p{N}_])?"), F.lit(0))))
    finance = t.rlike(r"\p{Nd}") & low.rlike(r"\b(total|amount|revenue|tax|profit|year)\b")
    doubt, junk = occurrences(low, r"\bunknown\b|\bunclear\b|\bunreadable\b|\bunsure\b"), occurrences(t, r"[#`]{3,}|\\u[0-9a-fA-F]{4}")
    points = lambda test, p: F.when(test, p).otherwise(0)
    good = 15 + points(n >= 100, 15) + points(n >= 400, 15) + points(n >= 1200, 15) + points(letters >= 0.35, 15) + points(letters >= 0.55, 10) + points(words >= 20, 10) + points(words >= 80, 10) + points(finance, 5)
    score = good - F.least(F.lit(20), doubt * 5) - F.least(F.lit(15), junk * 5)
    return F.when(t == "", 0.0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)) / 100)
