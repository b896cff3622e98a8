"""Blocks from the JSON that a vision model returns for a page, and signals of pages, as tables of such inputs give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import stripped

REPLY = (
    "doc_type string, language string, full_text string, sections array<struct<heading:string,body:string>>, "
    "tables array<struct<caption:string,rows:array<array<string>>>>, key_fields array<struct<name:string,value:string>>"
)


def reply_json(raw: Column) -> Column:
    """The JSON object in a reply: without a code fence, else from the first to the last brace; null where neither parses."""
    bare = stripped(F.coalesce(raw, F.lit("")))
    fenced = F.regexp_extract(bare, r"(?is)^```(?:json)?\s*\n(.*)\n\s*```$", 1)
    text = F.when(fenced != "", stripped(fenced)).otherwise(bare)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    is_object = lambda t: F.try_parse_json(t).isNotNull() & t.startswith("{")
    return F.when(is_object(text), text).when(is_object(inner), inner)


# Words that name a language in a reply, in the order in which they are looked for.
REPLY_WORDS = [("am", ["amharic", "ethiopic", "ge'ez", "geez", "አምሃርኛ"]), ("am", ["tigrinya", "tigri"]), ("mixed", ["mixed"]), ("en", ["english", "latin script"])]
REPLY_CODES = {"am": "am", "amharic": "am", "ethiopic": "am", "en": "en", "english": "en", "mixed": "mixed"}


def reply_language(raw: Column) -> Column:
    """The language code that a model's reply names, in JSON, in prose or as a bare code; null for none and for 'other'."""
    bare = stripped(F.coalesce(raw, F.lit("")))
    clean = stripped(F.regexp_replace(F.regexp_replace(bare, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    some = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    whole = F.when(clean.startswith("{") & F.try_parse_json(clean).isNotNull(), some(F.get_json_object(clean, "$.language")))
    part = some(F.regexp_extract(bare, r'(?i)\{[^}]*"language"\s*:\s*"([^"]+)"[^}]*\}', 1))
    low = F.lower(bare)
    named = None
    for code, words in REPLY_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        if code == "mixed":  # the word alone may mean other things
            hit = hit & (low.contains("amharic") | low.contains("english") | low.contains("ethiopic"))
        named = F.when(hit, code) if named is None else named.when(hit, code)
    named = named.when(bare.rlike("[\\u1200-\\u137F]"), "am")
    codes = F.create_map(*[F.lit(x) for pair in REPLY_CODES.items() for x in pair])
    lines = F.transform(F.split(low, r"\r\n|[\n\r]"), lambda x: codes[F.btrim(stripped(x), F.lit(".,;:"))])
    return F.nullif(F.coalesce(whole, part, named, F.get(F.array_compact(lines), F.lit(0))), F.lit("other"))


def reply_blocks(replies: DataFrame) -> DataFrame:
    """(doc_id, page, pos, block_type, text) of replies (doc_id, page, raw); one that is no JSON is one text block."""
    r = replies.select("doc_id", "page", stripped(F.coalesce("raw", F.lit(""))).alias("raw"), F.from_json(reply_json(F.col("raw")), REPLY).alias("j"))
    block = lambda kind, text: F.struct(F.lit(kind).alias("block_type"), stripped(F.coalesce(text, F.lit(""))).alias("text"))
    full = F.coalesce("j.full_text", F.lit(""))
    parts = F.transform(F.coalesce("j.sections", F.array()), lambda s: F.array(block("section_header", s["heading"]), F.when(~s["body"].eqNullSafe(full), block("text", s["body"]))))
    row = lambda cells: F.array_join(F.transform(cells, lambda c: stripped(F.coalesce(c, F.lit("")))), " | ")
    tables = F.transform(F.coalesce("j.tables", F.array()), lambda t: block("table", F.concat_ws("\n", F.when(t["caption"] != "", t["caption"]), F.array_join(F.transform(F.coalesce(t["rows"], F.array()), row), "\n"))))
    pair = lambda k: F.regexp_replace(F.concat_ws(": ", F.coalesce(k["name"], F.lit("")), F.coalesce(k["value"], F.lit(""))), r"^[: ]+|[: ]+$", "")
    fields = F.array(block("table", F.array_join(F.transform(F.coalesce("j.key_fields", F.array()), pair), "\n")))
    whole = F.concat(F.array(block("section_header", F.col("j.doc_type")), block("text", full)), F.flatten(parts), tables, fields)
    blocks = F.when(F.col("j").isNull(), F.array(block("text", F.col("raw")))).otherwise(whole)
    kept = F.filter(blocks, lambda b: b.isNotNull() & (b["text"] != ""))
    return r.select("doc_id", "page", F.posexplode(kept).alias("pos", "b")).select("doc_id", "page", "pos", "b.*")


def page_signals(pages: DataFrame, sampled: int = 10) -> DataFrame:
    """(doc_id, page_count, avg_text_chars_per_page, avg_image_area_ratio) from pages (doc_id, page, width, height, text, images).

    Averages run over the first `sampled` pages; a page without area has an image share of 0.
    """
    area = F.aggregate(F.coalesce("images", F.array()), F.lit(0.0), lambda a, i: a + F.abs(i["x1"] - i["x0"]) * F.abs(i["y1"] - i["y0"]))
    size = F.col("width") * F.col("height")
    share = F.when(size > 0, area / size).otherwise(0.0)
    early = F.col("page") <= sampled
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.coalesce(F.avg(F.when(early, F.length(stripped(F.coalesce("text", F.lit("")))))), F.lit(0.0)).alias("avg_text_chars_per_page"),
        F.coalesce(F.avg(F.when(early, share)), F.lit(0.0)).alias("avg_image_area_ratio"),
    )


def layout_signals(pages: DataFrame, sampled: int = 3) -> DataFrame:
    """(doc_id, approx_column_count, tableish_score, figureish_score) from pages with images, n_lines, n_rects and lefts of words.

    Over the first `sampled` pages: the mean column count, rounded half to even; the mean density of lines and
    rectangles, full at 200; the mean share of images, at most 1 a page.
    """
    area = F.aggregate(F.coalesce("images", F.array()), F.lit(0.0), lambda a, i: a + F.abs(i["x1"] - i["x0"]) * F.abs(i["y1"] - i["y0"]))
    size = F.col("width") * F.col("height")
    share = F.when(size > 0, F.least(F.lit(1.0), area / size)).otherwise(0.0)
    ruled = F.least(F.lit(1.0), (F.coalesce("n_lines", F.lit(0)) + F.coalesce("n_rects", F.lit(0))) / 200)
    return pages.where(F.col("page") <= sampled).groupBy("doc_id").agg(
        F.bround(F.avg(column_count(F.coalesce("lefts", F.array().cast("array<double>"))))).cast("int").alias("approx_column_count"),
        F.avg(ruled).alias("tableish_score"), F.avg(share).alias("figureish_score"),
    )


def column_count(lefts: Column, gap: float = 35.0) -> Column:
    """Columns of a page from its words' left edges: a new one starts more than `gap` right of the last one's start; 1 to 4."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["at"].isNull() | (x - acc["at"] > gap)
        return F.struct(F.when(new, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(new, x).otherwise(acc["at"]).alias("at"))

    return F.greatest(F.lit(1), F.least(F.lit(4), F.aggregate(F.array_sort(F.filter(lefts, lambda x: x.isNotNull())), start, step, lambda acc: acc["n"])))
