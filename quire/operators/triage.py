"""Profiles of documents: origin, layout and cost class from signals, language and domain from text or file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import stripped
from quire.operators.arrivals import first_arrivals
from quire.operators.extract import ODD_SIGNS, markdown_flags
from quire.operators.replies import reply_language

# Thresholds and keyword lists.
SCANNED_IMAGE_SHARE, SCANNED_TEXT_CHARS = 0.55, 300
DOMAIN_WORDS = {
    "financial": ["balance sheet", "income statement", "profit", "loss", "revenue", "fiscal", "tax"],
    "legal": ["hereby", "pursuant", "audit report", "independent auditor", "court", "proclamation"],
    "technical": ["methodology", "assessment", "implementation", "framework", "system", "analysis"],
    "medical": ["patient", "diagnosis", "clinical", "treatment", "hospital", "laboratory"],
}
NAME_DOMAINS = [
    ("financial", ["budget", "expense", "expenditure", "revenue", "tax", "fiscal", "finance", "financial"]),
    ("legal", ["audit", "auditor", "legal", "court", "proclamation"]),
    ("legal", ["procurement", "tender", "contract"]),
    ("technical", ["assessment", "survey", "report", "analysis"]),
]
AMHARIC_NAMES = ["e.c-", "e.c_", "_e.c", "-e.c", "amharic", "amh_", "_amh"]


def _any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def origin_type(image_share: Column, text_chars: Column) -> Column:
    scanned = (image_share >= SCANNED_IMAGE_SHARE) & (text_chars <= SCANNED_TEXT_CHARS)
    return F.when(scanned, "scanned_image").otherwise("native_digital")


def cost_tier(origin: Column, layout: Column) -> Column:
    return F.when(origin == "scanned_image", "needs_vision_model").when(layout == "single_column", "fast_text_sufficient").otherwise("needs_layout_model")


def layout_complexity(table_score: Column, figure_score: Column, columns: Column) -> Column:
    return F.when(table_score >= 0.5, "table_heavy").when(figure_score >= 0.45, "figure_heavy").when(columns >= 2, "multi_column").otherwise("single_column")


def script_counts(text: Column) -> Column:
    """struct(n, ethiopic, latin, plain): a text's characters, and its Ethiopic, Latin and ASCII ones; sums of parts tell the whole."""
    t = stripped(F.coalesce(text, F.lit("")))
    kept = lambda signs: F.length(F.regexp_replace(t, f"[^{signs}]+", ""))
    return F.struct(F.length(t).alias("n"), kept("\\u1200-\\u137F").alias("ethiopic"), kept("A-Za-z").alias("latin"), kept("\\x00-\\x7F").alias("plain"))


COUNTS = ("n", "ethiopic", "latin", "plain")


def counted(docs: DataFrame, key: str, text: str, **more: Column) -> DataFrame:
    """(key, n, ethiopic, latin, plain, more) of texts: as columns, so that rules that use a count often count once."""
    counts = script_counts(F.col(text))
    return docs.select(key, *(counts[c].alias(c) for c in COUNTS), *(c.alias(name) for name, c in more.items()))


def language_of(n: Column, ethiopic: Column, latin: Column, plain: Column) -> Column:
    """struct(language, language_confidence) by counts of characters."""
    verdict = lambda lang, conf: F.struct(F.lit(lang).cast("string").alias("language"), F.lit(conf).alias("language_confidence"))
    return (
        F.when(n <= 0, verdict(None, 0.0))
        .when((ethiopic >= 5) & (latin >= 20), verdict("mixed", 0.85))
        .when((ethiopic >= 5) & (ethiopic / n > 0.05), verdict("am", 0.9))
        .when(ethiopic >= 5, verdict("am", 0.8))
        .when((plain / n > 0.95) | (latin / n > 0.3), verdict("en", 0.4))
        .otherwise(verdict(None, 0.1))
    )


def script_language(text: Column) -> Column:
    """struct(language, language_confidence) by the counts of Ethiopic and Latin letters alone."""
    c = script_counts(text)
    return language_of(c["n"], c["ethiopic"], c["latin"], c["plain"])


def named_language(doc_id: Column) -> Column:
    """'am' where a scanned file's name speaks for Amharic, else 'en'."""
    return F.when(_any_of(F.lower(doc_id), AMHARIC_NAMES) | doc_id.rlike("[\\u1200-\\u137F]"), "am").otherwise("en")


def domain_of(text: Column) -> Column:
    """The domain with most of its keywords in the text, the first of equals; 'general' without any, null without text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hits = {d: sum((t.contains(w).cast("int") for w in words), F.lit(0)) for d, words in DOMAIN_WORDS.items()}
    most = F.greatest(*hits.values())
    found = F.when(t == "", F.lit(None)).when(most == 0, "general")
    for domain, n in hits.items():
        found = found.when(n == most, domain)
    return found


def domain_by_name(domain: Column, doc_id: Column) -> Column:
    """The domain, or where it is null or general the one that the file's name tells."""
    name = F.lower(doc_id)
    told = None
    for d, words in NAME_DOMAINS:
        told = F.when(_any_of(name, words), d) if told is None else told.when(_any_of(name, words), d)
    return F.when(domain.isNull() | (domain == "general"), F.coalesce(told, domain)).otherwise(domain)


def triaged(profiles: DataFrame) -> DataFrame:
    """Profiles with origin, cost class and domain told anew from their own signals; repeated rows count once."""
    origin = origin_type(F.col("avg_image_area_ratio"), F.col("avg_text_chars_per_page"))
    return profiles.where("profile_id is not null").dropDuplicates(["profile_id"]).select(
        "profile_id", "doc_id", origin.alias("origin_type"), cost_tier(origin, F.col("layout_complexity")).alias("cost_tier"),
        domain_by_name(F.col("domain_hint"), F.col("doc_id")).alias("domain_hint"),
    )


def text_samples(pages: DataFrame) -> DataFrame:
    """(doc_id, sample): the texts of the first two pages (doc_id, page, text) that are not blank, each after a line break."""
    early = pages.where("page <= 2").select("doc_id", "page", stripped(F.coalesce("text", F.lit(""))).alias("t")).where("t <> ''")
    parts = early.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: F.concat(F.lit("\n"), x["t"])), "").alias("sample"))


DOMAIN_BITS = {(d, w): 1 << i for i, (d, w) in enumerate((d, w) for d, words in DOMAIN_WORDS.items() for w in words)}


def domain_bits(text: Column) -> Column:
    """One bit for each domain word that a text contains; parts of a text are put together by bit_or."""
    t = F.lower(F.coalesce(text, F.lit("")))
    bits = F.lit(0).cast("bigint")
    for (_, w), bit in DOMAIN_BITS.items():
        bits = bits + F.when(t.contains(w), bit).otherwise(0)
    return bits


def domain_of_bits(bits: Column) -> Column:
    """As `domain_of`, from the words found; null bits stand for no text."""
    hits = {d: F.bit_count(bits.bitwiseAND(F.lit(sum(b for (own, _), b in DOMAIN_BITS.items() if own == d)))) for d in DOMAIN_WORDS}
    most = F.greatest(*hits.values())
    found = F.when(bits.isNull(), F.lit(None)).when(most == 0, "general")
    for domain, n in hits.items():
        found = found.when(n == most, domain)
    return found


def document_profiles(blocks: DataFrame, profiles: DataFrame, sampled: int = 10, read: int = 2) -> DataFrame:
    """The profile of each document of profiles, told anew from its blocks: pages, text, language, domain, origin and cost class.

    Texts are counted where they are read and only counts are shuffled, so that a document's size does not matter.
    Characters a page are a mean over the first `sampled` pages, language and domain those of the first `read`. Pages are those
    that blocks name, else those of the latest profile, which also gives the share of images and the layout, as
    blocks do not. Defined cases: repeated blocks count once; a block without a page adds no text; a scanned
    document whose text tells no language is told by its name; a document without blocks has no text.
    """
    text = stripped(F.coalesce("text", F.lit("")))
    page = F.get(F.filter(F.transform(F.coalesce("provenance.spans", F.array()), lambda s: s["page"]), lambda p: p > 0), F.lit(0))
    counted = blocks.where("doc_id is not null").select("block_id", "extracted_at", "doc_id", page.alias("page"), script_counts(text).alias("c"), domain_bits(text).alias("bits"))
    early = (F.col("page") <= read) & (F.col("c.n") > 0)
    sums = [F.sum(F.when(early, F.col(f"c.{k}"))).alias(k) for k in ("n", "ethiopic", "latin", "plain")]
    told = first_arrivals(counted, "block_id", "extracted_at").groupBy("doc_id").agg(
        F.max("page").alias("pages"), F.sum(F.when(F.col("page") <= sampled, F.col("c.n"))).alias("chars"),
        F.count_if(early).alias("parts"), *sums, F.bit_or(F.when(early, F.col("bits"))).alias("bits"),
    )
    last = profiles.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("page_count", "avg_image_area_ratio", "layout_complexity"), F.struct("profiled_at", "profile_id")).alias("p"))
    breaks = F.greatest(F.col("parts") - 1, F.lit(0))
    count = lambda k: F.coalesce(F.col(k), F.lit(0))
    rows = last.join(told, "doc_id", "left").withColumn("page_count", F.coalesce("pages", "p.page_count", F.lit(1)))
    rows = rows.withColumn("avg_text_chars_per_page", F.coalesce("chars", F.lit(0)) / F.greatest(F.least("page_count", F.lit(sampled)), F.lit(1)))
    rows = rows.withColumn("origin_type", origin_type(F.coalesce("p.avg_image_area_ratio", F.lit(0.0)), F.col("avg_text_chars_per_page")))
    rows = rows.withColumn("v", language_of(count("n") + F.coalesce(breaks, F.lit(0)), count("ethiopic"), count("latin"), count("plain") + F.coalesce(breaks, F.lit(0))))
    named = named_language(F.col("doc_id"))
    by_name = F.col("v.language").isNull() & (F.col("origin_type") == "scanned_image")
    layout = F.coalesce("p.layout_complexity", F.lit("single_column"))
    return rows.select(
        "doc_id", "origin_type", layout.alias("layout_complexity"), F.when(by_name, named).otherwise(F.col("v.language")).alias("language"),
        F.when(by_name, F.when(named == "am", 0.85).otherwise(0.4)).otherwise(F.col("v.language_confidence")).alias("language_confidence"),
        domain_by_name(domain_of_bits(F.col("bits")), F.col("doc_id")).alias("domain_hint"), "page_count", "avg_text_chars_per_page",
        cost_tier(F.col("origin_type"), layout).alias("cost_tier"),
    )


def profiled(signals: DataFrame, layout: DataFrame, samples: DataFrame, image_share: float = SCANNED_IMAGE_SHARE, text_chars: float = SCANNED_TEXT_CHARS, replies: DataFrame | None = None) -> DataFrame:
    """The profile of each document of signals (doc_id, page_count, averages), with layout signals and a text sample by doc_id.

    A document without layout signals counts as one column, one without a sample as without text. The language is that of
    the sample's script; a scanned document without one is told by its name, where that is silent by a model's reply
    (replies: doc_id, raw; one a document), and is else taken for English.
    """
    rows = signals.join(layout, "doc_id", "left").join(samples, "doc_id", "left").where("doc_id is not null")
    scanned = (F.coalesce("avg_image_area_ratio", F.lit(0.0)) >= image_share) & (F.coalesce("avg_text_chars_per_page", F.lit(0.0)) <= text_chars)
    origin = F.when(scanned, "scanned_image").otherwise("native_digital")
    shape = layout_complexity(F.coalesce("tableish_score", F.lit(0.0)), F.coalesce("figureish_score", F.lit(0.0)), F.coalesce("approx_column_count", F.lit(1)))
    told = script_language(F.col("sample"))
    if replies is not None:
        rows = rows.join(replies.select("doc_id", reply_language(F.col("raw")).alias("reply")).where("reply is not null").dropDuplicates(["doc_id"]), "doc_id", "left")
    told_by = F.col("reply") if replies is not None else F.lit(None).cast("string")
    named = F.when(named_language(F.col("doc_id")) == "am", "am").otherwise(F.coalesce(told_by, F.lit("en")))
    sure = F.when(named_language(F.col("doc_id")) == "am", 0.85).when(told_by == "am", 0.9).when(told_by.isin("mixed", "en"), 0.85).when(told_by.isNotNull(), 0.75).otherwise(0.4)
    by_name = F.col("v.language").isNull() & (F.col("origin_type") == "scanned_image")
    staged_rows = rows.select("*", origin.alias("origin_type"), shape.alias("layout_complexity"), told.alias("v"), domain_by_name(domain_of(F.col("sample")), F.col("doc_id")).alias("domain_hint"))
    return staged_rows.select(
        "doc_id", "origin_type", "layout_complexity", F.when(by_name, named).otherwise(F.col("v.language")).alias("language"),
        F.when(by_name, sure).otherwise(F.col("v.language_confidence")).alias("language_confidence"),
        "domain_hint", "page_count", "avg_text_chars_per_page", "avg_image_area_ratio", cost_tier(F.col("origin_type"), F.col("layout_complexity")).alias("cost_tier"),
    )


def markdown_language(n: Column, ethiopic: Column, latin: Column) -> Column:
    """struct(language, script, confidence) of extracted markdown, by the counts of Ethiopic and Latin letters."""
    verdict = lambda lang, script, conf: F.struct(F.lit(lang).cast("string").alias("language"), F.lit(script).cast("string").alias("script"), F.lit(conf).alias("confidence"))
    return (
        F.when(n <= 0, verdict(None, None, 0.0)).when((ethiopic >= 5) & (latin >= 20), verdict("mixed", "mixed", 0.85))
        .when((ethiopic >= 5) & (ethiopic / n > 0.03), verdict("am", "ethiopic", 0.9)).when((latin >= 20) & (latin / n > 0.15), verdict("en", "latin", 0.75))
        .otherwise(verdict(None, None, 0.1))
    )


def markdown_quality(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, language, script, confidence, flags) of each text as extracted markdown; null and blank texts are empty markdown."""
    t = stripped(F.coalesce(F.col(text), F.lit("")))
    kept = lambda signs: F.length(F.regexp_replace(t, f"[^{signs}]+", ""))
    rows = counted(docs, key, text, odd=kept(ODD_SIGNS), alnum=kept(r"\p{L}\p{N}"))
    n, ethiopic, latin, plain, odd, alnum = (F.col(c) for c in (*COUNTS, "odd", "alnum"))
    judged = rows.select(key, markdown_language(n, ethiopic, latin).alias("v"), markdown_flags(n, ethiopic, latin, plain, odd, alnum).alias("flags"))
    return judged.select(key, "v.*", F.array_join("flags", "; ").alias("flags"))
