"""Questions about documents, answers from their units, and claims held against them; no model is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import NUMBER_TOPIC
from quire.operators.arrivals import first_arrivals
from quire.operators.facts import provenance
from quire.operators.keys import sized
from quire.operators.search import asked_words, holders, keyword_top
from quire.session import staged

# Question templates by domain, words that tell the domain, and titles that make no topic.
TEMPLATES = {
    "audit": ["What audit findings are reported for {topic}?", "What recommendations were made about {topic}?", "Were there any irregularities or issues found in {topic}?"],
    "budget": ["What is the allocated budget for {topic}?", "What expenditure figures are reported for {topic}?", "What is the difference between planned and actual for {topic}?"],
    "financial": ["What is the total {topic} reported in this document?", "What are the key figures for {topic}?", "What does the document say about {topic}?"],
    "survey": ["What are the main findings about {topic}?", "What percentage or score is reported for {topic}?", "What challenges or issues are identified regarding {topic}?"],
    "general": ["What does the document say about {topic}?", "What are the key findings related to {topic}?", "What conclusions are drawn about {topic}?"],
}
DOMAIN_CUES = {
    "audit": ["audit", "auditor", "finding", "irregularit"],
    "budget": ["budget", "expenditure", "procurement", "allocation"],
    "financial": ["revenue", "profit", "income", "balance sheet", "financial statement"],
    "survey": ["survey", "assessment", "performance", "initiative", "awareness"],
}
NO_TOPICS = ["introduction", "conclusion", "contents", "appendix", "annex", "references", "background", "overview", "summary", "methodology", "list of", "acknowledgement", "acronym", "table of"]
DEFAULT_QUESTIONS = [
    "What is the total revenue or income reported in this document?",
    "What are the main findings or key conclusions of this report?",
    "What budget allocations or expenditure figures are mentioned?",
]
LAST_TOPIC = "the main conclusions"
NO_ANSWER = "No relevant content found."


def topics(section: DataFrame, most: int = 10) -> DataFrame:
    """(index_id, n, topic) of the titles that make topics, in pre-order.

    section has interval labels (pre, post), depth and title. A title that makes no topic takes its whole subtree
    with it: some node before it in pre-order, dropped itself, has a greater post-order number. Top sections count
    only without sections below them. Titles equal in their first 40 letters count once.
    """
    title = F.trim(F.coalesce("title", F.lit("")))
    generic = F.lit(False)
    for word in NO_TOPICS:
        generic = generic | F.lower(title).contains(word)
    dropped = (F.length(title) < 8) | generic | (title.rlike(r"^\d+[.\s]") & (F.length(title) < 20))
    walk = Window.partitionBy("index_id").orderBy("pre")
    rows = section.select("index_id", "pre", "post", "depth", title.alias("topic"), dropped.alias("dropped"))
    rows = rows.withColumn("above", F.max(F.when(F.col("dropped"), F.col("post"))).over(walk.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("leaf", F.coalesce(F.lead("depth").over(walk) <= F.col("depth"), F.lit(True)))
    kept = rows.where("not dropped and (above is null or above < post) and (depth > 1 or leaf)")
    key = F.substring(F.lower("topic"), 1, 40)
    once = kept.withColumn("again", F.row_number().over(Window.partitionBy("index_id", key).orderBy("pre"))).where("again = 1")
    return once.withColumn("n", F.row_number().over(walk)).where(F.col("n") <= most).select("index_id", "n", "topic")


def questions(page_indexes: DataFrame, section: DataFrame) -> DataFrame:
    """(index_id, doc_id, question_no, question): three questions for each page index with a document id."""
    section = staged(section.select("index_id", "pre", "post", "depth", "title"), "titles")
    told = section.where("depth = 1").groupBy("index_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", F.coalesce("title", F.lit("")).alias("title")))), lambda x: x["title"]), " ").alias("titles"))
    own = topics(section).where("n <= 3").groupBy("index_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "topic"))), lambda x: x["topic"]).alias("topics"))
    docs = page_indexes.where("index_id is not null and doc_id is not null").select("index_id", "doc_id").dropDuplicates(["index_id"])
    rows = docs.join(told, "index_id", "left").join(own, "index_id", "left")
    text = F.lower(F.concat_ws(" ", "doc_id", F.coalesce("titles", F.lit(""))))
    domain = None
    for name, cues in DOMAIN_CUES.items():
        hit = F.lit(False)
        for cue in cues:
            hit = hit | text.contains(cue)
        domain = F.when(hit, name) if domain is None else domain.when(hit, name)
    found = F.coalesce("topics", F.array().cast("array<string>"))
    words = F.filter(F.regexp_extract_all(F.regexp_replace("doc_id", "[_-]", " "), F.lit("[A-Za-z]{4,}"), F.lit(0)), lambda w: F.length(w) > 5)
    padded = F.when(F.size(found) < 3, F.concat(found, words)).otherwise(found)
    padded = F.when(F.size(padded) == 0, F.array(*map(F.lit, ("the main subject", "key findings", "financial data")))).otherwise(padded)
    three = F.slice(F.concat(padded, F.array_repeat(F.lit(LAST_TOPIC), 3)), 1, 3)
    templates = F.create_map(*[x for d, ts in TEMPLATES.items() for x in (F.lit(d), F.array(*map(F.lit, ts)))])
    chosen = templates[domain.otherwise("general")]
    each = rows.select("index_id", "doc_id", F.posexplode(F.zip_with(chosen, three, lambda t, x: F.replace(t, F.lit("{topic}"), x))).alias("question_no", "question"))
    return each.select("index_id", "doc_id", (F.col("question_no") + 1).alias("question_no"), "question")


def default_questions(page_indexes: DataFrame) -> DataFrame:
    """(index_id, doc_id, question_no, question): the questions put to every document, whatever its sections."""
    docs = page_indexes.where("index_id is not null and doc_id is not null").select("index_id", "doc_id").dropDuplicates(["index_id"])
    each = docs.select("*", F.posexplode(F.array(*map(F.lit, DEFAULT_QUESTIONS))).alias("at", "question"))
    return each.select("index_id", "doc_id", (F.col("at") + 1).alias("question_no"), "question")


def _named(units: DataFrame, hits: DataFrame) -> DataFrame:
    """The units that hits name."""
    return units.join(sized(hits.select("ldu_id").distinct()), "ldu_id", "left_semi")


def _snippets(units: DataFrame, size: int) -> DataFrame:
    return first_arrivals(units.select("ldu_id", "ingested_at", F.substring("content", 1, size).alias("snippet")), "ldu_id", "ingested_at").drop("ingested_at")


def answered(asked: DataFrame, units: DataFrame, snippet: int = 300) -> DataFrame:
    """asked (doc_id, question, ...) with the answer from the best unit of the question's own document, and its id."""
    asked = staged(asked, "asked-questions")
    best = staged(keyword_top(units, asked.select("doc_id", "question").distinct(), most=1, within="doc_id"), "best-units")
    texts = _snippets(_named(units, best), snippet)
    hits = best.join(texts, "ldu_id").select("doc_id", "question", "ldu_id", "snippet")
    return asked.join(hits, ["doc_id", "question"], "left").select(*asked.columns, F.coalesce("snippet", F.lit(NO_ANSWER)).alias("answer"), "ldu_id")


def totals(answers: DataFrame) -> DataFrame:
    """(n_docs, n_questions, n_answered) of answers as `answered` gives them: one row, zeros without any."""
    return answers.agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_questions"), F.count("ldu_id").alias("n_answered"))


def evidence(hits: DataFrame, units: DataFrame, size: int = 300) -> DataFrame:
    """hits (ldu_id, ...) with what speaks for them: snippet, document_name, pages and content_hash of their units."""
    hits = staged(hits, "search-hits")
    units = _named(units, hits)
    where = provenance(units).select("ldu_id", F.regexp_extract("source_path", r"([^/]*)$", 1).alias("document_name"), F.array_join(F.transform("spans", lambda x: x["page"].cast("string")), ",").alias("pages"), "content_hash")
    return hits.join(_snippets(units, size), "ldu_id").join(where, "ldu_id").select(*hits.columns, "snippet", "document_name", "pages", "content_hash")


def question_facts(asked: DataFrame, facts: DataFrame, most: int = 5) -> DataFrame:
    """asked with (topic, rank, id): the first facts, by id, whose field names the question's first word of numbers.

    The words are those of one pattern, so the facts meet a handful of them; a question without one has no facts.
    """
    topic = F.lower(F.regexp_extract("question", NUMBER_TOPIC, 0))
    told = asked.withColumn("topic", topic).where("topic <> ''")
    words = told.select("topic").distinct()
    named = facts.where("field_name is not null").select("id", F.lower("field_name").alias("f")).dropDuplicates(["id"])
    met = named.join(F.broadcast(words), F.col("f").contains(F.col("topic")))
    first = met.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy("id"))).where(F.col("rank") <= most)
    return told.join(first.select("topic", "rank", "id"), "topic").select(*asked.columns, "topic", "rank", "id")


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]{4,}"), F.lit(0)))


def verified(claims: DataFrame, units: DataFrame) -> DataFrame:
    """claims (doc_id, claim, ...) with verdict, overlap and the unit that supports it best.

    The eight units of the claim's document that speak of it most are held against it: the share of its longer words
    in the first 300 characters decides. Without such a unit the verdict is not_found with overlap 0.
    """
    top = staged(keyword_top(units, claims.select("doc_id", F.col("claim").alias("question")).distinct(), most=8, within="doc_id").withColumnRenamed("question", "claim"), "claim-units")
    texts = _snippets(_named(units, top), 300)
    mine = _words(F.col("claim"))
    held = top.join(texts, "ldu_id").withColumn("overlap", F.size(F.array_intersect(mine, _words(F.col("snippet")))) / F.greatest(F.size(mine), F.lit(1)))
    best = held.groupBy("doc_id", "claim").agg(F.max_by(F.struct("overlap", "ldu_id"), F.struct(F.col("overlap"), -F.col("rank"))).alias("b"))
    both = claims.join(best, ["doc_id", "claim"], "left")
    overlap = F.coalesce("b.overlap", F.lit(0.0))
    verdict = F.when(overlap >= 0.5, "verified").when(overlap >= 0.2, "unverifiable").otherwise("not_found")
    return both.select(*claims.columns, verdict.alias("verdict"), overlap.alias("overlap"), F.when(overlap > 0.1, F.col("b.ldu_id")).alias("evidence_ldu"))


def section_top(section: DataFrame, asked: DataFrame, most: int = 3, within: str | None = None) -> DataFrame:
    """(question, [within,] rank, index_id, node_path, score): the sections whose title, summary and entities name the question most.

    asked is a stated set of questions, each held against all sections, with `within` against those of its own value.
    Question words are looked up in the distinct words of the sections and counted from there; a whole question
    in a title, which has all its words there, counts on top.
    """
    own = [within] if within else []
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    entities_ = F.array_join(F.coalesce("key_entities", F.array()), "\n")
    fields = F.array(*(F.struct(text(c).alias("text"), F.lit(w).alias("weight")) for c, w in ((F.col("title"), 2.0), (F.col("summary"), 0.5), (entities_, 1.0))))
    rows = staged(section.select("index_id", "node_path", "pre", text(F.col("title")).alias("t"), F.inline(fields)), "section-texts")
    words = staged(asked_words(asked.where("question <> ''").select("question", *own).distinct(), own), "asked-words")
    each = rows.select("index_id", "pre", "weight", F.explode(F.split("text", r"\s+")).alias("token")).where("token <> ''")
    holding = sized(staged(holders(each.select("token").distinct(), words.select("word").distinct()), "word-holders"))
    counts = each.join(holding, "token").groupBy("index_id", "pre", "word").agg(F.sum(F.col("weight") * F.col("times")).alias("n"))
    hits = counts.join(sized(words), [*own, "word"]).groupBy("question", *(c for c in own if c != "index_id"), "index_id", "pre").agg(F.sum(F.col("n") * F.col("asked")).alias("score"))
    titles = rows.where("weight = 2.0").select("index_id", "pre", "node_path", "t")
    q = F.lower("question")
    whole = F.floor((F.length("t") - F.length(F.replace(F.col("t"), q))) / F.length(q))
    met = hits.join(titles, ["index_id", "pre"]).withColumn("score", F.col("score") + 3 * whole)
    order = Window.partitionBy("question", *own).orderBy(F.desc("score"), "index_id", "pre")
    kept = met.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return kept.select("question", *(c for c in own if c != "index_id"), "rank", "index_id", "node_path", "score")


def ask(asked: DataFrame, units: DataFrame, section: DataFrame, facts: DataFrame, most: int = 5) -> DataFrame:
    """asked (index_id, doc_id, question, ...) with the answer, its evidence and where that stands, a row for each question.

    answer: the best unit's first 300 characters; snippets, ldu_ids, pages and hashes: those of the three best of `most` units of
    the question's document; sections: the titles' paths of the three best sections of its index; fact_ids: the first five
    facts about the first word of numbers that it has, over all documents; tools: what was asked for it.
    """
    asked = staged(asked, "asked-questions")
    best = staged(keyword_top(units, asked.select("doc_id", "question").distinct(), most=most, within="doc_id").where("rank <= 3"), "best-units")
    units = _named(units, best)
    where = provenance(units).select("ldu_id", "content_hash", F.transform("spans", lambda x: x["page"]).alias("pages"))
    hits = best.join(_snippets(units, 300), "ldu_id").join(where, "ldu_id")
    found = hits.groupBy("doc_id", "question").agg(F.array_sort(F.collect_list(F.struct("rank", "ldu_id", "snippet", "pages", "content_hash"))).alias("h"))
    paths = section_top(section, asked.select("index_id", "question").distinct(), within="index_id").groupBy("index_id", "question").agg(F.array_sort(F.collect_list(F.struct("rank", "node_path"))).alias("s"))
    told = question_facts(asked.select("question").distinct(), facts).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("f"))
    rows = asked.join(found, ["doc_id", "question"], "left").join(paths, ["index_id", "question"], "left").join(told, "question", "left")
    part = lambda a, c, by: F.coalesce(F.array_join(F.transform(a, lambda x: x[c].cast("string")), by), F.lit(""))
    pages = F.coalesce(F.array_join(F.transform("h", lambda x: F.array_join(x["pages"].cast("array<string>"), ",")), "; "), F.lit(""))
    numbered = F.col("question").rlike(NUMBER_TOPIC)
    return rows.select(
        *asked.columns, F.coalesce(F.get("h", F.lit(0))["snippet"], F.lit(NO_ANSWER)).alias("answer"), part("h", "ldu_id", "; ").alias("ldu_ids"),
        pages.alias("pages"), part("h", "content_hash", "; ").alias("hashes"), part("s", "node_path", "; ").alias("sections"), part("f", "id", "; ").alias("fact_ids"),
        F.when(numbered, "pageindex_navigate, semantic_search, structured_query").otherwise("pageindex_navigate, semantic_search").alias("tools"),
    )
