"""Searches: by substring counts over an index of the corpus's words, and by cosine over stored vectors.

Both score every stated query against all rows and are exact. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.arrivals import first_arrivals
from quire.operators.keys import sized
from quire.session import staged

BLOCK = 512  # queries scored against a block of rows at a time
ROW_BLOCK = 20_000
FEW_WORDS = 64  # asked words of a document that are counted in its texts one by one


def asked_words(questions: DataFrame, own: list[str]) -> DataFrame:
    """(question, own columns, word, n_words, asked): the words of each question, how many it has, how often it has each."""
    parts = F.split(F.trim(F.lower("question")), r"\s+")
    each = questions.select("question", *own, F.explode(parts).alias("word"), F.size(parts).alias("n_words")).where("word <> ''")
    return each.groupBy("question", *own, "word", "n_words").agg(F.count("*").alias("asked"))


def holders(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word, times): the distinct tokens that hold a word, and how often; the pairs meet over the word's first letters."""
    near = tokens.select("token", F.explode(_grams("token")).alias("gram")).join(words.select("word", _first_gram("word").alias("gram")), "gram").distinct()
    inside = F.floor((F.length("token") - F.length(F.replace(F.col("token"), F.col("word")))) / F.length("word"))
    return near.where(F.col("token").contains(F.col("word"))).select("token", "word", inside.alias("times"))


def keyword_top(units: DataFrame, questions: DataFrame, most: int = 5, within: str | None = None) -> DataFrame:
    """(question, [within,] rank, ldu_id, score): the units in which the question's words occur most often per word.

    A word also counts inside longer words, so that each question word is first looked up in the corpus's distinct
    words; those found are then counted where texts are read, and only counts are shuffled. Words do not contain
    spaces, so none is missed. With `within`, a column of both tables, each question is put to the units of its own
    value only; where a value has at most FEW_WORDS question words, its texts are searched for them directly, which
    gives the same counts without an index. Repeated rows of a unit, which have the same content, count once.
    """
    own = [within] if within else []
    rows = units.where("ldu_id is not null and content is not null")
    asked = staged(asked_words(questions, own), "asked-words")
    if within:
        words = asked.where(F.col(within).isNotNull()).select(within, "word").distinct()
        sizes = staged(words.groupBy(within).agg(F.count("*").alias("n")), "asked-sizes")
        few, many = (sizes.where(test).select(within) for test in (f"n <= {FEW_WORDS}", f"n > {FEW_WORDS}"))
        counts = _searched(rows, words.join(sized(few), within, "left_semi"), within)
        if not many.isEmpty():
            counts = counts.unionByName(_looked_up(rows.join(sized(many), within, "left_semi"), words.join(sized(many), within, "left_semi"), own))
    else:
        counts = _looked_up(rows, asked, own)
    copies = rows.groupBy("ldu_id").agg(F.count("*").alias("copies")).where("copies > 1")
    once = counts.join(sized(staged(copies, "unit-copies")), "ldu_id", "left").withColumn("n", F.col("n") / F.coalesce("copies", F.lit(1)))
    hits = once.join(sized(asked), [*own, "word"]).groupBy("question", *own, "ldu_id").agg((F.sum(F.col("n") * F.col("asked")) / F.max("n_words")).alias("score"))
    order = Window.partitionBy("question", *own).orderBy(F.desc("score"), "ldu_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("question", *own, "rank", "ldu_id", "score")


def _searched(rows: DataFrame, words: DataFrame, within: str) -> DataFrame:
    """(ldu_id, within, word, n): how often each of the words of its value occurs in a unit's text; a value has few words."""
    lists = sized(words.groupBy(within).agg(F.collect_list("word").alias("words")))
    c = F.col("c")
    present = F.filter("words", lambda w: c.contains(w))
    inside = F.transform(present, lambda w: F.struct(w.alias("word"), F.floor((F.length(c) - F.length(F.replace(c, w))) / F.length(w)).alias("n")))
    each = rows.select("ldu_id", within, F.lower("content").alias("c")).join(lists, within).select("ldu_id", within, F.inline(inside))
    return each.groupBy("ldu_id", within, "word").agg(F.sum("n").alias("n"))


def _looked_up(rows: DataFrame, words: DataFrame, own: list[str]) -> DataFrame:
    """(ldu_id, own, word, n): as `_searched`, by way of the distinct tokens that hold a word."""
    tokens = F.split(F.lower("content"), r"\s+")
    every = rows.select(F.explode(F.array_distinct(tokens)).alias("token")).where("token <> ''").distinct()
    holding = sized(staged(holders(every, words.select("word").distinct()), "word-holders"))
    return rows.select("ldu_id", *own, F.explode(tokens).alias("token")).join(holding, "token").groupBy("ldu_id", *own, "word").agg(F.sum("times").alias("n"))


def _grams(word: str):
    """All pieces of one to three characters of a word, each once: what a question word may begin with."""
    w = F.col(word)
    at = F.sequence(F.lit(1), F.length(w))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[F.substring(w, i, F.lit(k)) for k in (1, 2, 3)]))))


def _first_gram(word: str):
    return F.substring(F.col(word), 1, 3)


def vector_top(vectors: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, rank, vec_id): the nearest vectors by cosine of each query vector, itself left out.

    Blocks of queries meet blocks of rows; each pair keeps `most` rows a query, which a window ranks.
    """
    valid = "embedding is not null and size(embedding) > 0"
    q = queries.where(valid).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    n_blocks = max(1, -(-q.count() // BLOCK))
    row_blocks = max(1, -(-vectors.count() // ROW_BLOCK))
    pick = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = q.withColumn("qb", pick("query_id", n_blocks)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    right = vectors.where(valid).select("vec_id", "embedding").withColumn("rb", pick("vec_id", row_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def nearest(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []})
        asked, rows = asked.drop_duplicates("query_id"), rows.drop_duplicates("vec_id")
        a, b = (np.stack(x).astype(np.float64) for x in (asked["q"].tolist(), rows["embedding"].tolist()))
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        cosine = np.round(unit(a) @ unit(b).T, 12)  # beyond that, equal vectors may differ by the order of summation
        ids = rows["vec_id"].to_numpy()
        cosine[asked["query_id"].to_numpy()[:, None] == ids[None, :]] = -2
        k = min(most, cosine.shape[1])
        least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
        q_at, v_at = np.nonzero((cosine >= least[:, None]) & (cosine > -2))  # ties with the last one included
        order = np.lexsort((ids[v_at], -cosine[q_at, v_at], q_at))
        q_at, v_at = q_at[order], v_at[order]
        rank = np.arange(len(q_at)) - np.searchsorted(q_at, q_at)
        q_at, v_at = q_at[rank < k], v_at[rank < k]
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[q_at], "vec_id": ids[v_at], "cosine": cosine[q_at, v_at]})

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(nearest, "query_id bigint, vec_id bigint, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "rank", "vec_id")


def stored_texts(units: DataFrame, stored: DataFrame) -> DataFrame:
    """(ldu_id, text, doc_id, chunk_type, page_refs) of the units that an ingest adds: those with content whose id is not stored yet.

    Texts are cut at 8000 characters, as the store takes no longer ones, and pages are JSON.
    """
    slim = units.where("ldu_id is not null and trim(content) <> ''").select("ldu_id", "ingested_at", F.substring("content", 1, 8000).alias("text"), "doc_id", "chunk_type", F.to_json(F.coalesce("page_refs", F.array())).alias("page_refs"))
    return first_arrivals(new_rows(slim, stored, "ldu_id"), "ldu_id", "ingested_at").drop("ingested_at")


def new_rows(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not stored yet: an ingest adds only these."""
    return rows.join(stored.select(key), key, "left_anti")
