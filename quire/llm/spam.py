"""Pages stuffed with keywords, links or tags, told apart from texts by bagged decision trees.

Content and link features of each whole text come from array operations over batches; letters of scripts without
spaces count in pieces of two or three, so that repetition shows there too. Broad labelling functions that may
disagree vote on each page; where the votes are clear they give a weak label. Bagged decision trees fitted on a bounded
sample of the labelled pages (MAX_LABELLED rows for each sum of votes, drawn by a hash of the key) score every page, also
those without a label, and the score is moved towards the spam rate of the page's host.

Defined cases: null, empty and blank texts are never spam; a page without host is not smoothed; repeated rows of a key
count once; if the weak labels have one class only, the votes' own verdict stands; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.keys import sized
from quire.session import staged

#: Bound of the training sample, in rows of each sum of votes.
MAX_LABELLED = 4000
WINDOW = 64  # tokens in which repetition is measured, so that it does not depend on a text's length
TREES = 50
PRIOR_PAGES = 30.0  # pages that the overall spam rate counts for in a host's rate
HOST_WEIGHT = 0.3

YEAR = re.compile(r"\((?:1[89]|20)\d\d\)")
LINK = re.compile(r"(?:https?://|www\.)[^\s)\"'<>\]]+")
FEATURES = [
    "prose_share", "link_share", "links_per_token", "low_share", "distinct_ratio", "word_ratio", "stops_per_token", "digit_share", "list_marks_per_token",
    "hash_per_token", "counted_lines", "piped_lines", "led_lines", "dated_lines", "short_lines", "repeated_lines", "labelled_lines", "log_tokens", "stopped_lines", "top_window",
]
CHUNK = 400_000  # characters measured at a time in a task

# Kinds of characters, as bits of a table over the basic plane.
WORD, DIGIT, STOP, LIST, SPACE, FULL_STOP, COMMA, CLOSER, THAI = 1, 2, 4, 8, 16, 32, 64, 128, 256
PAIRS, TRIPLES = 512, 1024  # letters of scripts without spaces, whose runs count as tokens of two or of three letters


def kinds() -> np.ndarray:
    table = np.zeros(1 << 16, dtype=np.uint16)
    for i in range(1 << 16):
        c = chr(i)
        k = unicodedata.category(c)
        if k[0] in "LM" and i not in (0x1361, 0x1362):
            table[i] |= WORD
        if k == "Nd":
            table[i] |= WORD | DIGIT
        if c.isspace():
            table[i] |= SPACE
    for lowest, highest in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF)):
        table[lowest : highest + 1] |= TRIPLES
    for lowest, highest in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)):
        table[lowest : highest + 1] |= PAIRS
    for chars, bit in (("!?؟።፧。！？", STOP), (".", FULL_STOP), (",،、，|/•·>»★;[<", LIST), (",،、，", COMMA), ("”\"»)’'", CLOSER)):
        for c in chars:
            table[ord(c)] |= bit
    table[0x0E00:0x0E80] |= THAI
    return table


def spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def distinct_in(groups: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each of n groups has; groups is sorted."""
    if not len(groups):
        return np.zeros(n, dtype=np.int64)
    order = np.lexsort((hashes, groups))
    g, h = groups[order], hashes[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
    return np.bincount(g[new], minlength=n)


def repetition(token_doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, tokens and share of different tokens of each window of WINDOW tokens; each document has one at least."""
    n_tok = np.bincount(token_doc, minlength=n_docs)
    rank = np.arange(len(token_doc)) - np.concatenate([[0], np.cumsum(n_tok)[:-1]])[token_doc]
    windows = np.maximum((n_tok + WINDOW - 1) // WINDOW, 1)
    window = np.concatenate([[0], np.cumsum(windows)[:-1]])[token_doc] + rank // WINDOW
    doc = np.repeat(np.arange(n_docs), windows)
    held = np.bincount(window, minlength=len(doc))
    return doc, held, distinct_in(window, hashes, len(doc)) / np.maximum(held, 1)


def measured(texts: list[str], table: np.ndarray) -> dict[str, np.ndarray]:
    """The features of some non-blank texts, by array operations over all their characters at once."""
    lowered = [t.lower().strip() for t in texts]
    joined = "\n".join(lowered) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    kind = table[np.minimum(points, 0xFFFF)]
    kind[points > 0xFFFF] = WORD
    size = np.array([len(t) + 1 for t in lowered])
    doc_at = np.concatenate([[0], np.cumsum(size)[:-1]])
    n_docs, n_chars = len(texts), len(points)
    doc = np.repeat(np.arange(n_docs), size)
    per_doc = lambda mask: np.add.reduceat(mask.astype(np.int32), doc_at)

    linked = np.zeros(n_chars + 1, dtype=np.int8)
    link_at = []
    for m in LINK.finditer(joined):
        linked[m.start()] += 1
        linked[m.end()] -= 1
        link_at.append(m.start())
    bare = np.cumsum(linked[:-1]) == 0
    links = np.bincount(doc[link_at], minlength=n_docs) if link_at else np.zeros(n_docs)

    word = ((kind & WORD) > 0) & bare
    digit = ((kind & DIGIT) > 0) & bare
    breaks = points == 10
    first = word & ~np.concatenate([[False], word[:-1]])
    place = np.arange(n_chars) - np.maximum.accumulate(np.where(first, np.arange(n_chars), 0))
    first |= word & (((kind & PAIRS) > 0) & (place % 2 == 0) | ((kind & TRIPLES) > 0) & (place % 3 == 0))
    token_at = np.flatnonzero(first)
    place = np.arange(n_chars) - np.maximum.accumulate(np.where(first, np.arange(n_chars), 0))
    mixed = np.where(word, spread(points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), np.uint64(0))
    hashes = np.add.reduceat(mixed, token_at) if len(token_at) else np.zeros(0, dtype=np.uint64)
    token_doc = doc[token_at]
    n_tok = np.bincount(token_doc, minlength=n_docs)
    n = np.maximum(n_tok, 1)

    # repetition in windows of equally many tokens, of all tokens and of words alone
    window_doc, in_window, ratio = repetition(token_doc, hashes, n_docs)
    weighed = lambda x: np.bincount(window_doc, weights=x * in_window, minlength=n_docs) / n
    top = np.maximum.reduceat(ratio, np.searchsorted(window_doc, np.arange(n_docs)))
    lettered = (kind[token_at] & DIGIT) == 0
    word_doc, in_word, of_words = repetition(token_doc[lettered], hashes[lettered], n_docs)
    word_ratio = np.bincount(word_doc, weights=of_words * in_word, minlength=n_docs) / np.maximum(np.bincount(word_doc, weights=in_word, minlength=n_docs), 1)

    # stops, and the pieces of prose between them
    after = np.concatenate([kind[1:], [SPACE]])
    before = np.concatenate([[SPACE], kind[:-1]])
    dot = ((kind & FULL_STOP) > 0) & ((after & (SPACE | CLOSER)) > 0) | ((kind & FULL_STOP) > 0) & ((after & WORD) > 0) & ((before & DIGIT) == 0) & ((after & DIGIT) == 0)
    double = np.isin(points, (58, 0x1361)) & np.concatenate([[False], points[1:] == points[:-1]])
    stop = (dot | ((kind & STOP) > 0) | double) & bare
    parts = stop | ((kind & SPACE) > 0) & ((before & THAI) > 0) & ((after & THAI) > 0) & ((before & DIGIT) == 0) & ((after & DIGIT) == 0)
    parts |= breaks & np.concatenate([[False], breaks[:-1]])  # a blank line
    parts[doc_at + size - 1] = True
    piece = np.cumsum(np.concatenate([[0], parts[:-1].astype(np.int64)]))
    n_pieces = int(piece[-1]) + 1
    per_piece = lambda mask: np.bincount(piece[mask], minlength=n_pieces)
    letters = np.bincount(piece[bare], minlength=n_pieces)
    tokens = np.bincount(piece[token_at], minlength=n_pieces)
    different = distinct_in(piece[token_at], hashes, n_pieces)
    commas = per_piece(((kind & COMMA) > 0) & bare & ((after & DIGIT) == 0))
    marked = per_piece(np.isin(points, (35, 124, 36, 9733)) & bare)
    prose = (letters >= 12) & (letters <= 400) & (different >= 0.7 * tokens) & (tokens > 0) & (marked == 0) & ((commas < 4) | (commas < 0.25 * tokens))
    piece_doc = doc[np.concatenate([[0], np.flatnonzero(parts)[:-1] + 1])] if n_pieces > 1 else doc[:1]
    prose_chars = np.bincount(piece_doc, weights=letters * prose, minlength=n_docs)

    # lines
    line = np.cumsum(np.concatenate([[0], breaks[:-1].astype(np.int64)]))
    line_at = np.concatenate([[0], np.flatnonzero(breaks)[:-1] + 1])
    line_doc = doc[line_at]
    per_line = lambda mask: np.add.reduceat(mask.astype(np.int32), line_at)
    length = per_line(~breaks)
    filled = per_line((kind & SPACE) == 0) > 0
    digits = per_line((kind & DIGIT) > 0)
    share = lambda mask: np.bincount(line_doc[mask & filled], minlength=n_docs) / np.maximum(np.bincount(line_doc[filled], minlength=n_docs), 1)
    last = np.maximum.reduceat(np.where((kind & SPACE) == 0, np.arange(n_chars), 0), line_at)
    ended = (stop | ((kind & CLOSER) > 0))[last]
    run = np.convolve((points == 46).astype(np.int32), np.ones(4, dtype=np.int32))[3 : n_chars + 3][:n_chars] == 4
    dated = np.zeros(n_chars, dtype=bool)
    dated[[m.start() for m in YEAR.finditer(joined)]] = True
    numbers = np.full(len(line_at), -10, dtype=np.int64)
    opens = ((kind & DIGIT) > 0) & ~((before & DIGIT) > 0)
    k = np.flatnonzero(opens)
    k = k[np.unique(line[k], return_index=True)[1]] if len(k) else k
    value, live = np.zeros(len(k), dtype=np.int64), np.ones(len(k), dtype=bool)
    for i in range(4):
        at = np.minimum(k + i, n_chars - 1)
        live &= (kind[at] & DIGIT) > 0
        value = np.where(live, value * 10 + (points[at].astype(np.int64) - 48) % 10, value)
    numbers[line[k]] = value
    kept = np.flatnonzero(filled)
    counted = np.zeros(len(line_at), dtype=bool)
    if len(kept) > 1:
        counted[kept[1:]] = (numbers[kept[1:]] == numbers[kept[:-1]] + 1) & (line_doc[kept[1:]] == line_doc[kept[:-1]])
    colon = np.minimum.reduceat(np.where(np.isin(points, (58, 0xFF1A)), np.arange(n_chars), n_chars), line_at) - line_at
    label = (colon >= 2) & (colon <= 21) & (per_line((kind & COMMA) > 0) >= 2) & (digits < 0.2 * length)
    line_hash = np.add.reduceat(spread(points.astype(np.uint64) + ((np.arange(n_chars) - line_at[line]).astype(np.uint64) << np.uint64(32))), line_at)
    n_lines = np.maximum(np.bincount(line_doc[filled], minlength=n_docs), 1)

    chars = np.maximum(size - 1, 1)
    return {
        "n": n_tok, "prose_share": prose_chars / chars, "link_share": per_doc(~bare) / chars, "links_per_token": links / n,
        "low_share": weighed(ratio < 0.55), "distinct_ratio": weighed(ratio), "word_ratio": word_ratio, "stops_per_token": per_doc(stop) / n,
        "digit_share": per_doc(digit) / chars, "list_marks_per_token": per_doc(((kind & LIST) > 0) & bare) / n,
        "hash_per_token": per_doc((points == 35) & bare) / n, "counted_lines": share(counted),
        "piped_lines": share((per_line(points == 124) > 0) & (digits > 0)), "led_lines": share(per_line(run) > 0),
        "dated_lines": share(per_line(dated) > 0), "short_lines": share((length < 45) & (digits == 0) & ~ended),
        "repeated_lines": 1 - distinct_in(line_doc[filled], line_hash[filled], n_docs) / n_lines, "labelled_lines": share(label),
        "log_tokens": np.log1p(n_tok), "stopped_lines": share(ended), "top_window": top,
    }


def features(pages: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(key, host, n, features) of each page whose text is not blank."""
    table = kinds()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["t"].tolist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (chars == 0 or chars + len(texts[end]) < CHUNK):
                    chars += len(texts[end])
                    end += 1
                yield pd.DataFrame({"key": batch["key"].iloc[at:end].array, "host": batch["host"].iloc[at:end].array, **measured(texts[at:end], table)})
                at = end

    t = pages.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("t"))
    t = t.where(F.col("key").isNotNull() & F.col("t").rlike(r"\S"))
    schema = f"key {dict(t.dtypes)['key']}, host {dict(t.dtypes)['host']}, n bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    columns = ["key", "host", "n", *FEATURES]
    return t.mapInPandas(lambda batches: (b[columns] for b in measure(batches)), schema)


#: Labelling functions, each on one or two features and each wrong on some pages: their votes for spam (1) and against it (-1).
VOTES = {
    "links": (1, "link_share > 0.35 or links_per_token > 0.2"),
    "hashes": (1, "hash_per_token > 0.3"),
    "repeating": (1, "distinct_ratio < 0.6"),
    "no_prose": (1, "prose_share < 0.15"),
    "marks": (1, "list_marks_per_token > 0.3"),
    "prose": (-1, "prose_share > 0.6"),
    "varied": (-1, "distinct_ratio > 0.75 and link_share < 0.35"),
    "figures": (-1, "digit_share > 0.18 and link_share < 0.35"),
    "ordered": (-1, "greatest(counted_lines, led_lines, dated_lines, piped_lines) > 0.5 and link_share < 0.35"),
    "short": (-1, "n < 16 and link_share < 0.35"),
}
#: A page is labelled where the votes for spam outnumber the others by at least MARGIN, or the others those; on the rest the trees alone decide.
MARGIN = 2


def votes() -> Column:
    """The sum of a page's votes."""
    return F.expr(" + ".join(f"case when {test} then {vote} else 0 end" for vote, test in VOTES.values()))


def weak_label() -> Column:
    """1 or 0 where the votes are clear, else null."""
    return F.when(F.col("votes") >= MARGIN, 1.0).when(F.col("votes") < 0, 0.0)


def scored(pages: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(key, host, votes, label, page_score, host_rate, score) of each page that is not blank; spam from a score of 0.5 on."""
    rows = staged(features(pages, key, text, host).withColumn("votes", votes()).withColumn("label", weak_label()), "page-features")
    counts = {(r["label"], r["votes"]): r["n_rows"] for r in rows.where("label is not null").groupBy("label", "votes").agg(F.count("*").alias("n_rows")).collect()}  # one row per sum of votes
    if len({label for label, _ in counts}) < 2:
        page = rows.withColumn("page_score", F.coalesce(F.col("label"), F.when(F.col("votes") > 0, 1.0).otherwise(0.0)))
    else:
        share = F.create_map(*[F.lit(x) for (_, v), total in counts.items() for x in (v, min(1.0, MAX_LABELLED / total))])
        drawn = rows.where("label is not null").where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) / 1e6 < share[F.col("votes")])
        vector = VectorAssembler(inputCols=FEATURES, outputCol="vector", handleInvalid="keep")
        forest = RandomForestClassifier(
            featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=8, minInstancesPerNode=2,
            featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=11, cacheNodeIds=False,
        )
        sample = staged(drawn.select("label", *FEATURES), "page-labels")
        model = forest.fit(vector.transform(sample.coalesce(4)))
        page = model.transform(vector.transform(rows)).withColumn("page_score", vector_to_array("probability")[1])
    page = page.select("key", "host", "votes", "label", "page_score")
    page = staged(page, "page-scores")
    prior = page.agg(F.avg("page_score")).first()[0]
    prior = min(max(prior if prior is not None else 0.5, 0.001), 0.999)
    hosts = page.where("host is not null").groupBy("host").agg(((F.sum("page_score") + PRIOR_PAGES * prior) / (F.count("*") + PRIOR_PAGES)).alias("host_rate"))
    odds = lambda p: F.log(F.greatest(p, F.lit(0.001)) / F.greatest(1 - p, F.lit(0.001)))
    hosts = staged(hosts, "host-rates")
    known = page.where("host is not null").join(sized(hosts), "host", "left")
    both = known.unionByName(page.where("host is null").withColumn("host_rate", F.lit(None).cast("double")))
    moved = odds(F.col("page_score")) + HOST_WEIGHT * (odds(F.coalesce("host_rate", F.lit(prior))) - odds(F.lit(prior)))
    return both.select(F.col("key").alias(key), "host", "votes", "label", "page_score", "host_rate", (1 / (1 + F.exp(-moved))).alias("score"))


def decision_report(scores: DataFrame) -> DataFrame:
    """(n_pages, n_spam, n_by_label, n_beyond_labels, n_labels_overturned, n_moved_by_host) of `scored` pages.

    n_beyond_labels: spam that no weak label called so; n_moved_by_host: pages on whose verdict the host's rate decides.
    """
    spam, by_page = F.col("score") >= 0.5, F.col("page_score") >= 0.5
    labelled = F.coalesce(F.col("label") == 1.0, F.lit(False))
    return scores.agg(
        F.count("*").alias("n_pages"), F.count_if(spam).alias("n_spam"), F.count_if(spam & labelled).alias("n_by_label"), F.count_if(spam & ~labelled).alias("n_beyond_labels"),
        F.count_if(F.col("label").isNotNull() & ((F.col("label") == 1.0) != spam)).alias("n_labels_overturned"), F.count_if(spam != by_page).alias("n_moved_by_host"),
    )


def spam_pages(pages: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """The keys of pages found to be spam, each once."""
    return scored(pages, key, text, host).where("score >= 0.5").select(key).dropDuplicates([key])
