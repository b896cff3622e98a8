"""Languages of documents and of the lines of mixed documents, by error-correcting output codes.

Each language has a codeword. One binary n-gram classifier per bit of the code is fitted on a bounded sample of
labelled units (MAX_UNITS a language, drawn by a hash of the key) whose noisy labels a second round cleans; its
weights are log odds of hashed character n-grams. A line's bits are decoded to the codeword of least loss, each
bit weighted by its classifier's reliability; a small gap to the next codeword flags the line as ambiguous. A document
has the languages of its lines; its confidence is the mean share of its language's codeword (of both languages' if it is
mixed) in the likelihoods that its lines give to all codewords, and a small one flags it too.

Defined cases: null, empty and blank texts have no language; a line without letters takes the language of the
line it continues or of the document; repeated rows count once; a document without text keeps no verdict and is
no case; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.keys import sized
from quire.session import staged

# The corpus's languages and their usual labels.
LABELS = {
    "en": "en eng english",
    "am": "am amh amharic አማርኛ",
    "ti": "ti tir tigrinya tigrigna ትግርኛ",
    "om": "om orm oromo afaan_oromoo afaan_oromo oromiffa",
    "fr": "fr fra fre french français",
    "es": "es spa spanish español castellano",
    "de": "de deu ger german deutsch",
    "sw": "sw swa swahili kiswahili",
    "ar": "ar ara arabic العربية",
    "zh": "zh zho chi chinese mandarin 中文 汉语",
    "ja": "ja jpn japanese 日本語",
    "th": "th tha thai ไทย ภาษาไทย",
    "mixed": "mixed mul multiple multilingual",
}
LANGUAGES = [x for x in LABELS if x != "mixed"]
BITS, BUCKETS = 15, 1 << 14
#: Bound of the training sample, in units of each language.
MAX_UNITS = 1500
#: A second language makes a document mixed from this share of its lines on, among all and among those that are sure.
MIXED_SHARE = 0.05
#: A line speaks for a language of its document only if its confidence is at least this.
SURE = 0.9
ENOUGH = 16  # n-grams that a line must have to be sure
GAP = 1.0  # a line of a mixed document whose loss lies less than this from that of the other language is ambiguous
CLEAR = 0.8  # a document of less confidence than this is ambiguous
CONTEXT = 0.6  # weight of a line that the next one continues
TEMPERATURE = 0.25
CHUNK = 150_000  # characters scored at a time in a task


def code_matrix() -> np.ndarray:
    """Codewords of +1 and -1, one row per language, far apart; the same in every process."""
    rng = np.random.default_rng(7)
    best, most = None, -1
    for _ in range(400):
        m = np.where(rng.random((len(LANGUAGES), BITS)) < 0.5, -1, 1)
        apart = min((m[i] != m[j]).sum() for i in range(len(m)) for j in range(i))
        if apart > most and (abs(m.sum(0)) <= 4).all():
            best, most = m, apart
    return best.astype(np.float32)


def spoken(label: Column) -> Column:
    """The language that a label names in any of its spellings; null where it names none of the corpus's."""
    plain = F.regexp_replace(F.lower(F.trim(label)), r"\s+", "_")
    known = F.create_map(*[F.lit(x) for code, names in LABELS.items() for n in names.split() for x in (n, code)])
    return F.coalesce(known[plain], known[F.regexp_extract(plain, r"^([a-z]{2,3})[-_][a-z]{2,4}$", 1)])


def gram_hashes(text: str) -> np.ndarray:
    """Hash bucket of the character bigram and trigram that start at each place; digits and marks are spaces."""
    points = np.frombuffer((text + "  ").encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = (points > 96) & (points < 123) | (points > 191) & (points != 215) & (points != 247) & ~((points >= 0x2000) & (points < 0x2E80)) & ~((points >= 0x3000) & (points < 0x3041)) & ~((points >= 0x1360) & (points < 0x137D)) & ~((points >= 0xFF00) & (points < 0xFF21)) & (points != 0x60C) & (points != 0x61F) & ~((points >= 0x660) & (points < 0x66A))
    p = np.where(letter, points, 32).astype(np.uint64)
    two = p[:-2] * np.uint64(0x9E3779B1) ^ p[1:-1] * np.uint64(0x85EBCA77)
    three = two * np.uint64(0xC2B2AE3D) ^ p[2:] * np.uint64(0x27D4EB2F)
    spread = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int32)
    live = (p[:-2] != 32) | (p[1:-1] != 32)
    return np.where(live, spread(two), -1), np.where(live, spread(three), -1)


def counted(sample: DataFrame, label: str) -> DataFrame:
    """(language, bucket, n) of the n-grams of a sample's texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for batch in batches:
            for lang, text in zip(batch["language"], batch["content"]):
                own = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for h in gram_hashes(text.lower()):
                    own += np.bincount(h[h >= 0], minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"language": lang, "bucket": at.astype(np.int32), "n": own[at]})

    rows = sample.select(F.col(label).alias("language"), "content").mapInPandas(count, "language string, bucket int, n bigint")
    return rows.groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def bit_weights(counts: pd.DataFrame) -> np.ndarray:
    """(bucket, bit) log odds between the languages that have the bit and those that have not, all of equal mass.

    counts has at most one row per language and bucket, whatever the corpus's size.
    """
    code = code_matrix()
    dense = np.zeros((len(LANGUAGES), BUCKETS))
    for lang, part in counts.groupby("language"):
        dense[LANGUAGES.index(lang), part["bucket"]] = part["n"]
    seen = dense.sum(1) > 0
    share = (dense + 0.5) / (dense.sum(1, keepdims=True) + 0.5 * BUCKETS)
    weights = np.zeros((BUCKETS, BITS), dtype=np.float32)
    for b in range(BITS):
        on, off = seen & (code[:, b] > 0), seen & (code[:, b] < 0)
        if on.any() and off.any():
            weights[:, b] = np.log(share[on].mean(0) / share[off].mean(0))
    return weights


def line_scores(texts: list[str], weights: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Lines per text, bit sums per line, and each line's weight of evidence, of many texts at once."""
    per, lines, continued = [], [], []
    for text in texts:
        own = text.split("\n")
        per.append(len(own))
        for i, line in enumerate(own):
            lines.append(line.lower())
            before = own[i - 1].rstrip() if i else ""
            continued.append(bool(before) and before[-1] not in ".!?።:፡。！？؟፧”\"»」)'’“")
    sums = np.zeros((len(lines), BITS), dtype=np.float32)
    size = np.zeros(len(lines), dtype=np.float32)
    at = 0
    while at < len(lines):
        end, chars = at, 0
        while end < len(lines) and (chars == 0 or chars + len(lines[end]) < CHUNK):
            chars += len(lines[end]) + 2
            end += 1
        starts = np.cumsum([0, *(len(x) + 2 for x in lines[at : end - 1])])
        text = "".join(x + "  " for x in lines[at:end])
        for h in gram_hashes(text):
            h[starts[1:] - 1] = -1  # would reach into the next line
            gathered = weights[np.maximum(h, 0)]
            gathered[h < 0] = 0
            sums[at:end] += np.add.reduceat(gathered, starts, axis=0)
            size[at:end] += np.add.reduceat((h >= 0).astype(np.float32), starts)
        at = end
    follows = np.array(continued, dtype=bool)
    mixed_in = sums.copy()
    if follows.any():
        k = np.flatnonzero(follows)
        mixed_in[k] += CONTEXT * sums[k - 1]
        mixed_in[k - 1] += CONTEXT * sums[k]
    return per, mixed_in, size


def losses(margins: np.ndarray, reliability: np.ndarray) -> np.ndarray:
    """(line, language) loss of each codeword: logistic losses of the bits, weighted by their reliability."""
    code = code_matrix()
    z = np.clip(margins * TEMPERATURE, -30, 30)
    soft = np.stack([np.log1p(np.exp(-z)), np.log1p(np.exp(z))])  # for a bit of +1, of -1
    return (soft[0] * reliability) @ (code > 0).T.astype(np.float32) + (soft[1] * reliability) @ (code < 0).T.astype(np.float32)


def scored_lines(units: DataFrame, weights: np.ndarray, reliability: np.ndarray) -> DataFrame:
    """(ldu_id, doc_id, lines) with, for each line, its place, best language, confidence, a mark of its text and the share of each language."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["content"].tolist()
            per, margins, size = line_scores(texts, weights)
            loss = losses(margins, reliability)
            best = loss.argmin(1)
            gap = np.exp(np.maximum(-(loss - loss.min(1, keepdims=True)), -50))
            share = gap / gap.sum(1, keepdims=True)
            sure = np.where(size >= ENOUGH, share.max(1), 0.0)
            out, at = [], 0
            for text, n in zip(texts, per):
                own = text.split("\n")
                out.append([
                    {"no": i + 1, "best": int(best[at + i]) if size[at + i] > 0 else -1, "sure": float(sure[at + i]), "mark": zlib.crc32(own[i].strip().encode("utf-8", "replace")), "share": share[at + i].tolist()}
                    for i in range(n) if own[i].strip()
                ])
                at += n
            yield pd.DataFrame({"ldu_id": batch["ldu_id"], "doc_id": batch["doc_id"], "lines": out})

    schema = "ldu_id string, doc_id string, lines array<struct<no:int,best:int,sure:float,mark:bigint,share:array<float>>>"
    return units.select("ldu_id", "doc_id", "content").mapInPandas(score, schema)


def trained(units: DataFrame, labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights and reliabilities of the bit classifiers, from units (ldu_id, doc_id, content) and labels (doc_id, language)."""
    keys = sized(labelled.where(F.col("language").isin(LANGUAGES)).dropDuplicates(["doc_id", "language"]))
    totals = {r["language"]: r["n"] for r in units.select("doc_id").join(keys, "doc_id").groupBy("language").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return np.zeros((BUCKETS, BITS), dtype=np.float32), np.ones(BITS, dtype=np.float32)
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, MAX_UNITS / n))])
    draw = F.pmod(F.xxhash64("ldu_id"), F.lit(1_000_000)) / 1e6
    highest = max(min(1.0, MAX_UNITS / n) for n in totals.values())
    sample = units.where(draw < highest).join(keys, "doc_id").where(draw < share[F.col("language")])
    sample = staged(sample.select("ldu_id", "doc_id", "content", "language"), "language-sample")
    code = code_matrix()
    weights = bit_weights(counted(sample, "language").toPandas())
    even = np.ones(BITS, dtype=np.float32)
    first = scored_lines(sample, weights, even).select("ldu_id", F.inline("lines")).where("best >= 0")
    voted = first.groupBy("ldu_id", "best").agg(F.sum("sure").alias("s")).groupBy("ldu_id").agg(F.max_by("best", "s").alias("best"))
    names = F.array(*[F.lit(x) for x in LANGUAGES])
    clean = sample.join(voted, "ldu_id").where(F.get(names, F.col("best")) == F.col("language"))
    clean = staged(clean.select("ldu_id", "doc_id", "content", "language"), "language-clean")
    weights = bit_weights(counted(clean, "language").toPandas())

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            per, margins, size = line_scores(batch["content"].tolist(), weights)
            truth = code[np.repeat([LANGUAGES.index(x) for x in batch["language"]], per)]
            live = size > 0
            wrong = (np.sign(margins[live]) != truth[live]).sum(0)
            yield pd.DataFrame({"bit": range(BITS), "wrong": wrong, "n": int(live.sum())})

    found = clean.select("content", "language").mapInPandas(errors, "bit int, wrong bigint, n bigint").groupBy("bit").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n")).toPandas()
    rate = np.full(BITS, 0.1)
    rate[found["bit"]] = (found["wrong"] + 1) / (found["n"] + 2)
    reliability = np.log((1 - np.clip(rate, 0.001, 0.45)) / np.clip(rate, 0.001, 0.45))
    return weights, (reliability / reliability.mean()).astype(np.float32)


def name_of(index: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LANGUAGES]), index)


def verdicts(lines: DataFrame) -> DataFrame:
    """(doc_id, language, language_confidence, ambiguous, first, second) of each document.

    Lines of enough evidence name a document's languages; it is mixed if two of them each have their share of those and of
    all lines. A line that a document repeats, as pages repeat their running lines, counts once in that.
    """
    each = lines.select("doc_id", F.inline("lines"))
    sums = [F.sum(F.get("share", F.lit(i))).alias(f"s{i}") for i in range(len(LANGUAGES))]
    tally = each.groupBy("doc_id", "best").agg(F.count("*").alias("n"), F.count_if(F.col("sure") >= SURE).alias("n_sure"), *sums)
    rank = Window.partitionBy("doc_id").orderBy(F.desc("n_sure"), F.desc("n"), "best")
    ranked = tally.where("best >= 0").withColumn("rank", F.row_number().over(rank))
    top = ranked.groupBy("doc_id").agg(
        F.sum("n").alias("total"), F.sum("n_sure").alias("total_sure"),
        F.max(F.when(F.col("rank") == 1, F.struct("best", "n", "n_sure"))).alias("a"),
        F.max(F.when(F.col("rank") == 2, F.struct("best", "n", "n_sure"))).alias("b"),
        F.array(*(F.sum(f"s{i}") / F.sum("n") for i in range(len(LANGUAGES)))).alias("shares"),
    )
    top = staged(top, "language-tallies")
    enough = lambda part, whole: (F.col(part) >= MIXED_SHARE * F.col(whole)) & (F.col(part) > 0)
    likely = top.where(enough("b.n_sure", "total_sure") & enough("b.n", "total")).select("doc_id", F.col("b.best").alias("other"))
    once = lines.join(sized(likely), "doc_id").select("doc_id", "other", F.inline("lines")).where("best >= 0").dropDuplicates(["doc_id", "mark"])
    sure, other = F.col("sure") >= SURE, F.col("best") == F.col("other")
    counted = once.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(other).alias("m"), F.count_if(sure).alias("k"), F.count_if(sure & other).alias("j"))
    mixed = counted.where(enough("m", "n") & enough("j", "k")).select("doc_id", F.lit(True).alias("both"))
    top = top.join(mixed, "doc_id", "left")
    both = F.coalesce("both", F.lit(False))
    own = F.get("shares", F.col("a.best")) + F.when(both, F.get("shares", F.col("b.best"))).otherwise(0.0)
    return top.select(
        "doc_id",
        F.when(both, F.lit("mixed")).otherwise(name_of(F.col("a.best"))).alias("language"),
        own.alias("language_confidence"),
        (own < CLEAR).alias("ambiguous"),
        F.when(both, F.col("a.best")).alias("first"),
        F.when(both, F.col("b.best")).alias("second"),
    )


def identified(profiles: DataFrame, ldus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document verdicts, and (ldu_id, doc_id, seg_no, language, confidence, ambiguous) of the lines of mixed documents."""
    units = ldus.where("chunk_type = 'text' and content is not null and ldu_id is not null and doc_id is not null").select("ldu_id", "doc_id", "content")
    labels = profiles.select("doc_id", spoken(F.col("language")).alias("language")).where("doc_id is not null and language is not null")
    weights, reliability = trained(units, labels)
    lines = staged(scored_lines(units, weights, reliability), "line-languages").dropDuplicates(["ldu_id"])
    docs = staged(verdicts(lines), "document-languages")
    pair = docs.where("language = 'mixed'").select("doc_id", "first", "second")
    each = lines.join(sized(pair), "doc_id").select("ldu_id", "doc_id", "first", "second", F.inline("lines"))
    gap = F.log(F.get("share", F.col("first"))) - F.log(F.get("share", F.col("second")))  # positive: the first language is nearer
    segments = each.select(
        "ldu_id", "doc_id", F.col("no").alias("seg_no"),
        name_of(F.when(gap >= 0, F.col("first")).otherwise(F.col("second"))).alias("language"),
        (1 / (1 + F.exp(-F.abs(gap)))).alias("confidence"),
        (F.abs(gap) < GAP).alias("ambiguous"),
    )
    return docs, segments


def found(profiles: DataFrame, ldus: DataFrame) -> DataFrame:
    """(scope, item_key, seg_no, language) of profiles with a wrong or no language, and of lines of mixed documents."""
    docs, segments = identified(profiles, ldus)
    rows = profiles.where("profile_id is not null").select("profile_id", "doc_id", spoken(F.col("language")).alias("named")).dropDuplicates(["profile_id"])
    wrong = rows.join(docs.select("doc_id", "language"), "doc_id").where("language is not null and (named is null or named <> language)")
    profile = wrong.select(F.lit("profile").alias("scope"), F.col("profile_id").cast("string").alias("item_key"), F.lit(0).alias("seg_no"), "language")
    return profile.unionByName(segments.select(F.lit("ldu").alias("scope"), F.col("ldu_id").alias("item_key"), "seg_no", "language"))
