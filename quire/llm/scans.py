"""Repair of text from scanned pages: page furniture out, divided words joined, misread characters corrected.

Running lines are lines that recur at page edges of a document (misreads and numbers folded), or a title-like line
over full lines; page numbers are number lines at page edges that count up with the pages. Divided words are joined
over line and page ends, with or without their hyphen as the corpus writes them. A symmetric-delete index over the
corpus's frequency lexicon gives correction candidates, also over the words with all confusable characters folded into
one, so that words with several misreadings meet their right form; a weighted edit distance with confusion pairs
verifies them, and bigram counts choose between candidates that are left. Paragraphs are built from what remains: lines run on
unless a blank line stands between them or a line had room for the word that opens the next one.

Defined cases: null and blank texts have no lines; repeated units count once; a word whose joined form the corpus
does not know is joined without hyphen; a word without a far more frequent neighbour stays as it is, and so does a
single letter, which nothing in it tells from another; words of more than 40 letters, as of running text without
spaces, are looked up by their folded form alone; units of digital documents are not looked at. A word divided between two units ends the first one; where its rest is divided
again, it stays as it is. A unit of nothing but running lines has no paragraphs. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.chunk import BUCKET, carried
from quire.operators.keys import documents_of, shuffled, sized
from quire.session import staged

# What recognition makes of characters, as right:wrong.
CONFUSIONS = (
    "e:c a:@ i:l n:ri s:5 t:f o:0 d:cl l:1 i:1 u:ii h:b m:rn b:6 g:q li:h w:vv fi:ﬁ fl:ﬂ c:e l:i f:t 0:o 1:l 5:s rn:m "
    "é:6 é:e è:e ê:e á:a í:i ó:o ú:u ü:ii ü:u ö:o ä:a ñ:n cl:d h:li n:ii rn:m "
    "ን:ኝ ት:7 ተ:+ ር:C ል:A ለ:ሰ በ:ሰ የ:P ም:9 ነ:ኀ ስ:ሰ O:0 S:5 B:8 I:l I:1 Z:2 l:I q:g b:h"
)
DIGIT_READINGS = {"l": "1", "I": "1", "O": "0", "o": "0", "Z": "2", "S": "5", "B": "8", "b": "6"}
PAGE_WORDS = "page|pg|p|seite|página|pagina|ገጽ|ukurasa|fuula|صفحة|หน้า|第"
#: Marks that may stand around a word; those left out may be misread letters or belong to a number.
MARKS = r"[\p{P}|<>°&&[^@%#*&_\\]]+"
HYPHENS = "-‐‑¬­"

RATIO = 20  # how much more frequent a correction must be than the word it replaces
MIN_COUNT = 5  # occurrences of a word in the corpus before it corrects others
MAX_COST = 0.5

_NUMBER = r"[0-9lIOoSZBb]{1,4}"
_MARKS = r"[^\p{L}\p{Nd}]"
PAGE_LINE = rf"(?i)^{_MARKS}*(?:(?:{PAGE_WORDS}){_MARKS}{{0,3}})?({_NUMBER}|[ivxlc]{{1,8}})(?:\s*(?:of|/|de|von|sur)\s*{_NUMBER})?{_MARKS}*$"


def words_of(text: Column) -> Column:
    """The words of a text without the marks around them, in order; words run together after a stop are parted."""
    parted = F.regexp_replace(text, r"([.!?])(?<=\p{L}\p{L}[.!?])(?=\p{Lu}\p{L})|(።)(?=[ሀ-ፚ])", "$1$2 ")
    bare = F.regexp_replace(F.regexp_replace(parted, rf"{MARKS}(?=[\s፡]|$)", ""), rf"(^|[\s፡]){MARKS}", "$1")
    return F.array_remove(F.split(bare, r"[\s፡]+"), "")


FOLDS = [("n", "ri"), ("m", "rn"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("h", "li"), ("fi", "ﬁ"), ("fl", "ﬂ")]


def folded(word: Column, folds: list[tuple[str, str]] = FOLDS) -> Column:
    """The word with the confusions of several characters undone, alike for right and misread forms."""
    for right, wrong in folds:
        word = F.replace(word, F.lit(wrong), F.lit(right))
    return word


def forms(word: Column) -> Column:
    """A word as it is, and folded in either order where confusions overlap."""
    return F.array_distinct(F.array(word, folded(word), folded(word, FOLDS[::-1])))


def _classes() -> tuple[str, str]:
    """The characters that single confusions connect, and for each the one that stands for its class."""
    names: dict[str, str] = {}
    root = lambda c: c if names.setdefault(c, c) == c else root(names[c])
    singles = [p.split(":") for p in CONFUSIONS.split()] + [["h", "u"]]  # both may be read as two thin letters
    for right, wrong in singles:
        if len(right) == len(wrong) == 1:
            names[root(wrong)] = root(right)
    return "".join(names), "".join(map(root, list(names)))


CLASSES = _classes()


def wholly_folded(word: Column) -> Column:
    """The word with every confusable character in place of its class, then pairs of them as the letter they stand for."""
    word = F.translate(word, *CLASSES)
    stands = lambda x: x.translate(str.maketrans(*CLASSES))
    for right, wrong in FOLDS:
        word = F.replace(word, F.lit(stands(wrong)), F.lit(stands(right)))
    return word


def line_key(line: Column) -> Column:
    """What stays the same of a running line over pages: letters up to misreads, numbers as one sign."""
    t = F.lower(F.trim(line))
    t = F.regexp_replace(t, r"(?<![a-z\d])[zosbil]?\d[\dzosbil]*", "#")
    t = F.when(t.rlike("[ሀ-፿]"), F.translate(t, "ኝ7+cap9ኀበለስ", "ንትተርልየምነሰሰሰ")).otherwise(t)
    t = F.translate(t, "el1|fqb6@50", "ciiitghhaso")
    t = F.regexp_replace(F.regexp_replace(t, r"\bz(?=#)|(?<=#)z\b", ""), r"[#\d]+", "#")
    return F.regexp_replace(F.regexp_replace(folded(t), r"\s+", " "), r"^# | #$", "")


#: Lines of a page that may be page furniture.
EDGE = "at < 3 or at >= n_lines - 3"


def units_of(blocks: DataFrame, ldus: DataFrame, profiles: DataFrame) -> DataFrame:
    """(unit_id, kind, doc_id, pos, text) of the units of scanned and mixed documents, each once."""
    keys = sized(documents_of(profiles, "scanned_image", "mixed"))
    own = blocks.select(F.col("block_id").alias("unit_id"), F.lit("block").alias("kind"), "doc_id", "pos", "text")
    other = ldus.select(F.col("ldu_id").alias("unit_id"), F.lit("ldu").alias("kind"), "doc_id", "pos", F.col("content").alias("text"))
    both = own.unionByName(other).where(F.col("unit_id").isNotNull() & F.col("text").rlike(r"\S"))
    return both.join(keys, "doc_id", "left_semi").dropDuplicates(["unit_id"])


def lines_of(units: DataFrame) -> DataFrame:
    """One row per line that is not blank: its number, its place from the top and from the bottom, the unit's width."""
    every = F.transform(F.split("text", r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    numbered = F.filter(F.transform(every, lambda x, i: F.struct(i.alias("no"), x.alias("line"))), lambda x: x["line"] != "")
    held = units.withColumn("all", numbered)
    return held.select(
        "unit_id", "kind", "doc_id", "pos",
        F.size("all").alias("n_lines"),
        F.array_max(F.transform("all", lambda x: F.length(x["line"]))).alias("width"),
        F.posexplode("all").alias("at", "l"),
        F.col("all").alias("a"),
    ).select(
        "unit_id", "kind", "doc_id", "pos", "n_lines", "width", "at", "l.no", "l.line",
        F.when((F.col("kind") == "ldu") | F.expr(EDGE), line_key(F.col("l.line"))).alias("key"),
        F.when(F.expr(EDGE), F.get("a", F.col("at") + 1)["line"]).alias("below"),
    )


def furniture(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The running lines (doc_id, key) and page-number lines (doc_id, number_text) of each document, from its pages."""
    edge = lines.where("kind = 'block'").where(EDGE)
    number = F.regexp_extract("line", PAGE_LINE, 1)
    edge = edge.withColumn("number", F.when(F.col("line").rlike(PAGE_LINE) & ~F.col("line").rlike(r"[.,;:。።]$"), number)).withColumn("top", F.col("at") < 3)
    digits = F.translate("number", "".join(DIGIT_READINGS), "".join(DIGIT_READINGS.values()))
    marked = F.regexp_replace("line", _NUMBER, "").rlike(r"[^\s\d]")
    pages = edge.where("number is not null").select(
        "doc_id", "pos", "line", "at", "n_lines", "number",
        digits.try_cast("int").alias("value"),
        (marked & F.col("line").rlike(r"\d|l")).alias("marked"),
        F.col("number").rlike("(?i)^[ivxlc]+$").alias("roman"),
    )
    apart = pages.withColumn("offset", F.col("value") - F.col("pos"))
    offsets = apart.where("offset is not null").groupBy("doc_id", "offset").agg(F.countDistinct("pos").alias("n"))
    usual = offsets.groupBy("doc_id").agg(F.max_by(F.struct("offset", "n"), F.struct("n", -F.col("offset"))).alias("u")).select("doc_id", F.col("u.offset").alias("usual"), F.col("u.n").alias("often"))
    judged = apart.join(usual, "doc_id", "left")
    first = (F.col("at") < 2) | (F.col("at") == F.col("n_lines") - 1)
    counts_up = (F.col("offset") == F.col("usual")) & ((F.col("often") > 1) | (F.col("value") < 1000) & first)
    misread = (F.length("number") <= 3) & F.col("number").rlike("[lIOoSZBb]") & first
    is_page = F.coalesce(F.col("marked") & first, F.lit(False)) | F.coalesce(counts_up & first, F.lit(False)) | (F.col("roman") & first) | misread
    page_lines = judged.where(is_page).select("doc_id", "line").distinct()
    rest = edge.join(page_lines.withColumn("is_page", F.lit(True)), ["doc_id", "line"], "left").where("is_page is null and length(line) > 2 and key rlike '[^# ]'")
    again = rest.groupBy("doc_id", "key").agg(F.countDistinct("pos").alias("n"), F.max(F.col("line").rlike(r"[.!?።。,;:]$").cast("int")).alias("ends"))
    recurring = again.where("n >= 2 and ends = 0").select("doc_id", "key")
    spare = F.length("line") + 1 + F.length(F.regexp_extract("below", r"^(\S+)", 1))
    spaced = ~F.col("line").rlike(r"[\u0E00-\u0E7F\u3040-\u30FF\u4E00-\u9FFF]")
    short = F.when(spaced, spare < F.col("width") - 1).otherwise(F.length("line") < 0.75 * F.col("width"))
    title = rest.where("top and at < 2 and below is not null").where(
        ~F.col("line").rlike(rf"[.!?።。，、,;:፡{HYPHENS}”\"»]$") & short & F.col("line").rlike(r"^[\p{Lu}\p{Lo}\p{Nd}]|\d[/\d]*$|\|| – ") & (F.col("n_lines") > 3)
    )
    return recurring.unionByName(title.select("doc_id", "key")).distinct(), page_lines


def body(lines: DataFrame, running: DataFrame, page_lines: DataFrame) -> DataFrame:
    """The lines with what they are: 'running', 'page_no' or null for text."""
    marked = lines.join(running.withColumn("is_running", F.lit(True)), ["doc_id", "key"], "left")
    marked = marked.join(page_lines.withColumn("is_page", F.lit(True)), ["doc_id", "line"], "left")
    edge = F.col("line").rlike(r"\D") | (F.col("kind") == "ldu") | (F.col("at") < 2) | (F.col("at") == F.col("n_lines") - 1)
    what = F.when(F.col("is_page") & edge, "page_no").when(F.col("is_running"), "running")
    marked = marked.select("unit_id", "kind", "doc_id", "pos", "no", "line", what.alias("what"))
    return marked.withColumn("w", F.when(F.col("what").isNull(), words_of(F.col("line"))))


def divided(text_lines: DataFrame) -> DataFrame:
    """(unit_id, no, head, tail, tail_unit, tail_no, token) of each word divided at the end of line `no`.

    The rest may open the document's next unit; token is all that stands before the first space there.
    """
    broken = rf"(?:^|[\s(“«\"'])([^\s(“«\"']*\p{{L}})[{HYPHENS}]$"
    opening = F.regexp_extract("line", r"^([\p{L}\p{M}'’\-]+)", 1)
    rows = text_lines.select("unit_id", "kind", "doc_id", "pos", "no", F.regexp_extract("line", broken, 1).alias("head"), opening.alias("open"), F.regexp_extract("line", r"^[^\s፡]+", 0).alias("token"))
    here = Window.partitionBy("unit_id").orderBy("no")
    rows = rows.withColumn("tail", F.lead("open").over(here)).withColumn("tail_no", F.lead("no").over(here)).withColumn("first", F.row_number().over(here) == 1)
    edges = rows.where("first or tail is null").groupBy("kind", "doc_id", "pos", "unit_id").agg(
        *[F.max(F.when(F.col("first"), F.col(c))).alias(to) for c, to in (("open", "open"), ("no", "first_no"), ("token", "token"))],
        *[F.max(F.when(F.col("tail").isNull(), F.col(c))).alias(c) for c in ("head", "no")],
    )
    # the first line of the next unit, over buckets of positions, as a document may hold many units
    opens = F.struct(F.col("open").alias("tail"), F.col("unit_id").alias("tail_unit"), F.col("first_no").alias("tail_no"), "token")
    placed = edges.select(
        F.concat_ws(" ", "kind", "doc_id").alias("doc_id"), F.struct("pos", "unit_id").alias("seq"), F.coalesce(F.floor(F.col("pos") / BUCKET), F.lit(-1)).alias("bucket"), "unit_id", "no", "head", opens.alias("opens")
    )
    onward = carried(shuffled(staged(placed, "unit-edges")), {"after": F.col("opens")}, back=True, strict=True).select("unit_id", "no", "head", "after.*").select("unit_id", "no", "head", "tail", "tail_unit", "tail_no", "token")
    within = rows.where("tail is not null").select("unit_id", "no", "head", "tail", F.col("unit_id").alias("tail_unit"), "tail_no", F.lit("").alias("token"))
    split = within.unionByName(onward).where("head <> '' and tail <> ''")
    same_case = F.col("tail").rlike(r"^\p{Ll}|^\p{Lo}") | (F.col("head").rlike(r"\p{Lu}$") & F.col("tail").rlike(r"^\p{Lu}"))
    return split.where(same_case).distinct()


def corpus_words(ldus: DataFrame) -> DataFrame:
    """(w): the words of each unit of the corpus, in order."""
    return ldus.where("content is not null").select(words_of(F.col("content")).alias("w"))


def lexicon(corpus: DataFrame) -> DataFrame:
    """(word, n) of all words of the corpus."""
    return corpus.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def deletes(word: Column) -> Column:
    """What a word is looked up by: each form of it, what becomes of that by one deletion, and its folded form, marked by a =."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    near = F.flatten(F.transform(forms(word), lambda w: F.concat(F.array(w), cut(w))))
    return F.array_distinct(F.concat(F.when(F.length(word) <= 40, near).otherwise(F.array(word)), F.array(F.concat(F.lit("="), wholly_folded(word)))))


def _by_start() -> dict[str, list[tuple[str, str]]]:
    table: dict[str, list[tuple[str, str]]] = {}
    for pair in CONFUSIONS.split():
        right, wrong = pair.split(":")
        table.setdefault(right[0], []).append((right, wrong))
    return table


PAIRS = _by_start()
STRAY = set("@%#*&_\\^~")  # characters that stand within no word


def misread_cost(wrong: str, right: str, most: float = 2.0) -> float:
    """Weighted edit distance: a confusion pair costs 0.2, a stray sign 0.4 and any other change 1; 99 where it is beyond `most`."""
    n, m = len(right), len(wrong)
    best = {(0, 0): 0.0}
    for i in range(n + 1):
        for j in range(m + 1):
            c = best.pop((i, j), None)
            if c is None or c > most:
                continue
            if i == n and j == m:
                return c
            steps = []
            if i < n:
                if j < m and right[i] == wrong[j]:
                    steps.append((i + 1, j + 1, c))
                steps += [(i + len(r), j + len(w), c + 0.2) for r, w in PAIRS.get(right[i], ()) if right.startswith(r, i) and wrong.startswith(w, j)]
            if j < m and wrong[j] in STRAY:
                steps.append((i, j + 1, c + 0.4))
            if c + 1 <= most:
                steps += [(i + di, j + dj, c + 1) for di, dj in ((1, 1), (1, 0), (0, 1)) if i + di <= n and j + dj <= m]
            for x, y, cost in steps:
                if cost <= most and cost < best.get((x, y), 99.0):
                    best[x, y] = cost
    return 99.0


def corrections(types: DataFrame, known: DataFrame) -> DataFrame:
    """(word, right, n, cost) of the corrections of distinct words (word, own); a word may have several."""
    lettered = F.col("word").rlike(r"\p{L}") & (F.length("word") >= 2)
    index = known.where((F.col("n") >= MIN_COUNT) & ~F.col("word").rlike(r"[\d@+]")).where(lettered)
    index = index.select(F.col("word").alias("right"), "n", F.explode(deletes(F.col("word"))).alias("part"))
    asked = types.where(lettered).select("word", "own", F.explode(deletes(F.col("word"))).alias("part"))
    pairs = asked.join(shuffled(index), "part").where((F.col("n") >= RATIO * F.col("own")) & (F.col("word") != F.col("right"))).select("word", "right", "n").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cost=[misread_cost(w, r, MAX_COST) for w, r in zip(batch["word"], batch["right"])])

    return pairs.mapInPandas(verify, "word string, right string, n bigint, cost double").where(f"cost <= case when length(word) < 6 then {MAX_COST} / 2 else {MAX_COST} end")


def number_read(word: Column) -> Column:
    """The number that a word of digits with misread ones states; null for any other word."""
    plain = F.translate(word, "".join(DIGIT_READINGS), "".join(DIGIT_READINGS.values()))
    misread = word.rlike(r"^(?=.*\d)(?=.*[lIOoZSBb])[\dlIOoZSBb.,]+%?$") & (F.regexp_count(word, F.lit(r"\d")) * 2 >= F.regexp_count(word, F.lit("[lIOoZSBb]")))
    return F.when(misread & plain.rlike(r"^(?:\d{1,3}(?:[,.]\d{3})+|\d+)(?:[.,]\d+)?%?$") & (F.length(word) > 1), plain)


def resolved(words: DataFrame, fixes: DataFrame, corpus: DataFrame) -> DataFrame:
    """words (unit_id, no, at, before, word, after) that have corrections: (unit_id, no, at, word, right), right being the one that holds.

    Where several are left, the counts of the word pairs that they would make with their neighbours choose.
    """
    ranked = fixes.withColumn("left", F.count("*").over(Window.partitionBy("word")))
    sure = words.join(sized(ranked.where("left = 1").select("word", "right")), "word").select("unit_id", "no", "at", "word", "right")
    open_ = staged(words.join(sized(ranked.where("left > 1").select("word", "right", "n", "cost")), "word"), "open-words")
    asked = open_.select(F.concat_ws(" ", "before", "right").alias("pair")).unionByName(open_.select(F.concat_ws(" ", "right", "after").alias("pair"))).distinct()
    pairs = corpus.select(F.explode(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))).alias("pair"))
    seen = staged(pairs.join(sized(staged(asked, "asked-pairs")), "pair", "left_semi").groupBy("pair").agg(F.count("*").alias("seen")), "seen-pairs")
    seen = sized(seen)
    scored = (
        open_.join(seen.withColumnRenamed("seen", "s1"), F.concat_ws(" ", "before", "right") == F.col("pair"), "left").drop("pair")
        .join(seen.withColumnRenamed("seen", "s2"), F.concat_ws(" ", "right", "after") == F.col("pair"), "left")
    )
    worth = F.log1p(F.coalesce("s1", F.lit(0))) + F.log1p(F.coalesce("s2", F.lit(0))) + 0.3 * F.log("n") - 2 * F.col("cost")
    chosen = scored.groupBy("unit_id", "no", "at", "word").agg(F.max_by("right", F.struct(worth, "right")).alias("right"))
    return sure.unionByName(chosen)


def repaired(blocks: DataFrame, ldus: DataFrame, profiles: DataFrame) -> dict[str, DataFrame]:
    """The tables of defects: `line` (unit_id, what, line), `hyphen` (unit_id, fragment) and `ocr` (unit_id, fragment).

    And what the texts are rebuilt from: `marked`, the lines with what they are, `joined`, the divided words with the
    whole word as `right`, and `placed` (unit_id, no, at, word, right), the misread words by line and character.
    """
    lines = staged(lines_of(units_of(blocks, ldus, profiles)), "scan-lines")
    running, page_lines = furniture(lines)
    marked = staged(body(lines, sized(staged(running, "running-lines")), sized(staged(page_lines, "page-lines"))), "marked-lines")
    text_lines = marked.where("what is null")
    corpus = staged(corpus_words(ldus), "corpus-words")
    known = staged(lexicon(corpus), "lexicon")

    parted = staged(divided(text_lines), "divided-words")
    forms = parted.select("head", "tail").distinct().withColumn("plain", F.concat("head", "tail")).withColumn("kept", F.concat("head", F.lit("-"), "tail"))
    counted = forms.join(shuffled(known).select(F.col("word").alias("plain"), F.col("n").alias("n_plain")), "plain", "left").join(shuffled(known).select(F.col("word").alias("kept"), F.col("n").alias("n_kept")), "kept", "left")
    whole = counted.select("head", "tail", F.when(F.coalesce("n_kept", F.lit(0)) > F.coalesce("n_plain", F.lit(0)), F.col("kept")).otherwise(F.col("plain")).alias("fragment"))
    whole = staged(whole, "whole-words")
    hyphen = parted.join(sized(whole), ["head", "tail"]).select("unit_id", "fragment").distinct()

    broken = F.col("line").rlike(rf"\p{{L}}[{HYPHENS}]$")
    own = text_lines.select("unit_id", "no", "line", F.when(broken, F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).otherwise(F.col("w")).alias("w"))
    types = own.select(F.explode("w").alias("word")).unionByName(whole.select(F.col("fragment").alias("word"))).distinct()
    types = types.join(shuffled(known), "word", "left").select("word", F.coalesce("n", F.lit(1)).alias("own"), number_read(F.col("word")).alias("number"))
    types = staged(types, "scan-words")
    fixes = staged(corrections(types.where("number is null"), known), "corrections")
    wrong = fixes.select("word").distinct().unionByName(types.where("number is not null").select("word"))
    i = F.col("i")
    placed = own.select("unit_id", "no", "line", "w", F.posexplode("w").alias("i", "word")).join(sized(staged(wrong, "wrong-words")), "word", "left_semi")
    # words stand in the line in their order, with marks between them: each is looked for behind the one before
    end = F.aggregate(F.slice("w", 1, i + 1), F.lit(1), lambda acc, x: F.call_function("locate", x, F.col("line"), acc) + F.length(x))
    placed = placed.select("unit_id", "no", (end - 1 - F.length("word")).alias("at"), F.get("w", i - 1).alias("before"), "word", F.get("w", i + 1).alias("after"))
    placed = staged(placed, "misread-words")
    numbers = placed.select("unit_id", "no", "at", "word", number_read(F.col("word")).alias("right")).where("right is not null")
    tails = parted.select(F.col("tail_unit").alias("unit_id"), F.col("tail").alias("word")).distinct()
    right = resolved(placed, fixes, corpus)
    ocr = right.join(shuffled(tails), ["unit_id", "word"], "left_anti").unionByName(numbers.select(*right.columns))
    best = fixes.groupBy(F.col("word").alias("fragment")).agg(F.max_by("right", F.struct(-F.col("cost"), "n", "right")).alias("better"))
    joined = whole.join(shuffled(best), "fragment", "left").select("head", "tail", F.coalesce("better", "fragment").alias("right"))
    return {
        "marked": marked,
        "joined": parted.join(shuffled(joined), ["head", "tail"]),
        "placed": right.unionByName(numbers.select(*right.columns)),
        "line": marked.where("what is not null").select("unit_id", "what", "line"),
        "hyphen": hyphen,
        "ocr": ocr.select("unit_id", F.col("right").alias("fragment")),
    }


def found(blocks: DataFrame, ldus: DataFrame, profiles: DataFrame) -> DataFrame:
    """(unit_id, defect, fragment) of all defects, each once."""
    t = repaired(blocks, ldus, profiles)
    rows = t["line"].select("unit_id", F.col("what").alias("defect"), F.col("line").alias("fragment"))
    for defect in ("hyphen", "ocr"):
        rows = rows.unionByName(t[defect].select("unit_id", F.lit(defect).alias("defect"), "fragment"))
    return rows.distinct()


ENDS = tuple(".!?።。؟！？:;…\"”»）)」』")
UNSPACED = re.compile(r"[\u0E00-\u0E7F\u3000-\u30FF\u4E00-\u9FFF\uFF00-\uFFEF]")


def _room(line: str, following: str, width: int) -> bool:
    """Whether the line stops so early that the text was not merely wrapped there."""
    if UNSPACED.search(line):
        return len(line) < (width - 1 if line.endswith(ENDS) else 0.75 * width)
    needed = len(line) + 1 + len(following.split(None, 1)[0])
    return needed < width - 1 if line.endswith(ENDS) else needed < 0.75 * width


def _glue(line: str, following: str) -> str:
    """What stands between two lines that run on."""
    if re.search(rf"[^\W_][{HYPHENS}]$", line):
        return ""
    if UNSPACED.search(line) and UNSPACED.search(following) and (UNSPACED.match(line[-1]) or UNSPACED.match(following[0]) or line[-1].isdigit() or following[0].isdigit()):
        return ""
    return " "


def paragraphs_of(lines: list[dict], fixes: list[dict], joins: list[dict], gone: list[dict]) -> list[str]:
    """The paragraphs of one unit.

    lines (no, line, what); fixes (no, at, n, right): n characters of a line that are `right`; joins (no, head, tail,
    tail_no, token, right): words divided at the end of line `no`, tail_no null where the rest opens the next unit;
    gone (no, n): characters at the start of a line that the unit before ends with.
    """
    lines = sorted(lines, key=lambda x: x["no"])
    text = {x["no"]: x["line"] for x in lines if x["what"] is None}
    if not text:
        return []
    width, stored, follows = max(map(len, text.values())), dict(text), set()
    opened = {j["tail_no"] for j in joins} | {g["no"] for g in gone}
    for f in sorted(fixes, key=lambda x: -x["at"]):
        if f["at"] > 0 or f["no"] not in opened:
            old = text[f["no"]]
            text[f["no"]] = old[: f["at"]] + f["right"] + old[f["at"] + f["n"] :]
    for j in joins:
        head, tail, line = j["head"], j["tail"], text[j["no"]]
        if j["tail_no"] is None:
            text[j["no"]] = line[: len(line) - len(head) - 1] + j["right"] + j["token"][len(tail) :]
            continue
        follows.add(j["tail_no"])
        if tail[-1] in HYPHENS or (j["no"] in opened and len(head) + 1 == len(stored[j["no"]])):
            text[j["no"]] = line[:-1]  # a word over three lines
        elif j["right"].endswith(tail):
            text[j["no"]] = line[: len(line) - len(head) - 1] + j["right"][: len(j["right"]) - len(tail)]
        else:
            text[j["no"]] = line[: len(line) - len(head) - 1] + j["right"]
            text[j["tail_no"]] = text[j["tail_no"]][len(tail) :]
    for g in gone:
        text[g["no"]] = text[g["no"]][g["n"] :].lstrip(" \t፡")
    out: list[str] = []
    last, furniture = None, False
    for x in lines:
        no = x["no"]
        if x["what"] is not None:
            furniture = True
            continue
        if not text[no]:
            continue
        if last is None:
            out.append(text[no])
        elif no in follows:
            out[-1] += text[no]
        elif (no > last + 1 and not furniture) or _room(stored[last], stored[no], width):
            out.append(text[no])
        else:
            out[-1] += _glue(out[-1], text[no]) + text[no]
        last, furniture = no, False
    return out


def paragraphs(blocks: DataFrame, ldus: DataFrame, profiles: DataFrame) -> DataFrame:
    """(unit_id, paragraph_no, text): the repaired texts of all units, paragraphs counted from 1."""
    t = repaired(blocks, ldus, profiles)
    lines = t["marked"].groupBy("unit_id").agg(F.collect_list(F.struct("no", F.when(F.col("what").isNull(), F.col("line")).alias("line"), "what")).alias("lines"))
    fixes = t["placed"].groupBy("unit_id").agg(F.collect_list(F.struct("no", "at", F.length("word").alias("n"), "right")).alias("fixes"))
    own = F.col("unit_id") == F.col("tail_unit")
    parted = staged(t["joined"].where(own | ~F.col("tail").rlike(f"[{HYPHENS}]$")), "joined-words")
    joins = parted.groupBy("unit_id").agg(F.collect_list(F.struct("no", "head", "tail", F.when(own, F.col("tail_no")).alias("tail_no"), "token", "right")).alias("joins"))
    gone = parted.where(~own).groupBy(F.col("tail_unit").alias("unit_id")).agg(F.collect_list(F.struct(F.col("tail_no").alias("no"), F.length("token").alias("n"))).alias("gone"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for unit, *parts in zip(*[batch[c] for c in ("unit_id", "lines", "fixes", "joins", "gone")]):
                rows += [(unit, k, text) for k, text in enumerate(paragraphs_of(*[[] if x is None else list(x) for x in parts]), 1)]
            yield pd.DataFrame(rows, columns=["unit_id", "paragraph_no", "text"])

    units = lines.join(shuffled(fixes), "unit_id", "left").join(shuffled(joins), "unit_id", "left").join(shuffled(gone), "unit_id", "left")
    return units.mapInPandas(build, "unit_id string, paragraph_no int, text string")
