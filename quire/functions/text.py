"""Column functions on text that the stages share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, as they must be for equal results.
HEADING = r"^(\d+[\.\d]*\.?\s+[A-Z].{3,80}|[A-Z][A-Z\s,&/:\-()]{5,79})$"
CAPTION = r"(?i)^(Figure|Fig\.?|Table|Exhibit|Chart)\s*\d+"
TITLE = r"^[A-Z][A-Za-z0-9\s,&/\-()]{3,}$"
CROSS_REFERENCE = r"(?i)\b(?:see|refer to|as shown in|cf\.?|table|figure|fig\.?|equation|section)\s+(?:[A-Z]?\d+(?:\.\d+)*|[A-Z])"
FACT = r"(?i)([A-Za-z][A-Za-z\s\-/]{2,40})\s*[:=]\s*([\$£€]?[\d,\.]+\s*(?:million|billion|thousand|B|M|K|%)?)"
MONEY_FACT = r"(?i)([A-Za-z0-9][A-Za-z0-9\s\-/]{1,30})\s+([\$£€][\d,\.]+\s*(?:million|billion|B|M|K)?)"
FACT_UNITS = ["million", "billion", "thousand", "B", "M", "K", "%", "$", "£", "€"]
NAME = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?: [A-Z][a-z]+)+"
FIGURE_VALUE = r"(?i)\$[\d,\.]+\s*(?:million|billion|B|M|K)?|\d[\d,\.]*%"
UNCERTAIN = r"\bunknown\b|\bunsure\b|\bcannot\b"
NUMBER_TOPIC = r"(?i)\b(?:revenue|profit|loss|expenditure|total|amount|cost|budget|income|tax|rate|ratio|value|year|quarter|q\d)\b"

SPACE = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(text: Column) -> Column:
    """Without white space of any script around it; null stays null."""
    return F.btrim(text, F.lit(SPACES))


def shortened(text: Column, size: int = 180) -> Column:
    """On one line, and with an ellipsis as its last character where it is longer than size."""
    flat = F.replace(stripped(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    cut = F.concat(F.regexp_replace(F.substring(flat, 1, size - 1), f"{SPACE}+$", ""), F.lit("…"))
    return F.when(F.length(flat) > size, cut).otherwise(flat)


def word_count(text: Column) -> Column:
    bare = stripped(F.coalesce(text, F.lit("")))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"{SPACE}+")))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def is_upper(text: Column) -> Column:
    """Some letter, and none of them lower case."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def heading_level(title: Column) -> Column:
    """1 to 4 by numbering, capitals or a short title; null for other texts."""
    t = stripped(title)
    dots = F.length(F.regexp_replace(F.split(t, " ")[0], r"[^.]", ""))
    return (
        F.when(t.rlike(r"^\d+\.\s"), F.least(dots + 1, F.lit(4)))
        .when(is_upper(t) & (F.length(t) > 3) & (F.length(t) < 80), 1)
        .when((F.length(t) < 80) & t.rlike(r"^\p{Lu}") & ~t.endswith("."), 2)
        .cast("int")
    )


def entities(text: Column, most: int = 8) -> Column:
    """Names of several words, then money and percentages, each once, at most `most`."""
    names = F.regexp_extract_all(text, F.lit(NAME), F.lit(0))
    return F.slice(F.array_distinct(F.concat(names, F.regexp_extract_all(text, F.lit(FIGURE_VALUE), F.lit(0)))), 1, most)


def summary(text: Column, size: int = 300) -> Column:
    """The first sentences longer than 20 characters until `size` characters are reached."""
    sentences = F.split(stripped(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+")
    grown = F.aggregate(sentences, F.lit(""), lambda acc, s: F.when((F.length(acc) < size) & (F.length(s) > 20), F.concat(acc, s, F.lit(" "))).otherwise(acc))
    return F.substring(stripped(grown), 1, size)


def cross_references(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CROSS_REFERENCE), F.lit(0)))
