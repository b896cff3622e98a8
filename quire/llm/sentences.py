"""Sentence units of texts in any of the corpus's languages and scripts, by SQL expressions alone.

Marks that end no sentence (in decimals, URLs, initials, abbreviations, list numbers and quotations) are masked by
a private-use character, one for one, so that offsets stay those of the text. Script-specific terminators then
split the masked text, and the sentences are read from the original at the same offsets.

Defined cases: a null, empty or blank text has no sentences; a text without any terminator is one sentence;
a text may be of any length; line breaks count as spaces, but a blank line ends a sentence; a closing bracket or
quote belongs to the sentence before it, an opening one or a list mark to the sentence after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Private-use characters: a mark that ends nothing, opening and closing straight quotes, and the end of a sentence.
MASK, OPEN, CLOSE, CUT = "\ue000", "\ue010", "\ue011", "\ue0ff"
WS = r"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]"

# Abbreviations by how they bind.
TITLES = "vgl mr mrs ms dr prof sr sra srta dra dkt mme mlle hr ing eng rev hon gen col capt st bi bw ob obbo adde"
BEFORE_NUMBERS = (
    "no nos nr nro núm num na lakk fig figs abb sec secs art arts para paras par al abs ch chap vol p pp pág págs uk ukr "
    "kif § vs ca env approx aprox cf circa jan feb mar apr jun jul aug sep sept oct nov dec eq tab tabl anx ref max min"
)
GERMAN_MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
CAPITALS_INSIDE = "INCL|INS|ETC|E.G|I.E|U.N|VS|APPROX|BZW|USW"


def _any(words: str) -> str:
    return "|".join(words.split())


#: A full stop that ends nothing. Each way starts at the stop itself, so that only stops are looked at.
INNER_STOP = (
    r"\.(?:"
    r"(?=[\p{Ll}\p{Nd}])"  # decimals, versions, host names, e.g.
    r"|(?<=(?<![\p{L}\p{N}]|\p{Nd} )\p{Lu}\.)"  # initials, but not the unit of a number
    rf"|(?<=(?<![\p{{L}}\p{{N}}.{MASK}'’]|\p{{Nd}} )\p{{Ll}}\.)(?={WS}*(?:\p{{Nd}}|\p{{Lu}}\.))"  # z. B., p. 4, c. 90
    r"|(?<=(?<![\p{L}\p{N}])\p{Lo}\.)"  # single letters of scripts without case
    r"|(?<=[฀-๿]\.)(?=[฀-๿])"
    rf"|(?<=(?<![\p{{L}}\p{{N}}])(?i:{_any(TITLES)})\.)(?={WS}+\p{{L}})"
    rf"|(?<=(?<![\p{{L}}\p{{N}}])(?iu:{_any(BEFORE_NUMBERS)})\.)(?={WS}*\p{{Nd}})"
    rf"|(?<=\p{{Nd}}\.)(?={WS}+(?:{GERMAN_MONTHS})\b)"
    r")"
)
LIST_STOP = rf"\.(?={WS})(?<=(?:^{WS}{{0,3}}|[.!?;:։።。)”»{CLOSE}]{WS}{{1,3}})\p{{Nd}}{{1,2}}\.)"
CAPITAL_STOP = (
    rf"\.(?:(?<=(?<!\p{{L}})(?:{CAPITALS_INSIDE.replace('.', f'[.{MASK}]')})\.)"
    rf"|(?<=(?<!\p{{L}})(?:INC|LTD|CO|CORP)\.)(?={WS}+(?:AND|OR|UNDER|FOR|WITH|TO|OF)\b)"
    rf"|(?<=[AP][.{MASK}]M\.)(?={WS}+(?:AND|OR|TO|ON EACH)\b)|(?<=\.\.)(?={WS}+(?:AND|OR|BUT)\b)|(?=\.))"
)
OPENERS, CLOSERS = f"“«„「『{OPEN}", f"”»」』{CLOSE}"
#: A text in pieces, each up to the next quotation mark; and in a piece that is a quotation, the marks that do not end it,
#: as the closing mark follows others only, and spaces between letters of a script that parts sentences by spaces.
QUOTE_PIECE = f"[^{OPENERS}{CLOSERS}]*+[{OPENERS}{CLOSERS}]|[^{OPENERS}{CLOSERS}]++"
QUOTED_MARK = rf"[.!?؟።፧。！？:፡](?![:፡]?\s?[{CLOSERS}])|(?<=[฀-๿]){WS}(?={WS}*[฀-๿])"

_QUOTE = rf"[”»{CLOSE}]"
_NEXT = rf"(?={WS}+[^\p{{Ll}}\s,;:–—)\]»”{CLOSE}]|[\p{{Lu}}¿¡“«„({OPEN}])"
_NEXT_QUOTED = rf"(?={WS}+[\p{{Lu}}\p{{Nd}}¿¡“«„({OPEN}]|\p{{Lu}})"
_ETHIOPIC = r"(?:[።፧፨]|፡፡|::)"
BOUNDARY = "|".join(
    [
        rf"[.!?؟…]+[)\]’']*{_NEXT}",
        rf"[.!?؟…]+[)\]’']*\s?{_QUOTE}[)\]]*{_NEXT_QUOTED}",
        rf"[.!?…]+(?<=\p{{Ll}}[.!?…]{{1,3}})\s?{_QUOTE}[)\]]*(?={WS}+\p{{Lo}})",
        r"[!?]+(?=[ሀ-ፚ])",
        rf"{_ETHIOPIC}+[)\]]*(?={WS}*[^\s”»)\]{CLOSE}])",
        rf"{_ETHIOPIC}+{_QUOTE}{_NEXT_QUOTED}",
        rf"[。！？｡]+[）)]*(?={WS}*[^\s”』」»）){CLOSE}])",
        rf"[。！？｡]+[”』」»{CLOSE}]+[）)]*(?={WS}*[^\sとっのはがをに、，,。\p{{Ll}}])",
    ]
)
THAI = r"[฀-๿]"
THAI_BOUNDARY = rf"({THAI})(?={WS}+{THAI}|{WS}*\n{WS}*\p{{Lu}})"
BLANK_LINE = r"(\S)(?=[ \t]*\r?\n[ \t]*\r?\n)"


def quotations_masked(t: Column) -> Column:
    """The text with the marks masked that end no sentence since a quotation goes on after them, however long it is.

    A piece is a quotation if it ends with a closing mark and the mark before it opens one, or closes one of another kind.
    """
    pieces = F.regexp_extract_all(t, F.lit(QUOTE_PIECE), F.lit(0))

    def piece(p: Column, before: Column) -> Column:
        mark = F.right(before, F.lit(1))
        quoted = p.rlike(f"[{CLOSERS}]$") & (mark.isin(*OPENERS) | (mark.isin(*CLOSERS) & (mark != F.right(p, F.lit(1)))))
        return F.when(quoted, F.regexp_replace(p, QUOTED_MARK, MASK)).otherwise(p)

    return F.array_join(F.zip_with(pieces, F.concat(F.array(F.lit("")), pieces), piece), "")


def masked(text: Column) -> Column:
    """The text, as long as before, without marks that end no sentence."""
    text = F.when(text.contains(CUT), F.translate(text, CUT, MASK)).otherwise(text)
    t = F.when(
        text.contains('"'),
        F.translate(F.regexp_replace(text, rf'(?<![^\s(\[])"(?=\S)', OPEN), '"', CLOSE),
    ).otherwise(text)
    t = F.when(text.contains("„"), F.regexp_replace(t, r"(„[^„“”]*+)“", f"$1{CLOSE}")).otherwise(t)
    t = F.when(t.rlike(f"[{CLOSERS}]"), quotations_masked(t)).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, INNER_STOP, MASK), LIST_STOP, MASK)
    return F.when(~text.rlike(r"\p{Ll}"), F.regexp_replace(t, CAPITAL_STOP, MASK)).otherwise(t)


def spans(text: Column) -> Column:
    """array<struct<start_char, end_char>> of the sentences, in code points from 0, without space around them."""
    t = F.regexp_replace(masked(text), BOUNDARY, f"$0{CUT}")
    t = F.when(text.rlike(THAI), F.regexp_replace(t, THAI_BOUNDARY, f"$1{CUT}")).otherwise(t)
    t = F.when(text.contains("\n"), F.regexp_replace(t, BLANK_LINE, f"$1{CUT}")).otherwise(t)
    pieces = F.split(t, CUT)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start_char:int,end_char:int>>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        left = F.length(F.regexp_replace(piece, f"^{WS}+", ""))
        size = F.length(F.regexp_replace(piece, f"{WS}+$", ""))
        begin = acc["at"] + F.length(piece) - left
        span = F.struct(begin.cast("int").alias("start_char"), (acc["at"] + size).cast("int").alias("end_char"))
        found = F.when(left > 0, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(piece)).cast("int").alias("at"), found.alias("found"))

    return F.aggregate(pieces, start, step, lambda acc: acc["found"])


def sentences(units: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence_no, start_char, end_char, sentence) of each unit; units with the same key count once."""
    found = units.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text, spans(F.col(text)).alias("found"))
    each = found.dropDuplicates([key]).select(key, text, F.posexplode("found"))
    cut = F.substring(F.col(text), F.col("col.start_char") + 1, F.col("col.end_char") - F.col("col.start_char"))
    return each.select(key, (F.col("pos") + 1).alias("sentence_no"), "col.*", cut.alias("sentence"))


def sentence_spans(units: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_char, end_char) only: the shuffle that drops repeated units carries offsets in place of texts."""
    found = units.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, spans(F.col(text)).alias("found"))
    return found.dropDuplicates([key]).select(key, F.inline("found"))
