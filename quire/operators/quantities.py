"""Quantities written in many notations, converted to the common unit of their measure.

A fact's unit is looked for in its value, its unit column, its field name, the text after the value in the
source unit, and the title of the source table, in this order; the first place that names a unit holds, and a
multiplier counts once, from the first place that has one. Texts are read only for facts whose own columns name no
unit. The distinct spellings found are mapped to unit symbols through an inverted index of character n-grams whose
candidates a weighted edit distance verifies; the resulting alias dictionary is joined to all rows.

Units that the reference lacks take part in the index as decoys: a spelling nearer to one of them (sq mi, terawatt-hour,
millimetre, Mt) names nothing, nor does one that is equally near to two units.

Defined cases, each counted by `readings`: rows whose value is null ('no value'), is no number or states several
('no single number'), carries words that are no unit ('other words'), counts without a unit ('no unit') and values of
more than 29 integer digits or beyond bigint thousandths ('too large') are not converted; decimals count to the ninth
place. Repeated rows of an id count once, rows without an id not at all. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.keys import sized
from quire.session import staged

# Usual names and abbreviations of the reference's unit symbols, without plurals and misspellings.
UNIT_NAMES = {
    "ETB": "ETB, birr, Br, Ethiopian birr, ብር, ቅርሺ",
    "USD": "USD, US$, $, dollar, US dollar, ዶላር",
    "EUR": "EUR, €, euro",
    "GBP": "GBP, £, pound, pound sterling",
    "kg": "kg, kilogram, kilogramme, kilo",
    "g": "g, gram, gramme",
    "t": "t, tonne, metric ton, MT",
    "quintal": "quintal, qt, qtl",
    "m2": "m2, sq m, sqm, square metre, square meter",
    "ha": "ha, hectare, hect",
    "km2": "km2, sq km, square kilometre, square kilometer",
    "acre": "acre, ac",
    "m": "m, metre, meter, mtr",
    "km": "km, kilometre, kilometer",
    "cm": "cm, centimetre, centimeter",
    "mile": "mile, mi",
    "kWh": "kWh, kilowatt-hour, kilowatt hour",
    "MWh": "MWh, megawatt-hour, megawatt hour",
    "GWh": "GWh, gigawatt-hour, gigawatt hour",
    "L": "L, litre, liter, ltr",
    "m3": "m3, cu m, cubic metre, cubic meter",
    "hl": "hl, hectolitre, hectoliter",
    "percent": "percent, per cent, pct, %",
    "ratio": "ratio, fraction, proportion",
    "bps": "bps, bp, basis point",
    "per mille": "per mille, permille, ‰",
    "h": "h, hour, hr",
    "day": "day, d",
    "week": "week, wk",
    "thousand": "thousand, K, k, ሺህ",
    "million": "million, M, mn, mln, ሚሊዮን, ሚልዮን",
    "billion": "billion, B, bn, ቢሊዮን",
}
# Metric prefixes, what they are put before, and other units and multipliers in use.
PREFIXES = "tera giga mega kilo hecto deca deci centi milli micro nano"
STEMS = "metre meter litre liter gram gramme tonne watt watt-hour joule"
SYMBOLS = {"m": "d m µ u n h", "g": "m µ u n M d c h", "L": "m c d k M µ u", "l": "m c d k M µ u", "t": "k M G", "W": "k M G T m", "Wh": "T m P", "J": "k M G"}
SMALL_LENGTHS = "mm cm dm mi mile yd yard ft foot feet in inch millimetre millimeter centimetre centimeter decimetre decimeter"
OTHER_UNITS = (
    "trillion, quadrillion, zillion, crore, lakh, dozen, hundred, month, year, minute, second, ton, short ton, long ton, ounce, oz, lb, stone, carat, "
    "gallon, pint, barrel, bbl, teaspoon, foot, feet, inch, yard, nautical mile, furlong, bushel, W, Wh, watt, watt-hour, J, joule, calorie, degree, yen, rupee, "
    "franc, yuan, rouble, square, cubic, bullion"
)
DIGITS = "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹．，٫٬−–‒’ʼ\u00a0\u202f\u2009²³"
PLAIN = "012345678901234567890123456789.,.,---''   23"
NUMBER = r"(?:\d{1,3}(?:[ ']\d{3})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)*)"
VALUE = rf"^([^\d(]*?)\s*(\(?)\s*({NUMBER})\s*([-)]?)\s*((?:[^\d\s].*)?)$"
HEDGE = r"(?i)^\s*(?:~|≈|(?:approximately|approx|about|around|circa|ca|c)\b\.?)\s*"
VOWELS = set("aeiou")
GAP = re.compile(r"[ -]+")
#: A dictionary of at most this many spellings is broadcast; a larger one is joined by shuffle.
BROADCAST_SPELLINGS = 100_000


def plain(text: Column) -> Column:
    """Digits of any script, minus signs, spaces and superscripts in their ASCII form; '000 as a word."""
    return F.regexp_replace(F.translate(text, DIGITS, PLAIN), r"(?<![\d'])'000(?!\d)", " thousand ")


def phrase(text: Column) -> Column:
    """A unit phrase without dots, brackets and the words 'in' and 'of'; null when nothing is left."""
    bare = F.regexp_replace(plain(text), r"[.()\[\]|:;]", "")
    bare = F.regexp_replace(bare, r"(?i)^\s*in\s+|\bof\b", " ")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(bare != "", bare)


def decimal(digits: Column) -> Column:
    """The number of a digit string by its separators: the last of two kinds is the decimal mark, repeated ones
    group digits, and a lone one before exactly three final digits groups them unless a lone 0 leads."""
    grouped = digits.rlike("[ ']")
    bare = F.regexp_replace(digits, "[ ']", "")
    marks = F.regexp_replace(bare, r"\d", "")
    last = F.right(marks, F.lit(1))
    mixed = marks.contains(",") & marks.contains(".")
    thousands = (F.length(marks) > 1) | (~grouped & bare.rlike(r"^(?!0[.,])\d+[.,]\d{3}$"))
    as_decimal = F.concat(F.regexp_replace(bare, r"[.,]\d*$", ""), F.lit("."), F.regexp_extract(bare, r"[.,](\d*)$", 1))
    text = (
        F.when(marks == "", bare)
        .when(mixed & (F.length(F.replace(marks, last, F.lit(""))) == F.length(marks) - 1), F.concat(F.regexp_replace(F.regexp_replace(bare, r"[.,]\d*$", ""), "[.,]", ""), F.lit("."), F.regexp_extract(bare, r"[.,](\d*)$", 1)))
        .when(mixed, F.lit(None))
        .when(thousands, F.regexp_replace(bare, "[.,]", ""))
        .otherwise(as_decimal)
    )
    return text.try_cast("decimal(38,9)")


def parsed(facts: DataFrame) -> DataFrame:
    """(id, ldu_id, field_name, value, number, why, three unit phrases by place) of each fact; why it states no single number."""
    value = F.trim(F.regexp_replace(plain(F.col("value")), HEDGE, ""))
    part = lambda i: F.regexp_extract("_v", VALUE, i)
    rows = facts.where("id is not null").select("id", "ldu_id", "field_name", "value", "unit", value.alias("_v"))
    size = decimal(part(3))
    negative = (part(2) == "(") | (part(4) == "-") | part(1).contains("-")
    field = F.coalesce(F.nullif(F.regexp_extract("field_name", r"\(([^()]*)\)\s*$", 1), F.lit("")), F.nullif(F.regexp_extract("field_name", r",\s*([^,]*)$", 1), F.lit("")))
    stated = F.col("_v").rlike(VALUE)
    rows = rows.withColumn("_s", F.when(stated, size))
    digits = F.length(F.regexp_replace(part(3), r"\D", ""))
    why = F.when(F.col("value").isNull(), "no value").when(~stated, "no single number").when(F.col("_s").isNull(), F.when(digits > 29, "too large").otherwise("no single number"))
    return rows.select(
        "id", "ldu_id", "field_name", "value",
        F.when(negative, -F.col("_s")).otherwise(F.col("_s")).alias("number"),
        why.alias("why"),
        phrase(F.concat(F.replace(part(1), F.lit("-"), F.lit("")), F.lit(" "), part(5))).alias("in_value"),
        phrase(F.col("unit")).alias("in_unit"),
        phrase(field).alias("in_field"),
    )


def from_texts(rows: DataFrame, ldus: DataFrame) -> DataFrame:
    """rows with the unit phrases that follow the fact in its source unit, and that the title of its table ends with."""
    keys = rows.where("ldu_id is not null").select("ldu_id").distinct()
    texts = ldus.where("ldu_id is not null and content is not null").select("ldu_id", "content", "chunk_type").join(sized(keys), "ldu_id", "left_semi")
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(F.col(c), F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    after = F.call_function("regexp_extract", F.col("content"), F.concat(quoted("field_name"), F.lit(r"(?: \| |: ?)"), quoted("value"), F.lit(r"(?![.,'   ]?\p{Nd})([^\n]*)")), F.lit(1))
    after = F.regexp_replace(F.regexp_replace(after, r"^\s*\|", ""), r"(?i)\b(cu|sq)\.", "$1")
    title = F.when(F.col("chunk_type") == "table", F.regexp_extract("content", r"^\s*([^\n]*)", 1))
    title = F.coalesce(*(F.nullif(F.regexp_extract(title, p, 1), F.lit("")) for p in (r"[(\[]([^()\[\]]*)[)\]]\s*$", r"figures\s+(?:are\s+)?(.*)$", r",\s*([^,]*)$")))
    both = rows.join(texts, "ldu_id", "left")
    return both.select(*rows.columns, phrase(F.regexp_extract(after, r"^([^.;,!?|]*)", 1)).alias("in_text"), phrase(title).alias("in_title"))


OWN_PLACES = ["in_value", "in_unit", "in_field"]
PLACES = [*OWN_PLACES, "in_text", "in_title"]


def lexicon(unit_reference: DataFrame) -> list[tuple[str, str]]:
    """(name, symbol) of the reference's symbols and of their usual names; as small as these two fixed tables."""
    symbols = [r[0] for r in unit_reference.where("unit_symbol is not null").select("unit_symbol").distinct().collect()]
    named = {n.strip(): s for s, names in UNIT_NAMES.items() if s in symbols for n in names.split(",")}
    return sorted((named | {s: s for s in symbols}).items())


def decoys() -> set[str]:
    """Names of units and multipliers that spellings must not be taken for, some of them the reference's own."""
    metric = {p + s for p in PREFIXES.split() for s in STEMS.split()} | {p + s for s, ps in SYMBOLS.items() for p in ps.split()}
    lengths = {*SMALL_LENGTHS.split(), *(x for x in metric if x.endswith(("metre", "meter")))}
    powers = {f"{w} {x}" for w in ("sq", "square", "cu", "cubic") for x in lengths} | {x + k for x in ("mm", "cm", "dm", "mi", "ft", "in", "yd") for k in "23"}
    return metric | powers | {x.strip() for x in OTHER_UNITS.split(",")} | {x.replace("-hour", " hour") for x in metric if x.endswith("-hour")}


def grams(text: Column) -> Column:
    """Padded, lower-case character bigrams of a text, each once."""
    padded = F.concat(F.lit("^"), F.lower(text), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def _bare(token: str) -> str:
    """A token in lower case and without a plural s."""
    low = token.lower()
    return low[:-1] if len(low) > 3 and low.endswith("s") else low


def token_cost(a: str, b: str) -> float:
    """Weighted edit distance of token a from token b of a name; 99 where they are not taken for one word.

    Case, a plural s, doubled letters and vowels are cheap, two letters exchanged count half, a consonant counts 1.
    Tokens of up to three letters may differ in case and plural only; the first letter must be the same.
    """
    if a == b:
        return 0.0
    case = 0.05 * min(3, sum(x != y for x, y in zip(a, b) if x.lower() == y.lower()))
    s, t = a.lower(), b.lower()
    plural = 0.0
    if s != t and s.endswith("s") != t.endswith("s") and len(s) > 1 and len(t) > 1:
        plural, s, t = 0.3, s.removesuffix("s"), t.removesuffix("s")
    if s == t:
        return case + plural
    if min(len(s), len(t)) <= 3 or s[0] != t[0]:
        return 99.0

    def gap(w: str, i: int) -> float:
        return 0.3 if w[i] == w[i - 1] else 0.4 if w[i] in VOWELS else 1.0

    rows = [[0.0] + [99.0] * len(t)]
    for j in range(1, len(t) + 1):
        rows[0][j] = rows[0][j - 1] + gap(t, j - 1)
    for i in range(1, len(s) + 1):
        row = [rows[-1][0] + gap(s, i - 1)]
        for j in range(1, len(t) + 1):
            x, y = s[i - 1], t[j - 1]
            swap = 0.0 if x == y else 0.4 if x in VOWELS and y in VOWELS else 1.0
            best = min(rows[i - 1][j - 1] + swap, rows[i - 1][j] + gap(s, i - 1), row[j - 1] + gap(t, j - 1))
            if i > 1 and j > 1 and x == t[j - 2] and s[i - 2] == y and x != y:
                best = min(best, rows[i - 2][j - 2] + 0.5)
            row.append(best)
        rows.append(row)
    cost = case + plural + rows[-1][-1]
    return cost if cost <= min(0.2 * len(b), 1.5) else 99.0


def edit_cost(a: str, b: str, words: frozenset[str]) -> float:
    """Cost of spelling a for name b, token by token; 99 where a holds one of the unit words that b has not."""
    if a == b:
        return 0.0
    x, y = GAP.split(a), GAP.split(b)
    one, other = "".join(x), "".join(y)
    if _bare(one) == _bare(other):
        return 0.2 * (len(x) != len(y) or GAP.findall(a) != GAP.findall(b)) + token_cost(one, other)
    own = {_bare(t) for t in y}
    if any(_bare(t) in words and _bare(t) not in own for t in x):
        return 99.0
    if len(x) != len(y):
        return 0.2 * abs(len(x) - len(y)) + token_cost(one, other)
    return 0.2 * (GAP.findall(a) != GAP.findall(b)) + sum(map(token_cost, x, y))


def aliases(spellings: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """(spelling, symbol, cost) of the distinct spellings that lie nearest to the name of one known unit.

    Candidates share at least a third of their bigrams. Names and decoys are fixed tables, so a spelling has few.
    """
    known, others = dict(names), decoys()
    words = frozenset(_bare(t) for n in {*known, *others} for t in GAP.split(n))
    left = spellings.select("spelling", F.size(grams(F.col("spelling"))).alias("n"), F.explode(grams(F.col("spelling"))).alias("gram"))
    every = spellings.sparkSession.createDataFrame(sorted((dict.fromkeys(others, "") | known).items()), "name string, symbol string")
    index = every.select("name", "symbol", F.size(grams(F.col("name"))).alias("m"), F.explode(grams(F.col("name"))).alias("gram"))
    shared = left.join(F.broadcast(index), "gram").groupBy("spelling", "name", "symbol", "n", "m").agg(F.count("*").alias("k"))
    near = shared.where("k * 3 >= greatest(n, m)")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cost=[edit_cost(a, b, words) for a, b in zip(batch["spelling"], batch["name"])])

    costed = near.select("spelling", "name", "symbol").mapInPandas(verify, "spelling string, name string, symbol string, cost double").where("cost < 99")
    each = costed.groupBy("spelling", "symbol").agg(F.min("cost").alias("cost"))
    ranked = each.groupBy("spelling").agg(F.array_sort(F.collect_list(F.struct("cost", "symbol"))).alias("r"))
    alone = F.get("r", F.lit(1)).isNull() | (F.get("r", F.lit(1))["cost"] > F.get("r", F.lit(0))["cost"])
    best = ranked.where(alone).select("spelling", F.get("r", F.lit(0)).alias("s")).select("spelling", "s.symbol", "s.cost")
    return best.where("symbol <> ''")


def dictionary(phrases: DataFrame, unit_reference: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """(phrase, common_unit, factor, scale) of each distinct phrase that names a unit, a multiplier or both."""
    words = F.split("phrase", " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    more = F.size(words) > 1
    rest = F.when(more, F.array_join(F.slice(words, 2, F.size(words)), " "))
    start = F.when(more, F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    none = F.lit(None).cast("string")
    way = lambda n, u, k: F.struct(F.lit(n).alias("way"), u.alias("unit_part"), k.alias("scale_part"))
    ways = F.array(way(0, F.col("phrase"), none), way(1, none, F.col("phrase")), way(2, rest, F.when(more, first)), way(3, start, F.when(more, last)))
    split = phrases.select("phrase", F.inline(ways)).where("unit_part is not null or scale_part is not null")
    spellings = split.select(F.explode(F.array_distinct(F.array_compact(F.array("unit_part", "scale_part")))).alias("spelling")).distinct()
    known = aliases(spellings, names).join(
        unit_reference.select(F.col("unit_symbol").alias("symbol"), "measure", "common_unit", F.col("factor_to_common").cast("decimal(24,7)").alias("factor")).dropDuplicates(["symbol"]), "symbol"
    )
    units = known.where("measure <> 'scale'").select(F.col("spelling").alias("unit_part"), "common_unit", "factor", F.col("cost").alias("unit_cost"))
    scales = known.where("measure = 'scale'").select(F.col("spelling").alias("scale_part"), F.col("factor").cast("decimal(15,0)").alias("scale"), F.col("cost").alias("scale_cost"))
    read = split.join(units, "unit_part", "left").join(scales, "scale_part", "left")
    whole = read.where("(unit_part is null or common_unit is not null) and (scale_part is null or scale is not null)")
    pick = whole.groupBy("phrase").agg(F.min_by(F.struct("common_unit", "factor", "scale"), F.struct(F.expr("coalesce(unit_cost, 0) + coalesce(scale_cost, 0)"), "way")).alias("u"))
    return pick.select("phrase", "u.*")


def plain_phrases(names: list[tuple[str, str]], scales: set[str]) -> list[str]:
    """The phrases that name a unit letter for letter, alone or with a multiplier: some thousands, from the fixed names."""
    units, times = [n for n, s in names if s not in scales], [n for n, s in names if s in scales]
    return units + [f"{x} {y}" for u in units for t in times for x, y in ((u, t), (t, u))]


def readings(facts: DataFrame, ldus: DataFrame, unit_reference: DataFrame) -> DataFrame:
    """(id, common_unit, value_milli, value_common, why) of every fact, each once; `why` it is not converted, null where it is."""
    names = lexicon(unit_reference)
    scales = {r[0] for r in unit_reference.where("measure = 'scale'").select("unit_symbol").collect()}
    rows = staged(parsed(facts), "quantities")
    plain_ = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in plain_phrases(names, scales)) or "null"
    told = F.expr(" or ".join(f"coalesce({p} in ({plain_}), false)" for p in OWN_PLACES))
    stated = rows.where("why is null").withColumn("told", told)
    texted = from_texts(stated.where("not told"), ldus)
    told_rows = stated.where("told").select("*", *(F.lit(None).cast("string").alias(p) for p in PLACES if p not in OWN_PLACES))
    keep = ["id", "number", *PLACES]
    rows_ = staged(texted.select(*keep).unionByName(told_rows.select(*keep)), "quantity-phrases")
    # a phrase longer than two names with all the letters that the verification lets them gain names nothing
    longest = 3 * max((len(n) for n, _ in names), default=0) + 8
    phrases = rows_.select(F.explode(F.array_distinct(F.array_compact(F.array(*PLACES)))).alias("phrase")).where(F.length("phrase") <= longest).distinct()
    known = staged(dictionary(phrases, unit_reference, names), "unit-aliases")
    if known.count() <= BROADCAST_SPELLINGS:
        known = F.broadcast(known)
    read = rows_
    for place in PLACES:
        read = read.join(known.select(F.col("phrase").alias(place), F.struct("common_unit", "factor", "scale").alias(f"u_{place}")), place, "left")
    found = [F.col(f"u_{p}") for p in PLACES]
    unit = F.coalesce(*(F.when(u["common_unit"].isNotNull(), u) for u in found))
    scale, open_ = F.lit(None).cast("decimal(15,0)"), F.lit(True)
    for u in found:  # a multiplier holds only from places no later than the one that names the unit
        scale = F.coalesce(scale, F.when(open_, u["scale"]))
        open_ = open_ & u["common_unit"].isNull()
    why = F.when(F.col("in_value").isNotNull() & F.col("u_in_value").isNull(), "other words").when(unit.isNull(), "no unit")
    done = read.select("id", "number", unit.alias("unit"), scale.alias("times"), why.alias("why"))
    unread = rows.where("why is not null").select("id", "number", F.lit(None).cast(done.schema["unit"].dataType).alias("unit"), F.lit(None).cast("decimal(15,0)").alias("times"), "why")
    every = unread.unionByName(done)
    # exact in whole numbers: billionths of the number times ten-millionths of the factor
    whole = F.try_multiply((F.col("number") * F.lit(10**9)).cast("decimal(38,0)"), (F.col("unit.factor") * F.lit(10**7)).cast("decimal(24,0)")).cast("decimal(38,0)")
    whole = F.try_multiply(whole, F.coalesce("times", F.lit(1).cast("decimal(15,0)"))).cast("decimal(38,0)")
    priced = every.select("id", F.when(F.col("why").isNull(), F.col("unit.common_unit")).alias("common_unit"), F.when(F.col("why").isNull(), whole).alias("w"), "why")
    milli = F.expr("try_cast(sign(w) * ((abs(w) + 5000000000000bd - (abs(w) + 5000000000000bd) % 10000000000000bd) / 10000000000000bd) as bigint)")
    out = priced.dropDuplicates(["id"]).withColumn("value_milli", milli).withColumn("value_common", (F.col("w") / F.lit(10**16)).cast("decimal(38,10)"))
    return out.select("id", "common_unit", "value_milli", "value_common", F.coalesce("why", F.when(F.col("value_milli").isNull(), "too large")).alias("why"))


def converted(facts: DataFrame, ldus: DataFrame, unit_reference: DataFrame) -> DataFrame:
    """(id, common_unit, value_milli, value_common) of each fact that states one measured quantity."""
    return readings(facts, ldus, unit_reference).where("why is null").drop("why")
