"""Quantities: notations, places of units, and rows that are no quantities."""

import pytest
from pyspark.sql import functions as F

from quire.operators import quantities

UNITS = [("ETB", "money", "ETB", 1.0), ("USD", "money", "USD", 1.0), ("$", "money", "USD", 1.0), ("kg", "mass", "kg", 1.0), ("g", "mass", "kg", 0.001), ("t", "mass", "kg", 1000.0), ("m", "length", "m", 1.0), ("km", "length", "m", 1000.0), ("mile", "length", "m", 1609.344), ("m2", "area", "m2", 1.0), ("percent", "ratio", "percent", 1.0), ("ratio", "ratio", "percent", 100.0), ("per mille", "ratio", "percent", 0.1), ("thousand", "scale", "1", 1e3), ("million", "scale", "1", 1e6), ("billion", "scale", "1", 1e9)]
CASES = [
    (1, "Tax", "1,234 kg", None, ("kg", 1234000)),
    (2, "Tax", "1.234,5", "kg", ("kg", 1234500)),
    (3, "Tax", "(5.25) million birr", None, ("ETB", -5250000000)),
    (4, "Tax", "$ 3.5 mln", "million", ("USD", 3500000000)),
    (5, "Tax", "٥٠١", "KM", ("m", 501000000)),
    (6, "Tax", "１２.５", "percent", ("percent", 12500)),
    (7, "Tax", "0.125", "ratio", ("percent", 12500)),
    (8, "Tax (in thousands of Br)", "7'000", None, ("ETB", 7000000000)),
    (9, "Tax, m2", "12 345 678", "M", None),
    (10, "Tax", "12-", "‰", ("percent", -1200)),
    (11, "Tax", "see Note 4", None, None),
    (12, "Tax", "2019/20", "kg", None),
    (13, "Tax", "12", None, None),
    (14, "Tax", None, "kg", None),
    (15, "Tax", "", "kg", None),
    (16, None, "3", "miles", ("m", 4828032)),
    (17, "Tax", "4 kilogrammes", None, ("kg", 4000)),
    (18, "Tax", "2.5", None, ("ETB", 2500000000)),
    (19, "Tax", "5 thousand", None, ("USD", 5000000)),
    (20, "Tax", "9 K", "million", ("ETB", 9000000000)),
    (21, "Tax", "0.0005", "kg", ("kg", 1)),
    (22, "Tax", "-0.0005", "kg", ("kg", -1)),
    (23, "Tax", "2,300,000,000,000 ETB", None, ("ETB", 2300000000000000)),
    (24, "Tax", "2,300 billion ETB", None, ("ETB", 2300000000000000)),
    (25, "Tax", "0.123456 million g", None, ("kg", 123456)),
    (26, "Tax", "123456789012345678901234567890 kg", None, None),
    (27, "Tax", "9,000,000,000,000,000,000 t", None, None),
    (28, "Tax", "5 sq mi", None, None),
    (29, "Tax", "3 trillion ETB", None, None),
    (30, "Tax", "7", None, ("kg", 7000)),
    (31, "Tax", "8", "millimetres", None),
]
WHY = {9: None, 11: "other words", 12: "other words", 13: "no unit", 14: "no value", 15: "no single number", 26: "too large", 27: "too large", 28: "other words", 29: "other words", 31: "no unit"}
CASES[8] = (9, "Tax, m2", "12 345 678", None, ("m2", 12345678000))
CASES[19] = (20, "Tax", "9", "in millions of ETB", ("ETB", 9000000000))
TEXTS = [("u18", "table", "Table 1: Figures (ETB million)\nItem | Amount\nTax | 2.5"), ("u19", "text", "Before. Tax: 5 thousand dollars. After"), ("u19", "text", "Before. Tax: 5 thousand dollars. After"), ("u1", "text", None), ("u30", "text", "Tax: 7 kg" + " " * 60 + ". " + "Text goes on. " * 50)]


@pytest.fixture(scope="module")
def inputs(spark):
    ref = spark.createDataFrame(UNITS, "unit_symbol string, measure string, common_unit string, factor_to_common double")
    facts = spark.createDataFrame([(i, f"u{i}", f, v, u, "x") for i, f, v, u, _ in CASES], "id bigint, ldu_id string, field_name string, value string, unit string, number string")
    ldus = spark.createDataFrame([(*t, "y") for t in TEXTS], "ldu_id string, chunk_type string, content string, id string")
    return facts, ldus, ref


def test_cases(inputs):
    facts, ldus, ref = inputs
    got = {r.id: (r.common_unit, r.value_milli) for r in quantities.converted(facts.unionByName(facts.limit(3)), ldus, ref).collect()}
    assert got == {i: want for i, _, _, _, want in CASES if want}


def test_empty_tables(inputs):
    facts, ldus, ref = inputs
    assert quantities.converted(facts.limit(0), ldus.limit(0), ref).count() == 0
    assert quantities.converted(facts, ldus, ref.limit(0)).count() == 0


def test_every_fact_is_read_or_has_a_reason(inputs):
    facts, ldus, ref = inputs
    got = {r.id: r.why for r in quantities.readings(facts.unionByName(facts), ldus, ref).collect()}
    assert got == {i: WHY.get(i) for i, *_ in CASES}


WORDS = frozenset(quantities._bare(t) for n in [n.strip() for ns in quantities.UNIT_NAMES.values() for n in ns.split(",")] + list(quantities.decoys()) for t in quantities.GAP.split(n))


@pytest.mark.parametrize("a,b,most", [("kgs", "kg", 0.35), ("KG", "kg", 0.11), ("kilometres", "kilometre", 0.4), ("gigawatt hours", "gigawatt-hour", 0.6)])
def test_near_spellings_cost_little(a, b, most):
    assert quantities.edit_cost(a, b, WORDS) <= most


def right_spellings() -> dict[str, str]:
    """Spellings as people write and mistype them: plural, capitals, a letter doubled, dropped, exchanged or another vowel."""
    out = {}
    for symbol, names in quantities.UNIT_NAMES.items():
        for name in (n.strip() for n in names.split(",")):
            if len(name) > 4 and name.isascii():
                k = len(name) // 2
                v = next((i for i in range(len(name) - 1, 1, -1) if name[i] in "aeiou"), None)
                ways = [name + "s", name.upper(), name.capitalize(), name[:k] + name[k] + name[k:], name[: k - 1] + name[k] + name[k - 1] + name[k + 1 :]]
                ways += [name[:v] + ("a" if name[v] != "a" else "e") + name[v + 1 :]] if v else []
                ways += [name.replace(" ", "-"), name.replace("-", " ")]
                for w in ways:
                    if w != name and " " not in w[k - 1 : k + 2]:
                        out.setdefault(w, symbol)
    return out


def wrong_spellings() -> list[str]:
    """Other units, and names with another first letter or with two other consonants."""
    known = {n.strip() for ns in quantities.UNIT_NAMES.values() for n in ns.split(",")}
    others = [w + s for w in quantities.decoys() - known for s in ("", "s")]
    first = [c + n[1:] for n in known if len(n) > 4 and n.isascii() for c in "zqx" if n[0].isalpha()]
    two = [n[:2] + "zx" + n[4:] for n in known if len(n) > 5 and n.isascii() and n[:4].isalpha()]
    return sorted({*others, *first, *two} - known - {n + "s" for n in known})


def test_precision_and_recall_on_generated_spellings(spark):
    names = [(n.strip(), s) for s, ns in quantities.UNIT_NAMES.items() for n in ns.split(",")]
    right, wrong = right_spellings(), wrong_spellings()
    assert len(right) >= 200 and len(wrong) >= 200
    got = {r.spelling: r.symbol for r in quantities.aliases(spark.createDataFrame([(w,) for w in {*right, *wrong}], "spelling string"), names).collect()}
    hit = sum(got.get(w) == s for w, s in right.items())
    false = [w for w in wrong if w in got and w not in right]
    print(f"right {hit} of {len(right)}, wrong taken {len(false)} of {len(wrong)}", [w for w, s in right.items() if got.get(w) != s], false)
    assert hit / len(right) >= 0.95 and hit / (hit + len(false)) >= 0.98
    for w in ("sq mi", "sq cm", "cu cm", "terawatt-hours", "zillion", "millimetre", "decimetres", "hectometre", "Mt", "mWh", "trillion", "megawatt", "cubic decimetre"):
        assert w not in got, w


def test_index_misses_no_near_name(spark):
    """The n-gram index against the weighted distance of every pair."""
    names = [(n.strip(), s) for s, ns in quantities.UNIT_NAMES.items() for n in ns.split(",")]
    words = ["kilometers", "hectars", "Tonnes", "litres", "quintls", "weeks", "millions", "dolars", "hours", "metric tons", "zzz"]
    got = {r.spelling for r in quantities.aliases(spark.createDataFrame([(w,) for w in words], "spelling string"), names).collect()}
    every = [n for n, _ in names]
    assert got == {w for w in words if min(quantities.edit_cost(w, n, WORDS) for n in every) < 99}


def test_rounds_half_away_from_zero(spark):
    assert spark.range(1).select(F.round(F.lit("0.5").cast("decimal(10,2)"), 0).cast("int")).first()[0] == 1
