"""Languages: code, labels, held-out accuracy and mixed documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language as L

# A few words of each of some languages, enough to tell them apart.
WORDS = {
    "en": "the report of every branch was checked by an auditor before it closed and figures remain open",
    "fr": "le rapport de chaque agence est contrôlé par un vérificateur avant la clôture et les chiffres restent ouverts",
    "de": "der bericht jeder filiale wurde von einem prüfer vor dem stichtag geprüft und die zahlen bleiben offen",
    "am": "የቅርንጫፉ ሪፖርት በኦዲተር ከመዘጋቱ በፊት ተመርምሯል አሃዞቹም ክፍት ናቸው ተብሏል በዓመቱ መጨረሻ",
    "ja": "支店の報告書は締切前に監査人によって確認され数値は未確定のままである委員会は承認した",
}


def sentence(lang, seed):
    words = WORDS[lang].split() if lang != "ja" else [WORDS["ja"][i : i + 6] for i in range(0, 36, 6)]
    rnd = np.random.default_rng(seed)
    return (" " if lang != "ja" else "").join(rnd.choice(words, 14)) + "."


@pytest.fixture(scope="module")
def tables(spark):
    rnd = np.random.default_rng(5)
    units, profiles, truth = [], [], {}
    langs = list(WORDS)
    for d in range(150):
        lang = langs[d % 5]
        truth[f"d{d}"] = lang
        label = langs[int(rnd.integers(5))] if d % 10 == 0 else lang.upper() if d % 3 else None
        profiles += [(d, f"d{d}", "native_digital", label)] * (2 if d % 7 == 0 else 1)
        units += [(f"d{d}-{i}", f"d{d}", "text", sentence(lang, d * 100 + i), "x") for i in range(4)]
    for d in range(150, 160):
        truth[f"d{d}"] = "mixed"
        profiles.append((d, f"d{d}", "native_digital", "English"))
        units.append((f"d{d}-0", f"d{d}", "text", "\n".join([sentence("en", d), sentence("am", d), "", "7", sentence("en", d + 1)]), "x"))
    profiles += [(900, "none", "native_digital", None), (901, None, None, None), (None, "d1", "native_digital", "en")]
    units += [("n", "none", "text", None, "x"), ("e", "none", "text", "", "x"), (None, "d1", "text", "a", "x")] + units[:5]
    p = spark.createDataFrame(profiles, "profile_id bigint, doc_id string, origin_type string, language string")
    u = spark.createDataFrame(units, "ldu_id string, doc_id string, chunk_type string, content string, language string")
    return p, u, truth


def test_found(tables):
    profiles, units, truth = tables
    rows = L.found(profiles, units).collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    got = {int(r.item_key): r.language for r in rows if r.scope == "profile"}
    named = {r.profile_id: r.named for r in profiles.select("profile_id", L.spoken(F.col("language")).alias("named")).collect()}
    want = {d: truth[f"d{d}"] for d in range(160) if named[d] != truth[f"d{d}"]}
    assert got == want
    lines = {(r.item_key, r.seg_no): r.language for r in rows if r.scope == "ldu"}
    for d in range(150, 160):
        assert [lines.get((f"d{d}-0", i)) for i in (1, 2, 3, 5)] == ["en", "am", None, "en"]
        assert lines[(f"d{d}-0", 4)] in ("en", "am")


def test_repeated_lines_make_no_document_mixed(spark, tables):
    """The origin of a document decides nothing: running lines in another language recur on its pages, but count once."""
    profiles, units, _ = tables
    page = lambda p: "\n".join([*(sentence("am", 7000 + 10 * p + k) for k in range(8)), "The auditor checked every branch report"])
    scanned = spark.createDataFrame([(f"s-{p}", "scan", "text", page(p), "x") for p in range(6)], units.schema)
    more = profiles.unionByName(spark.createDataFrame([(990, "scan", "scanned_image", "am")], profiles.schema))
    docs, segments = L.identified(more, units.unionByName(scanned))
    got = {r.doc_id: r for r in docs.collect()}
    assert got["scan"].language == "am" and 0.8 < got["scan"].language_confidence < 0.95 and not got["scan"].ambiguous
    assert {d for d, r in got.items() if r.language == "mixed"} == {f"d{d}" for d in range(150, 160)}
    assert all(0.5 <= r.language_confidence <= 1 for r in got.values())
    assert all(0.5 <= r.confidence <= 1 for r in segments.collect())


def test_empty_tables(tables):
    profiles, units, _ = tables
    assert L.found(profiles.limit(0), units.limit(0)).count() == 0
    assert L.found(profiles, units.limit(0)).count() == 0


def test_codewords_are_far_apart():
    code = L.code_matrix()
    assert min((code[i] != code[j]).sum() for i in range(len(code)) for j in range(i)) >= 4


def test_labels(spark):
    rows = spark.createDataFrame([("EN",), ("en_GB",), ("zh-CN",), (" Afaan  Oromoo",), ("አማርኛ",), ("pt",), ("n/a",), ("",), (None,), ("mixed",)], "l string")
    assert [r[0] for r in rows.select(L.spoken(F.col("l"))).collect()] == ["en", "en", "zh", "om", "am", None, None, None, None, "mixed"]
