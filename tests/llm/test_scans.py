"""Scanned text: defects planted into clean pages come out again."""

import random

import pytest

from quire.llm import scans
from quire.operators import keys

VOCABULARY = "the committee reviewed household income and asked for a revised schedule of expenditure before closing every district office reported capital works during second half while auditors verified payroll ledger without delay".split()


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(2)
    clean = [(f"c{i}", "clean", i, "text", " ".join(rnd.choice(VOCABULARY) for _ in range(60)) + ".") for i in range(60)]
    clean.append(("c99", "clean", 99, "text", "non-core items and non-core assets"))
    pages, want = [], set()
    for p in range(4):
        body = [" ".join(rnd.choice(VOCABULARY[8:]) for _ in range(8)) for _ in range(6)]
        body[1] = "office expen-"
        body[2] = "diture reported non-"
        body[3] = "core schedule works, revised household in 20l4 with 3,9B7 of"
        body[4] = "2019"
        body[5] = "98 770"
        text = "\n".join(["Annual Report | income", f"- {p + 1} -", "", *body, "the payroll of the dist-" if p == 0 else "rict office and the ledger" if p == 1 else ["the ledger closing", "during second half"][p - 2]])
        if p == 1:
            lines = text.split("\n")
            text = "\n".join([*lines[:3], lines[-1], *lines[3:-1]])
            text = text.replace("Report", "Rep0rt")
        pages.append((f"b{p}", "scan", p, "text", text))
        want |= {(f"b{p}", "running", "Annual Rep0rt | income" if p == 1 else "Annual Report | income"), (f"b{p}", "page_no", f"- {p + 1} -"), (f"b{p}", "hyphen", "expenditure"), (f"b{p}", "hyphen", "non-core"), (f"b{p}", "ocr", "2014"), (f"b{p}", "ocr", "3,987")}
    want.add(("b0", "hyphen", "district"))
    profiles = spark.createDataFrame([("scan", "scanned_image"), ("scan", "scanned_image"), ("clean", "native_digital"), (None, "mixed")], "doc_id string, origin_type string")
    blocks = spark.createDataFrame([(i, d, n, t, "x") for i, d, n, _, t in pages + pages[:2]] + [("bn", "scan", 9, None, "x"), (None, "scan", 9, "a", "x")], "block_id string, doc_id string, pos int, text string, key string")
    ldus = spark.createDataFrame(clean, "ldu_id string, doc_id string, pos int, chunk_type string, content string")
    return blocks, ldus, profiles, want


def test_planted_defects(planted):
    blocks, ldus, profiles, want = planted
    rows = [tuple(r) for r in scans.found(blocks, ldus, profiles).collect()]
    assert len(set(rows)) == len(rows) and set(rows) == want


def test_paragraphs(planted):
    """Running lines are out, divided words whole, misread ones right, and lines run on."""
    blocks, ldus, profiles, _ = planted
    got = {}
    for r in scans.paragraphs(blocks, ldus, profiles).orderBy("unit_id", "paragraph_no").collect():
        got.setdefault(r.unit_id, []).append(r.text)
    assert set(got) == {f"b{p}" for p in range(4)}
    for unit, parts in got.items():
        text = " ".join(parts)
        assert "office expenditure reported non-core schedule works, revised household in 2014 with 3,987 of" in text, unit
        assert "Annual" not in text and "\n" not in text and f"- {int(unit[1]) + 1} -" not in text
    assert got["b0"][-1].endswith("the payroll of the district") and got["b1"][0].startswith("office and the ledger")


def test_paragraph_rules():
    lines = lambda text: [{"no": n, "line": x, "what": "running" if x == "HEAD" else None} for n, x in enumerate(text.split("\n")) if x]
    join = {"no": 0, "head": "inter", "tail": "natio-", "tail_no": 1, "token": "", "right": "internatio-"}
    again = {"no": 1, "head": "natio", "tail": "nal", "tail_no": 2, "token": "", "right": "national"}
    assert scans.paragraphs_of(lines("some inter-\nnatio-\nnal law"), [], [join, again], []) == ["some international law"]
    assert scans.paragraphs_of(lines("one two three four\n\nHEAD\n\nfive six seven\n\nnew part"), [], [], []) == ["one two three four five six seven", "new part"]
    assert scans.paragraphs_of(lines("a long line of words here\nends now.\nAnother paragraph begins"), [], [], []) == ["a long line of words here ends now.", "Another paragraph begins"]
    word = {"no": 0, "at": 3, "n": 3, "right": "the"}
    assert scans.paragraphs_of(lines("(a tbe tbe)"), [word], [], []) == ["(a the tbe)"]
    wrong = {"no": 0, "head": "expen", "tail": "diturc", "tail_no": 1, "token": "", "right": "expenditure"}
    assert scans.paragraphs_of(lines("an expen-\nditurc, and"), [], [wrong], []) == ["an expenditure, and"]
    assert scans.paragraphs_of(lines("HEAD"), [], [], []) == []


def test_no_broadcast_by_estimate(planted, monkeypatch):
    """Lexicon, its exploded index and key sets beyond the bound are joined by shuffle, however small their files are."""
    blocks, ldus, profiles, want = planted
    plans = {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    written = scans.staged
    monkeypatch.setattr(scans, "staged", seen)
    monkeypatch.setattr(keys, "BROADCAST_KEYS", -1)  # beyond it even without rows
    found = scans.found(blocks, ldus, profiles)
    plans["found"] = found._jdf.queryExecution().executedPlan().toString()
    plans["paragraphs"] = scans.paragraphs(blocks, ldus, profiles)._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == want
    # what furniture joins comes of the lines' own file, and is smaller than that
    assert [n for n, plan in plans.items() if "Broadcast" in plan and n not in ("running-lines", "page-lines")] == []
    assert {"corrections", "whole-words", "scan-words", "divided-words"} <= set(plans)


def test_empty_tables(planted):
    blocks, ldus, profiles, _ = planted
    assert scans.found(blocks.limit(0), ldus.limit(0), profiles.limit(0)).count() == 0


@pytest.mark.parametrize("wrong,right,cost", [("experiditure", "expenditure", 0.2), ("deferrecl", "deferred", 0.2), ("falrly", "fairly", 0.2), ("carricd", "carried", 0.2), ("Pደመወዝ", "የደመወዝ", 0.2), ("house", "horse", 1.0)])
def test_costs(wrong, right, cost):
    assert abs(scans.misread_cost(wrong, right) - cost) < 1e-9


def test_index_finds_every_single_misreading(spark):
    """The deletion index against all pairs of words."""
    known = spark.createDataFrame([(w, 500) for w in VOCABULARY], "word string, n bigint")
    wrong = ["expencliture", "schcdule", "tbe", "incorne", "w0rks", "verifled", "srnall", "closinq"]
    got = {(r.word, r.right) for r in scans.corrections(spark.createDataFrame([(w, 1) for w in wrong], "word string, own bigint"), known).collect()}
    limit = lambda w: scans.MAX_COST / 2 if len(w) < 6 else scans.MAX_COST
    assert got == {(w, v) for w in wrong for v in set(VOCABULARY) if scans.misread_cost(w, v) <= limit(w)}


def test_words_with_two_misreadings_are_found(spark):
    """Every pair of confusions in the longer words: nine in ten of those that the distance admits meet their right form."""
    words = [w for w in dict.fromkeys(VOCABULARY) if len(w) >= 6]
    pairs = [p.split(":") for p in scans.CONFUSIONS.split() if p.isascii()]
    made = {}
    for w in words:
        once = {w[:i] + b + w[i + len(a) :] for a, b in pairs for i in range(len(w)) if w.startswith(a, i)}
        for x in once:
            for a, b in pairs:
                for i in range(len(x)):
                    if x.startswith(a, i):
                        y = x[:i] + b + x[i + len(a) :]
                        if y not in words and 0.3 < scans.misread_cost(y, w, scans.MAX_COST) <= scans.MAX_COST:
                            made[y] = w
    assert len(made) > 500
    known = spark.createDataFrame([(w, 500) for w in dict.fromkeys(VOCABULARY)], "word string, n bigint")
    got = {(r.word, r.right) for r in scans.corrections(spark.createDataFrame([(w, 1) for w in made], "word string, own bigint"), known).collect()}
    recall = sum(x in got for x in made.items()) / len(made)
    print("double misreadings found", round(recall, 4), "of", len(made))
    assert recall >= 0.9


def test_stray_signs_and_long_words(spark):
    known = spark.createDataFrame([("expenditure", 500), ("x" * 60 + "e", 500)], "word string, n bigint")
    asked = spark.createDataFrame([("expen*diture", 1), ("x" * 60 + "c", 1)], "word string, own bigint")
    assert {(r.word, r.right) for r in scans.corrections(asked, known).collect()} == {("expen*diture", "expenditure"), ("x" * 60 + "c", "x" * 60 + "e")}
