"""Sentence units: boundaries by language, offsets, and texts without any."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import sentences

# Each text with its sentences parted by a bar.
CASES = [
    "See Fig. 10 and Sec. 2.4 for details.|Mr. A. B. Cole paid 3.5 million to Foo Inc. and left.|He met Dr. No.",
    "Open www.a.example/v1.2 now.|The U.N. scheme, e.g. this one, ends at 5 p.m. on each visit.|The counter closes at 5 p.m.|Next day it opens.",
    "The auditor asked, \"Who approved it? On what date?\" and noted the reply.|\"The count is complete.\"|A sample followed.",
    "“We accept it. It will be corrected,” the manager wrote.|Payments were late ... but none failed!|Why not?|(See Note 8 for it.)|Done",
    "1. First one goes here.|2. Second one, as in Annex 1.|3. Third.",
    "(a) One thing.|(b) Another thing.",
    "No space here.Next one\nruns over a line.",
    "« Nous acceptons. Les registres suivront », a écrit M. Petit.|Le taux est de 83,9 (p. ex. ici, etc.) à la p. 11.|Pourquoi ?|Voilà.",
    "Dr. Weber kam am 11. Mai 2010 (z. B. heute).|Vgl. Abs. 3 Nr. 14 der Verordnung.|„Wir gehen. Bald“, schrieb er.",
    "El Sr. Paz vio la pág. 52.|¿Quién fue?|¡Nadie!|«Vamos. Ya», dijo.",
    "የትርፍ ጭማሪ 12.5 በመቶ ነው!|ሒሳቡ ተዘጋ::|በ2011 ዓ.ም. ገቢ አደገ።|ኮሚቴው “መዝገቡ ይስተካከል። ሪፖርቱም ይላክ።” ሲል ወሰነ።|ይህ ለምን ቀነሰ?",
    "وقع د. بورامي على الرأي.|كتب: «نقبل. سنصحح.» ثم أغلق الملف.|لماذا؟",
    "经理写道：“我们接受。记录更正。”|农业保险从34.2%升至89.4%。|谁批准了？",
    "支店長は「受け入れる。訂正する。」と書いた。|費用は23.5%から上昇した。",
    "รายได้เพิ่มขึ้นจากร้อยละ 54.3 เป็นร้อยละ 5.8 ตามแผน|ครัวเรือน 43 ครัวเรือนให้ข้อมูล|ผู้จัดการเขียนว่า “เรายอมรับ จะแก้ไข” และปิดเรื่อง",
    "NO. 5 WAS HELD BY KEFE INC. AND LTD. UNDER IT.|THE END.",
]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    out = {}
    for r in sentences.sentences(df, "id", "content").orderBy("id", "sentence_no").collect():
        assert r.sentence == texts[r.id][r.start_char : r.end_char]
        out.setdefault(r.id, []).append(r.sentence)
    return [out.get(i, []) for i in range(len(texts))]


def glue(case):
    """The text of a case: no space where CJK or a missing space parts sentences."""
    parts = case.split("|")
    text = parts[0]
    for a, b in zip(parts, parts[1:]):
        text += ("" if a[-1] in "。”" and not b[0].isascii() and "ሀ" > b[0] or b[0] >= "　" else " ") + b
    return text


def test_cases(spark):
    texts = [glue(c) for c in CASES]
    for case, got in zip(CASES, found(spark, texts)):
        if case.startswith("No space"):
            assert got == ["No space here.", "Next one\nruns over a line."]
        else:
            assert got == case.split("|"), case


def test_null_empty_blank_and_very_long(spark):
    long = "Word after word goes on. " * 20_000
    got = found(spark, [None, "", " \n\t ", "no mark at all", long, "A \ue0ff one. B two."])
    assert got[:4] == [[], [], [], ["no mark at all"]]
    assert len(got[4]) == 20_000 and got[5] == ["A \ue0ff one.", "B two."]


def test_long_quotations_and_unbalanced_marks(spark):
    inner = "We count it. Then we close it! " * 60
    thai = "เรายอมรับ จะแก้ไข " * 60
    texts = [f"He wrote: “{inner.strip()}” and left. Next one.", f"„{inner.strip()}“, schrieb er. Nun gut.", f"ผู้จัดการเขียนว่า “{thai.strip()}” และปิดเรื่อง", "A pipe of 5” was laid. It is new. One of 6” too. Done now."]
    got = found(spark, texts)
    assert [len(x) for x in got] == [2, 2, 1, 4]


def test_repeated_units_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "A one. B two.", "x"), (1, "A one. B two.", "y"), (None, "C. D.", "z")], "id int, content string, found string")
    assert sentences.sentence_spans(df, "id", "content").count() == 2
    assert sentences.sentence_spans(df.limit(0), "id", "content").count() == 0


@pytest.fixture(scope="module")
def split(spark):
    def run(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        return [r[0] for r in df.select(sentences.spans(F.col("t"))).collect()]

    return run


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB .!?\"“”«»()\n።。、ก1")), max_size=60), min_size=20, max_size=40))
def test_spans_are_ordered_and_lose_no_text(split, texts):
    for text, spans in zip(texts, split(texts)):
        at, kept = 0, ""
        for s in spans:
            assert at <= s.start_char < s.end_char <= len(text)
            assert text[at : s.start_char].strip() == ""
            kept += text[s.start_char : s.end_char]
            at = s.end_char
        assert text[at:].strip() == "" and "".join(kept.split()) == "".join(text.split())
