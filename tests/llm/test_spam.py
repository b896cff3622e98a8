"""Spam pages: kinds of spam against kinds of texts that look alike."""

import random

import pytest

from quire.llm import spam

rnd = random.Random(4)
NOUNS = "income ledger branch survey audit budget office district report schedule harvest reserve loan cashier registrar inventory voucher".split()
VERBS = "reviewed closed verified reported postponed questioned published covered".split()
KEYS = ["cheap loan", "tax refund", "bank rate", "payday advance"]


def prose(n):
    return " ".join(f"The {rnd.choice(NOUNS)} of the {rnd.choice(NOUNS)} {rnd.choice(VERBS)} {rnd.choice(NOUNS)} number {rnd.randint(1, 999)} near {rnd.choice(NOUNS)}." for _ in range(n))


def stuffed(n):
    return "\n".join(rnd.choice(KEYS) for _ in range(n))


def links(n):
    return "\n".join(f"https://site{rnd.randint(1, 99)}.example/p/{rnd.randint(1, 9999)}" for _ in range(n))


def listed(n):
    return "\n".join(f"{i}. {rnd.choice(NOUNS)} {rnd.choice(NOUNS)} ........ {i * 3}" for i in range(1, n))


@pytest.fixture(scope="module")
def pages(spark):
    rows, truth = [], {}
    for i in range(400):
        kind = i % 5
        text = [prose(12), prose(20) + "\n\n" + links(1), listed(30), stuffed(60), links(30)][kind]
        if i % 40 == 3:
            text = prose(1) + "\n\n" + text
        rows.append((i, text, f"h{i % 9}" if i % 11 else None, i))
        truth[i] = kind > 2
    extra = [(900, None, "h1", 0), (901, "", "h1", 0), (902, "  \n", None, 0), (903, "Annual Report", "h1", 0), (904, prose(3000), "h2", 0), (905, stuffed(20000), "h2", 0), (None, "x", "h", 0)]
    truth |= {904: False, 905: True}
    return spark.createDataFrame(rows + rows[:9] + extra, "doc_id bigint, text string, issuer string, n bigint"), truth


def test_pages(pages):
    df, truth = pages
    rows = [r.doc_id for r in spam.spam_pages(df, "doc_id", "text", "issuer").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {i for i, t in truth.items() if t}


def test_scores_move_towards_the_host_rate(pages):
    df, _ = pages
    rows = spam.scored(df, "doc_id", "text", "issuer").collect()
    prior = sum(r.page_score for r in rows) / len(rows)
    inner = [r for r in rows if r.host and 0.002 < r.page_score < 0.998 and abs(r.host_rate - prior) > 1e-6]
    assert inner and all((r.score > r.page_score) == (r.host_rate > prior) for r in inner)
    assert all(r.host_rate is None for r in rows if r.host is None)


def test_scripts_without_spaces_and_the_report(spark, pages):
    df, _ = pages
    rows = [(2000, "税务报告" * 200), (2001, "ภาษีรายได้" * 150), (2002, "税务报告，" * 200), (2003, "委员会审查了上一年度的预算报告，并要求财务部门在六月底之前提交修订后的支出计划。审计人员核实了工资台账。" * 1), (2004, "x")]
    more = df.unionByName(spark.createDataFrame([(*r, "z", 0) for r in rows], df.schema))
    scores = spam.scored(more, "doc_id", "text", "issuer").dropDuplicates(["doc_id"])
    assert {r.doc_id for r in scores.where("score >= 0.5 and doc_id >= 2000").collect()} == {2000, 2001, 2002}
    report = spam.decision_report(scores).first()
    assert report.n_spam == report.n_by_label + report.n_beyond_labels and report.n_pages == scores.count()


def test_one_kind_only_and_empty(spark, pages):
    df, _ = pages
    assert spam.spam_pages(df.limit(0), "doc_id", "text", "issuer").count() == 0
    assert spam.spam_pages(spark.createDataFrame([(1, prose(30), "h")], "doc_id bigint, text string, issuer string"), "doc_id", "text", "issuer").count() == 0
