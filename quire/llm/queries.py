"""The registered queries of the problems over text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import language, mixing, packing, scans, sentences, spam
from quire.operators.keys import documents_of, sized
from quire.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each sentence of each text unit of the native digital documents, by its offsets."""
    keys = sized(documents_of(table(spark, folder, "profiles"), "native_digital"))
    units = table(spark, folder, "ldus").where("chunk_type = 'text'").select("ldu_id", "doc_id", "content")
    return sentences.sentence_spans(units.join(keys, "doc_id", "left_semi"), "ldu_id", "content")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles whose language is missing or wrong, with the right one, and the languages of lines of mixed documents."""
    return language.found(table(spark, folder, "profiles"), table(spark, folder, "ldus"))


def p2_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each document with text units, with the confidence of its decoding and whether it is ambiguous."""
    docs, _ = language.identified(table(spark, folder, "profiles"), table(spark, folder, "ldus"))
    return docs.select("doc_id", "language", "language_confidence", "ambiguous")


def p2_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each line of the documents in two languages, with its confidence and whether it is ambiguous."""
    _, segments = language.identified(table(spark, folder, "profiles"), table(spark, folder, "ldus"))
    return segments


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Divided words, misread words, running lines and page numbers of scanned and mixed documents."""
    return scans.found(table(spark, folder, "blocks"), table(spark, folder, "ldus"), table(spark, folder, "profiles"))


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks and units of scanned and mixed documents as repaired paragraphs."""
    return scans.paragraphs(table(spark, folder, "blocks"), table(spark, folder, "ldus"), table(spark, folder, "profiles"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of documents, or piece of one, in a container of each of the container specs."""
    return packing.packed(table(spark, folder, "documents"), table(spark, folder, "container_specs"), "doc_id", "text")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each spec are."""
    return packing.fill_report(p6_containers(spark, folder), table(spark, folder, "container_specs"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The texts drawn from documents for the mix targets, in the order of drawing."""
    return mixing.drawn(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), "doc_id", "text", "source")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The actual share of each source in that drawing, beside its target and what was within reach."""
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that consist for the most part of repeated keywords, links or tags."""
    return spam.spam_pages(table(spark, folder, "documents"), "doc_id", "text", "issuer_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the spam the weak labels named, how much the trees found beyond them, and what the host rates changed."""
    return spam.decision_report(spam.scored(table(spark, folder, "documents"), "doc_id", "text", "issuer_id"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_documents": p2_documents,
    "p2_lines": p2_lines,
    "p4_found": p4_found,
    "p4_text": p4_text,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_report": p8_report,
}
SQL: dict[str, str] = {}
