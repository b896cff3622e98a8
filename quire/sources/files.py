"""Files in and out: documents as binary rows, JSON artefacts, and append-only JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import file_stem


def pdf_files(spark: SparkSession, path: str, recursive: bool = False, limit: int | None = None) -> DataFrame:
    """(path, doc_id, length, content) of the PDF files of a folder, in the order of their paths; contents are read if used."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(path).select("path", file_stem(F.col("path")).alias("doc_id"), "length", "content")
    return rows.orderBy("path").limit(limit) if limit is not None else rows


def json_artefacts(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The records of a folder of JSON files, each one object or one list of objects over any number of lines."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def write_artefacts(rows: DataFrame, path: str, by: str = "doc_id") -> None:
    """rows as JSON, in a folder for each value of `by`; values written again replace the old ones, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """rows appended to a folder of JSON lines."""
    rows.write.mode("append").json(path)


def append_new(rows: DataFrame, path: str, *key: str) -> None:
    """rows appended to a Parquet table, but for those whose key is there already; rows of one key go in once.

    For facts, answers and texts that an ingest run again must not store twice. A null in a key is a value like any other.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = rows.dropDuplicates(list(key))
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        stored = spark.read.parquet(path).select(*(F.col(k).alias(f"_{k}") for k in key))
        same = F.lit(True)
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        new = new.join(stored, same, "left_anti")
    new.write.mode("append").parquet(path)


def rules(spark: SparkSession, path: str) -> dict:
    """The settings of one YAML file as nested dicts; an empty file has none. Needs PyYAML."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}
