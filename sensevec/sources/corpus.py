"""Corpus scans: a table of documents becomes a table of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import simple_words, split_words
from .wsi import numbered_file_lines


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a file scan to all cores when it has fewer splits than there are cores.

    A corpus of many files is left as it is; this is for one small file with one row group, whose tokenisation would
    otherwise run in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def read_documents(spark: SparkSession, path: str, *cols: str) -> DataFrame:
    """Parquet documents, only the named columns."""
    docs = spark.read.parquet(path)
    return spread(docs.select(*cols) if cols else docs)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Plain text, one document per line; ids number the lines in the order of files, whatever the splits."""
    return numbered_file_lines(spark, path).select(F.col("line_no").alias("doc_id"), F.col("value").alias("text"))


def _exploded(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words).alias("p", "word"))
    return rows.select("doc_id", (F.col("p") + 1).alias("pos"), "word")


def scan_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, pos, word)`` of every non-blank word, ``pos`` counting from 1 within a document."""
    return _exploded(docs, id_col, split_words(F.col(text)))


def scan_simple_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`scan_words` over simply tokenised text."""
    return _exploded(docs, id_col, simple_words(F.col(text))).filter("word <> ''")
