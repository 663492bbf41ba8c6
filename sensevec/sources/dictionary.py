"""Dictionary files: one ``word frequency`` pair per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE


def parse_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """``(word, freq)`` of every well-formed line; fields after the second are ignored."""
    fields = F.split(F.trim(F.regexp_replace(F.col(col), f"[{SPACE}]+", " ")), " ")
    parsed = lines.select(
        F.try_element_at(fields, F.lit(1)).alias("word"),
        F.try_element_at(fields, F.lit(2)).alias("raw"),
    )
    return parsed.select("word", _whole_number(F.col("raw")).alias("freq")).filter("freq IS NOT NULL")


def _whole_number(raw: Column) -> Column:
    return F.when(raw.rlike(r"\A[+-]?[0-9]+\z"), raw.try_cast("bigint"))


def dictionary_lines(counts: DataFrame) -> DataFrame:
    return counts.select("word", F.concat_ws(" ", "word", F.col("freq").cast("string")).alias("value"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def write_dictionary(counts: DataFrame, path: str) -> None:
    """Lines sorted by word across files (a range partitioning, not one task)."""
    dictionary_lines(counts).orderBy("word").select("value").write.text(path)


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''").distinct()
