"""Vectors in the text layout ``V M`` / ``word v1 ... vM``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import SenseModel


def vector_lines(model: SenseModel, sense: int = 1) -> DataFrame:
    """``(word_id, value)`` of one sense per word; row 0 is the header."""
    rows = model.in_vec.filter(F.col("sense") == sense).join(model.vocab.select("word_id", "word"), "word_id")
    body = rows.select(
        "word_id", F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vec", lambda e: e.cast("string")), " ")).alias("value")
    )
    header = rows.agg(
        F.lit(0).alias("word_id"),
        F.concat_ws(" ", F.count("*").cast("string"), F.lit(str(model.dim))).alias("value"),
    )
    return header.unionByName(body)


def write_vectors(model: SenseModel, path: str, sense: int = 1) -> None:
    """Files in order of ``word_id``, the header first."""
    vector_lines(model, sense).orderBy("word_id").select("value").write.text(path)


def parse_vector_lines(lines: DataFrame) -> DataFrame:
    """``(word, vec)``; a line of two whole numbers is the header."""
    fields = F.split(F.trim("value"), " ")
    body = lines.filter(~F.trim("value").rlike("^[0-9]+ [0-9]+$"))
    vec = F.transform(F.slice(fields, F.lit(2), F.size(fields)), lambda e: e.cast("float"))
    return body.select(fields[0].alias("word"), vec.alias("vec"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_vector_lines(spark.read.text(path))
