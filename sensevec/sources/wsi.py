"""Sense-induction files: context files with headers, answer and prediction lines, nested contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import has_non_ascii, strip_non_ascii
from ..session import at_most, materialize

ROW_BITS = 33
LINE_BLOCK = 65_536
BROADCAST_SPLITS = 1_000_000


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``(line_no, value)`` with dense numbers in the order of the input partitions."""
    row = F.monotonically_increasing_id()
    rows = lines.select(
        F.shiftright(row, ROW_BITS).alias("part"), row.bitwiseAND((1 << ROW_BITS) - 1).alias("row"), "value"
    )
    rows = materialize(rows, "lines")
    # one row per input split
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select((F.col("before") + F.col("row")).alias("line_no"), "value")


def numbered_file_lines(spark: SparkSession, path: str, keep_file: bool = False) -> DataFrame:
    """``(line_no, value)`` in the order of files and of their lines, however the files are split and dealt; with ``file`` if asked."""
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.text(path).select(*split, F.monotonically_increasing_id().alias("id"), "value")
    rows = materialize(rows, "lines")
    # one row per input split, whose ids are consecutive
    earlier = W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = sizes.select("file", "start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    line = F.col("before") + F.col("id") - F.col("first")
    # few beside the lines: one row per split
    before = materialize(before, "splits")
    before = F.broadcast(before) if at_most(before, BROADCAST_SPLITS) else before
    return rows.join(before, ["file", "start"]).select(line.alias("line_no"), "value", *(["file"] if keep_file else []))


def parse_context_lines(lines: DataFrame) -> DataFrame:
    """``(key, instance, left, right)`` from ``(line_no, value)``: a header ``key N``, then N context lines.

    The header of a line is looked for inside its block of lines first; only where a block begins without
    one does the last header of the earlier blocks count.  So no task reads a whole file.
    """
    is_header = ~F.col("value").contains("\t")
    header = F.when(is_header, F.struct("line_no", F.substring_index("value", " ", 1).alias("key")))
    rows = lines.select(
        "line_no",
        "value",
        header.alias("header"),
        F.floor(F.col("line_no") / LINE_BLOCK).alias("block"),
    )
    within = W.partitionBy("block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("near", F.last("header", ignorenulls=True).over(within))
    # one row per block
    ends = rows.groupBy("block").agg(F.max("header").alias("header"))
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("block", F.last("header", ignorenulls=True).over(earlier).alias("far"))
    rows = rows.filter(F.col("header").isNull()).join(carried, "block")
    h = F.coalesce("near", "far")
    fields = F.split("value", "\t")
    return rows.select(
        h["key"].alias("key"),
        (F.col("line_no") - h["line_no"]).cast("int").alias("instance"),
        fields[0].alias("left"),
        fields[1].alias("right"),
    )


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    return parse_context_lines(numbered_file_lines(spark, path))


def answer_lines(answers: DataFrame, sense_prefix: str | None = None) -> DataFrame:
    """``value`` lines ``key key.instance sense``; predictions write ``key.senses.s`` as the sense."""
    instance = F.concat_ws(".", "key", F.col("instance").cast("string"))
    sense = F.col("sense").cast("string")
    if sense_prefix is not None:
        sense = F.concat_ws(".", F.col("key"), F.lit(sense_prefix), sense)
    return answers.select(F.concat_ws(" ", "key", instance, sense).alias("value"))


def prediction_lines(predictions: DataFrame) -> DataFrame:
    return answer_lines(predictions, "senses")


def write_predictions(predictions: DataFrame, path: str) -> None:
    prediction_lines(predictions.orderBy("key", "instance")).write.text(path)


def parse_answer_lines(lines: DataFrame) -> DataFrame:
    """``(key, instance, sense)``; the instance is what follows the last dot of the second field."""
    fields = F.split(F.trim("value"), " ")
    return lines.select(
        fields[0].alias("key"),
        F.substring_index(fields[1], ".", -1).cast("int").alias("instance"),
        fields[2].alias("sense"),
    )


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return parse_answer_lines(spark.read.text(path))


NESTED_SCHEMA = (
    "plain_word string, word string, weight int, senses array<struct<sense: string, weight: int, "
    "contexts: array<struct<position: int, words: array<string>>>>>"
)


def read_weighted(spark: SparkSession, path: str) -> DataFrame:
    """Nested word, sense, context records from JSON lines."""
    return spark.read.schema(NESTED_SCHEMA).json(path)


def flatten_weighted(nested: DataFrame, *keep: str, numbered: bool = False) -> DataFrame:
    """``(word, weight, sense, sense_weight, has_utf, context_id, position, words)``; ``context_id`` counts from 1.

    ``numbered`` adds ``record`` and ``sense_no``, which keep records of one word and senses of one label apart.
    """
    extra = []
    if numbered:
        nested = materialize(nested.withColumn("record", F.monotonically_increasing_id()), "records")
        keep, extra = (*keep, "record"), [(F.col("k") + 1).cast("int").alias("sense_no")]
    senses = nested.select(*keep, F.lower("word").alias("word"), "weight", F.posexplode("senses").alias("k", "s"))
    rows = senses.select(*keep, "word", "weight", "k", "s", F.posexplode("s.contexts").alias("i", "c"))
    return rows.select(
        *keep,
        *extra,
        "word",
        "weight",
        strip_non_ascii(F.lower("s.sense")).alias("sense"),
        F.col("s.weight").alias("sense_weight"),
        has_non_ascii(F.col("s.sense")).alias("has_utf"),
        (F.col("i") + 1).cast("bigint").alias("context_id"),
        F.col("c.position").alias("position"),
        F.transform("c.words", lambda w: F.lower(w)).alias("words"),
    )
