"""Weighted sense-induction files: word, sense and context lines nested by counts, read without a task that sees a whole file.

A word line ``plain<TAB>word<TAB>weight<TAB>senses`` is followed by its senses, a sense line ``sense<TAB>weight<TAB>contexts`` by that many pairs of
a position line and a line of words.  What a line is depends on the counts before it: a line of words may look like a header.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import has_non_ascii, strip_non_ascii
from ..session import at_most, materialize
from .wsi import numbered_file_lines

LINE_BLOCK = 65_536
BROADCAST_HEADS = 1_000_000
NOWHERE = -1
MOST_JUMPS = 62  # each doubles the way that is followed


def _whole(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def possible_headers(lines: DataFrame) -> DataFrame:
    """``(line_no, next, last, is_word, fields)`` of the lines that could be headers: where in the file the header after them would stand."""
    fields = F.split(F.trim("value"), "\t")
    size = F.size(fields)
    is_word = (size == 4) & _whole(F.get(fields, F.lit(2))).isNotNull() & _whole(F.get(fields, F.lit(3))).isNotNull()
    contexts = _whole(F.get(fields, F.lit(2)))
    is_sense = (size == 3) & _whole(F.get(fields, F.lit(1))).isNotNull() & (contexts >= 0)
    after = F.when(is_word, F.col("line_no") + 1).when(is_sense, F.col("line_no") + 1 + 2 * contexts.cast("bigint"))
    found = lines.select("line_no", "last", after.alias("next"), is_word.alias("is_word"), fields.alias("fields")).filter("next is not null")
    return found.withColumn("next", F.when(F.col("next") <= F.col("last"), F.col("next")).otherwise(F.lit(NOWHERE)))


def _exits(frame: pd.DataFrame, size: int) -> pd.DataFrame:
    """Where the chain of headers that goes through each line of a block leaves the block; nowhere if it meets another line."""
    frame = frame.sort_values("line_no")
    line, after = frame.line_no.to_numpy(), frame.next.to_numpy()
    end = (line[0] // size + 1) * size
    place = np.searchsorted(line, after)
    leads = np.minimum(place, len(line) - 1)
    out = np.where(after >= end, after, NOWHERE)
    for k in range(len(line) - 1, -1, -1):
        if line[0] <= after[k] < end and line[leads[k]] == after[k]:
            out[k] = out[leads[k]]
    return pd.DataFrame({"line_no": line, "exit": out})


def _followed(frame: pd.DataFrame) -> pd.DataFrame:
    """The headers of a block that a chain reaches which enters it at an ``entered`` line."""
    frame = frame.sort_values("line_no")
    line, after, there = frame.line_no.to_numpy(), frame.next.to_numpy(), frame.entered.to_numpy().copy()
    place = np.minimum(np.searchsorted(line, after), len(line) - 1)
    for k in range(len(line)):
        if there[k] and line[place[k]] == after[k]:
            there[place[k]] = True
    return pd.DataFrame({"line_no": line[there]})


def header_lines(possible: DataFrame, starts: DataFrame) -> DataFrame:
    """``(line_no)`` of the headers: what the chains from ``starts (line_no)`` reach.

    Chains are followed inside blocks of lines by tasks of their own.  Between blocks only the lines matter where a chain may
    leave one block for another; their pointers are doubled until nothing new is reached, in as many rounds as the
    logarithm of the number of blocks.
    """
    size = LINE_BLOCK  # the tasks get it with their function
    block = F.floor(F.col("line_no") / F.lit(size)).alias("block")
    placed = materialize(possible.select("line_no", "next", block), "possible-headers")
    exits = placed.groupBy("block").applyInPandas(lambda f: _exits(f, size), "line_no bigint, exit bigint")
    exits = materialize(exits.filter(F.col("exit") != NOWHERE), "block-exits")
    entries = starts.select("line_no").union(exits.select(F.col("exit").alias("line_no"))).distinct()
    jumps = materialize(exits.join(entries, "line_no").select(F.col("line_no").alias("at"), F.col("exit").alias("to")), "jumps")
    reached = materialize(starts.select("line_no").distinct(), "reached")
    known = reached.count()
    for _ in range(MOST_JUMPS):
        further = reached.join(jumps, F.col("line_no") == F.col("at")).select(F.col("to").alias("line_no"))
        reached = materialize(reached.union(further).distinct(), "reached")
        now = reached.count()
        if now == known:
            break
        known = now
        again = jumps.select(F.col("at").alias("to"), F.col("to").alias("further"))
        first = jumps.select(F.col("at").alias("start"), "to")
        jumps = materialize(first.join(again, "to").select(F.col("start").alias("at"), F.col("further").alias("to")), "jumps")
    marked = placed.join(reached.withColumn("entered", F.lit(True)), "line_no", "left")
    marked = marked.withColumn("entered", F.coalesce("entered", F.lit(False)))
    return marked.groupBy("block").applyInPandas(lambda f: _followed(f), "line_no bigint")


def _last_before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the last non-null ``value`` up to each line: of the line's block, else of the blocks before."""
    block = F.floor(F.col("line_no") / F.lit(LINE_BLOCK))
    rows = rows.withColumn("block", block).withColumn("value_here", value)
    within = W.partitionBy("block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("near", F.last("value_here", ignorenulls=True).over(within))
    # one row per block
    ends = rows.groupBy("block").agg(F.max("value_here").alias("end"))
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    far = ends.select("block", F.last("end", ignorenulls=True).over(earlier).alias("far"))
    joined = rows.join(far, "block")
    return joined.withColumn(name, F.coalesce("near", "far")).drop("block", "value_here", "near", "far")


def parse_nested_lines(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """``(record, plain_word, word, weight, sense_no, sense, sense_weight, has_utf, context_id, position, words)``.

    ``lines`` is ``(line_no, value, last)`` with dense numbers and the last line of the file, ``starts`` the first line of each file.  One row per context; ``record`` is the line of the word, so
    records that repeat a word stay apart, and ``sense_no`` counts the senses of a record from 1, so senses of one label do.  A file that ends
    early gives the contexts that are whole.
    """
    possible = materialize(possible_headers(lines), "headers")
    real = materialize(header_lines(possible, starts), "real-headers")
    heads = possible.join(real, "line_no")
    word = F.when(F.col("is_word"), F.struct(F.col("line_no").alias("record"), F.col("fields").alias("word_fields")))
    heads = _last_before(heads, word, "of")
    senses = heads.filter(~F.col("is_word") & F.col("of").isNotNull())
    by_record = W.partitionBy("of.record").orderBy("line_no")
    senses = senses.select(
        "line_no",
        F.col("of.record").alias("record"),
        F.col("of.word_fields").alias("word_fields"),
        "fields",
        "last",
        F.row_number().over(by_record).alias("sense_no"),
    )
    senses = materialize(senses.filter(F.col("sense_no") <= F.col("word_fields")[3].cast("int")), "senses")
    end = F.least("last", F.col("line_no") + 2 * F.col("fields")[2].cast("bigint"))
    head = senses.select("line_no", F.col("line_no").alias("sense_line"), end.alias("end"))
    # the lines hold the text; heads that are few are sent to them
    head = F.broadcast(head) if at_most(head, BROADCAST_HEADS) else head
    rows = lines.select("line_no", "value").join(head, "line_no", "left")
    rows = _last_before(rows, F.when(F.col("sense_line").isNotNull(), F.struct("sense_line", "end")), "of")
    offset = F.col("line_no") - F.col("of.sense_line") - 1
    inside = rows.filter((offset >= 0) & (F.col("line_no") <= F.col("of.end")))
    inside = inside.select(
        F.col("of.sense_line").alias("sense_line"), F.floor(offset / 2).alias("i"), (offset % 2).alias("odd"), "value"
    )
    # two lines each
    pairs = inside.groupBy("sense_line", "i").agg(
        F.max(F.when(F.col("odd") == 0, F.col("value"))).alias("position"), F.max(F.when(F.col("odd") == 1, F.col("value"))).alias("words")
    )
    whole = pairs.filter("position is not null and words is not null").join(
        senses.withColumnRenamed("line_no", "sense_line"), "sense_line"
    )
    label = F.lower(F.col("fields")[0])
    return whole.select(
        "record",
        F.col("word_fields")[0].alias("plain_word"),
        F.lower(F.col("word_fields")[1]).alias("word"),
        F.col("word_fields")[2].cast("int").alias("weight"),
        "sense_no",
        strip_non_ascii(label).alias("sense"),
        F.col("fields")[1].cast("int").alias("sense_weight"),
        has_non_ascii(F.col("fields")[0]).alias("has_utf"),
        (F.col("i") + 1).cast("bigint").alias("context_id"),
        F.trim("position").cast("int").alias("position"),
        F.split(F.lower(F.trim("words")), " ").alias("words"),
    )


def nested_lines(nested: DataFrame) -> DataFrame:
    """``(word, record, place, value)``: the lines of nested records, ``place`` sorts those of a record."""
    record = F.struct("plain_word", "word", "weight", F.size("senses").alias("n")).alias("w")
    rows = nested.select(F.col("word").alias("key"), F.monotonically_increasing_id().alias("record"), record, "senses")
    word = rows.select(
        "key", "record", F.array(F.lit(0).cast("bigint")).alias("place"), F.concat_ws("\t", "w.plain_word", "w.word", "w.weight", "w.n").alias("value")
    )
    senses = rows.select("key", "record", F.posexplode("senses").alias("s", "sense"))
    at = (F.col("s") + 1).cast("bigint")
    sense = senses.select(
        "key", "record", F.array(at).alias("place"), F.concat_ws("\t", "sense.sense", "sense.weight", F.size("sense.contexts")).alias("value")
    )
    each = senses.select("key", "record", "s", F.posexplode("sense.contexts").alias("c", "context"))
    context = each.select(
        "key",
        "record",
        at.alias("s"),
        F.col("c").cast("bigint").alias("c"),
        F.posexplode(F.array(F.col("context.position").cast("string"), F.array_join("context.words", " "))).alias("k", "value"),
    )
    context = context.select("key", "record", F.array("s", "c", F.col("k").cast("bigint")).alias("place"), "value")
    return word.unionByName(sense).unionByName(context)


def write_nested(nested: DataFrame, path: str) -> None:
    """Nested records as files of lines; a record is never cut by the end of a file."""
    lines = materialize(nested_lines(nested), "nested-lines")
    placed = lines.repartitionByRange("key", "record").sortWithinPartitions("key", "record", "place")
    placed.select("value").write.text(path)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Rows of :func:`parse_nested_lines` from all files under ``path``, however they are split."""
    # written once below; numbers are added where lines are read
    lines = numbered_file_lines(spark, path, keep_file=True)
    files = materialize(lines.groupBy("file").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last")), "files")
    # one row per file
    files = F.broadcast(files) if at_most(files, BROADCAST_HEADS) else files
    placed = lines.join(files, "file").select("line_no", "value", "last")
    return parse_nested_lines(placed, files.select(F.col("first").alias("line_no")))
