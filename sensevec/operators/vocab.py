"""Vocabulary: counting, filtering, ranking and looking words up."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.mixer import uniform
from ..session import at_most, materialize
from .hitters import frequent

# Above this many rows a vocabulary is joined by a shuffle instead of a broadcast.
BROADCAST_WORDS = 1_000_000
ROW_BITS = 33


def word_count(words: DataFrame, min_freq: int = 1) -> DataFrame:
    """``(word, freq)``; partial counts are merged before the shuffle, so a hot word moves as one row per task."""
    counts = words.groupBy("word").agg(F.count("*").alias("freq"))
    return counts if min_freq <= 1 else counts.filter(F.col("freq") >= min_freq)


def filter_counts(
    counts: DataFrame, min_freq: int = 0, stop_words: DataFrame | None = None, regex: str = ""
) -> DataFrame:
    """Minimum frequency, unanchored pattern and stop words; the empty pattern keeps all."""
    out = counts.filter(F.col("freq") >= min_freq)
    if regex:
        out = out.filter(F.col("word").rlike(regex))
    if stop_words is not None:
        out = out.join(stop_words.select("word"), "word", "left_anti")
    return out


def assign_ids(counts: DataFrame, remove_top_k: int = 0) -> DataFrame:
    """``(word_id, word, freq)`` ranked by descending frequency, then word; the first K ranks are dropped.

    A distributed rank: sort by ranges, number the rows inside each range, add the sizes of the
    ranges before.  No task ever holds a whole frequency group, which matters because words seen
    once or twice make up most of a vocabulary.  The numbered ranges are written out first, so the
    two reads below see the same ones.
    """
    keys = [F.col("freq").desc(), F.col("word").asc()]
    numbered = counts.select("word", F.col("freq").cast("bigint").alias("freq"))
    # no fixed number of ranges: neighbours may be merged at run time, which keeps their order
    numbered = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    row = F.monotonically_increasing_id()
    numbered = materialize(
        numbered.select(
            "word",
            "freq",
            F.shiftright(row, ROW_BITS).alias("part"),
            row.bitwiseAND((1 << ROW_BITS) - 1).alias("row"),
        ),
        "ranked",
    )
    # one row per range, at most as many as there are shuffle partitions
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("row") + 1
    return (
        numbered.join(F.broadcast(before), "part")
        .select((rank - remove_top_k).cast("int").alias("word_id"), "word", "freq")
        .filter(F.col("word_id") > 0)
    )


def build_vocab(
    counts: DataFrame,
    min_freq: int = 5,
    remove_top_k: int = 70,
    stop_words: DataFrame | None = None,
    regex: str = "",
) -> DataFrame:
    """Filter, rank and number a dictionary."""
    return assign_ids(filter_counts(counts, min_freq, stop_words, regex), remove_top_k)


def total_frequency(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.sum("freq").alias("total"))


def lookup_words(words: DataFrame, vocab: DataFrame, cols: tuple[str, ...] = ("word_id", "freq")) -> DataFrame:
    """Inner join on ``word``: words outside the vocabulary disappear.

    A vocabulary that is known to be small is broadcast, so the words are not moved at all.  With a larger one the
    words that make up a thousandth of the corpus or more, fewer than 1,400, are found by a sketch first: these meet a broadcast, whether
    the vocabulary has them or not, and only the rest is shuffled by word.  The vocabulary is sent once.
    """
    side = vocab.select("word", *cols)
    if at_most(vocab, BROADCAST_WORDS):
        return words.join(F.broadcast(side), "word")
    head = materialize(frequent(words, "word").withColumnRenamed("value", "word"), "head-words")
    known = side.join(F.broadcast(head), "word", "left_semi")
    found = words.join(F.broadcast(known), "word")
    rest = words.join(F.broadcast(head), "word", "left_anti").join(side.hint("merge"), "word")
    return found.unionByName(rest)


def lookup_ids(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """The other direction: ``word_id`` to ``word``."""
    return ids.join(vocab.select("word_id", "word"), "word_id")


def keep_probability(freq, total, threshold: float):
    """Chance that a token of a word survives subsampling."""
    return F.least(F.lit(1.0), F.sqrt(F.lit(threshold) * total / freq))


def subsample(
    tokens: DataFrame, total: int, threshold: float = math.inf, seed: int = 1, epoch: str | int = 0
) -> DataFrame:
    """Drop frequent tokens at random; ``tokens`` carries ``freq``, ``doc_id`` and ``pos``."""
    if math.isinf(threshold):
        return tokens
    e = F.col(epoch) if isinstance(epoch, str) else epoch
    u = uniform(F.col("doc_id"), F.col("pos"), e, seed)
    return tokens.filter(u >= F.lit(1.0) - F.sqrt(F.lit(threshold) * F.lit(float(total)) / F.col("freq")))


def preprocess(
    tokens: DataFrame, vocab: DataFrame, min_freq: int = 5, threshold: float = 1e-5, seed: int = 1
) -> DataFrame:
    """Minimum frequency and subsampling of encoded documents; ids outside the vocabulary are an error."""
    known = tokens.drop("freq").join(vocab.select("word_id", "freq"), "word_id", "left")
    checked = known.withColumn(
        "freq",
        F.when(F.col("freq").isNull(), F.raise_error(F.concat(F.lit("unknown word id "), F.col("word_id").cast("string"))).cast("bigint"))
        .otherwise(F.col("freq")),
    )
    total = vocab.agg(F.sum("freq")).first()[0] or 0
    return subsample(checked.filter(F.col("freq") >= min_freq), total, threshold, seed)


def repeat_epochs(tokens: DataFrame, epochs: int) -> DataFrame:
    """Every token once per epoch; no epochs give no rows."""
    if epochs < 1:
        return tokens.filter("false").withColumn("epoch", F.lit(0))
    return tokens.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
