"""Encoded tokens and the word pairs inside a window around each of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.mixer import mix
from .kernel import chunk_packer
from .vocab import lookup_words

BATCH = 64_000
TASK_TOKENS = 2_000_000  # tokens that a task ranks at most, about, unless one chunk after the other falls to it
PAIR_TOKENS = 1 << 17  # tokens whose pairs a task counts by document, likewise: a window has several pairs, mostly different ones


def chunked(kept: DataFrame, batch: int = BATCH) -> DataFrame:
    """Cut every document into chunks of ``batch`` original positions; windows never leave a chunk.

    A chunk bounds the rows that any later window needs together, however long a document is.
    """
    return kept.withColumn("chunk_id", F.floor((F.col("pos") - 1) / batch).cast("int"))


def tasks_of(vocab: DataFrame, task_tokens: int | None = None) -> int:
    """Tasks that the words of the vocabulary need; ``vocab`` has the frequencies in it."""
    return math.ceil((vocab.agg(F.sum("freq")).first()[0] or 0) / (task_tokens or TASK_TOKENS))


def stretches_of(vocab: DataFrame) -> int:
    """Stretches that the corpus is cut into: as many as its words need, and no fewer than keep all cores busy."""
    return max(tasks_of(vocab), 2 * vocab.sparkSession.sparkContext.defaultParallelism)


def packed(kept: DataFrame) -> DataFrame:
    """``(doc_id, chunk_id, shift, ...)``: stretches of the tokens of a chunk as lists, which take a third of the room when they move."""
    lists = [c for c in kept.columns if c not in ("doc_id", "chunk_id", "pos")]
    kinds = {c: kept.schema[c].dataType.simpleString() for c in kept.columns}
    fields = [f"{c} {kinds[c]}" for c in ("doc_id", "chunk_id")] + ["shift array<int>"] + [f"{c} array<{kinds[c]}>" for c in lists]
    return kept.select("doc_id", "chunk_id", "pos", *lists).mapInArrow(chunk_packer(lists), ", ".join(fields))


def unpacked(parts: DataFrame) -> DataFrame:
    """The tokens of :func:`packed` rows, where these are."""
    lists = [c for c in parts.columns if c not in ("doc_id", "chunk_id", "shift")]
    rows = parts.select("*", F.posexplode("shift").alias("i", "from"))
    return rows.select("doc_id", "chunk_id", (F.col("from") + F.col("i")).alias("pos"), *[F.col(c)[F.col("i")].alias(c) for c in lists])


def dealt(kept: DataFrame, vocab: DataFrame, in_order: bool = False) -> DataFrame:
    """Chunks dealt to as many tasks as the words of the vocabulary need, and no fewer than keep all cores busy.

    What a task sorts is then bounded however large the corpus is.  With ``in_order`` each task gets the chunks of a stretch of
    the corpus, later tasks those of later stretches.  Tokens move packed.
    """
    # a number that is named keeps small tasks from being merged at run time
    if in_order:
        return unpacked(packed(kept).repartitionByRange(stretches_of(vocab), "doc_id", "chunk_id"))
    return unpacked(packed(kept).repartition(stretches_of(vocab), "doc_id", "chunk_id"))


def dealt_for_pairs(kept: DataFrame, counts: DataFrame) -> DataFrame:
    """Chunks dealt to tasks that count the pairs of ``PAIR_TOKENS`` tokens each, about; ``counts`` has the numbers of tokens as ``freq``.

    Pairs are counted where their windows are built.  With the pairs of millions of tokens at hand a task would take the memory that the
    windows need, and these would be written out in many small parts.
    """
    tasks = max(tasks_of(counts, PAIR_TOKENS), kept.sparkSession.sparkContext.defaultParallelism)
    return unpacked(packed(kept).repartition(tasks, "doc_id", "chunk_id"))


def renumber(kept: DataFrame, batch: int = BATCH) -> DataFrame:
    """Positions counted over the kept tokens of each chunk, so a window skips what was dropped."""
    rank = F.row_number().over(W.partitionBy("doc_id", "chunk_id").orderBy("pos"))
    rows = kept if "chunk_id" in kept.columns else chunked(kept, batch)
    return rows.withColumn("pos", rank)


def encode(words: DataFrame, vocab: DataFrame, batch: int = BATCH, in_order: bool = False, freq: bool = True) -> DataFrame:
    """``(doc_id, chunk_id, pos, word_id, freq)`` of the words inside the vocabulary, without ``freq`` where that is not wanted."""
    cols = ["word_id", "freq"] if freq else ["word_id"]
    kept = lookup_words(words, vocab).select("doc_id", "pos", *cols)
    return renumber(dealt(chunked(kept, batch), vocab, in_order), batch).select("doc_id", "chunk_id", "pos", *cols)


def cut_width(window: int, seed: int, epoch: int = 0) -> Column:
    """Per-token window between 1 and ``window - 1``."""
    if window < 2:
        raise ValueError("a random cut needs a window of at least 2")
    return (F.lit(window - 1) - mix(F.col("doc_id"), F.col("pos"), epoch, seed) % F.lit(window - 1)).cast("int")


def _neighbours(tokens: DataFrame, window: int, width: Column | None, first: int | None = None) -> DataFrame:
    """Add ``ctx``: the neighbours of each token from left to right, from the offset ``first`` on.

    One exchange on (document, chunk) serves every offset; a chunk holds at most ``batch`` tokens.
    """
    order = W.partitionBy("doc_id", "chunk_id").orderBy("pos")
    if width is not None:
        # below the window, so it is computed once per token and not once per offset
        tokens = tokens.withColumn("width", width)
        width = F.col("width")
    cells = []
    for offset in [o for o in range(-window if first is None else first, window + 1) if o]:
        cell = F.lag("word_id", -offset).over(order) if offset < 0 else F.lead("word_id", offset).over(order)
        cells.append(cell if width is None else F.when(F.lit(abs(offset)) <= width, cell))
    return tokens.withColumn("ctx", F.array_compact(F.array(*cells))).drop("width")


def contexts(
    tokens: DataFrame, window: int, cut: bool = False, seed: int = 1, epoch: int = 0
) -> DataFrame:
    """One row per token with its ``ctx`` array of at most ``2 * window`` ids."""
    return _neighbours(tokens, window, cut_width(window, seed, epoch) if cut else None)


def context_pairs(
    tokens: DataFrame, window: int, cut: bool = False, seed: int = 1, epoch: int = 0
) -> DataFrame:
    """``(doc_id, chunk_id, pos, x, y)`` for every token and neighbour."""
    return contexts(tokens, window, cut, seed, epoch).select(
        "doc_id", "chunk_id", "pos", F.col("word_id").alias("x"), F.explode("ctx").alias("y")
    )


def later_pairs(tokens: DataFrame, window: int) -> DataFrame:
    """Half of :func:`context_pairs`: each token with the later ones of its window, the smaller id as ``x``."""
    around = _neighbours(tokens, window, None, 1).select("doc_id", "chunk_id", "pos", "word_id", F.explode("ctx").alias("y"))
    x, y = F.least("word_id", "y").alias("x"), F.greatest("word_id", "y").alias("y")
    return around.select("doc_id", "chunk_id", "pos", x, y)


def both_ways(counted: DataFrame) -> DataFrame:
    """``(x, y, n)`` of all pairs of windows without a cut, from counted :func:`later_pairs`: a token is its neighbour's neighbour."""
    same = F.col("x") == F.col("y")
    ways = F.when(same, F.array(F.struct("x", "y", (F.col("n") * 2).alias("n")))).otherwise(
        F.array(F.struct("x", "y", "n"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "n"))
    )
    return counted.select(F.inline(ways))


def pair_counts(pairs: DataFrame, *keys: str) -> DataFrame:
    """Distinct ``(x, y)`` with their number of occurrences, optionally within ``keys``."""
    return pairs.groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))
