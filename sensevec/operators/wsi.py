"""Word-sense induction: contexts of target words, answers, contingency of true and induced senses."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.priors import expected_pi
from ..functions.text import split_words
from ..session import at_most, materialize
from .kernel import run_heads
from .metrics import ari_column, totals
from .model import SenseModel
from .score import argmax_sense, disambiguate
from .vocab import BROADCAST_WORDS, lookup_words

MIN_WORD_WEIGHT = 500
RECORD_KEYS = ["record", "sense_no"]


def _nearest(words: DataFrame, window: int, keys: list[str]) -> DataFrame:
    """The ``window`` known words of each side that are closest to the target, by their place ``i``.

    ``run`` numbers the side of a row that words come from.  Words that follow ``window`` others of their run cannot be among the closest:
    they go where they are, before anything is sorted or shuffled.
    """
    kept = words.drop("run").schema
    first = words.mapInArrow(run_heads(window), kept)
    order = W.partitionBy(*keys, "side").orderBy("i")
    return first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= window)


def _run() -> Column:
    """Number of the row and side that words come from, next to ``row_no`` and ``side``."""
    return (F.col("row_no") * 2 + (F.col("side") == "left").cast("int")).alias("run")


def _collect(words: DataFrame, keys: list[str]) -> DataFrame:
    """At most ``2 * window`` ids per key, right side first."""
    entry = F.struct((F.col("side") == "left").alias("s"), "r", "word_id")
    listed = words.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("c"))
    return listed.select(*keys, F.col("c.word_id").alias("ctx"))


def context_words(instances: DataFrame, vocab: DataFrame, window: int, keys: list[str]) -> DataFrame:
    """``(keys, side, r, word_id)`` from ``left`` and ``right`` text: unknown words go first, then the nearest stay.

    ``r`` counts from the target outwards.
    """
    sides = F.array(
        F.struct(F.lit("left").alias("side"), F.reverse(split_words(F.lower("left"))).alias("words")),
        F.struct(F.lit("right").alias("side"), split_words(F.lower("right")).alias("words")),
    )
    rows = instances.select(F.monotonically_increasing_id().alias("row_no"), *keys, F.inline(sides))
    words = rows.select(_run(), *keys, "side", F.posexplode("words").alias("i", "word"))
    known = lookup_words(words, vocab, ("word_id",)).drop("word")
    return _nearest(known, window, keys).select(*keys, "side", "r", "word_id")


def contexts(instances: DataFrame, vocab: DataFrame, window: int = 5) -> DataFrame:
    """``(key, instance, x, ctx)``; the target is the part of ``key`` before its first dot."""
    keys = ["key", "instance"]
    ctx = _collect(context_words(instances, vocab, window, keys), keys)
    word = F.substring_index("key", ".", 1)
    targets = lookup_words(instances.select(*keys, word.alias("word")), vocab, ("word_id",))
    empty = F.array().cast("array<int>")
    return targets.join(ctx, keys, "left").select(
        *keys, F.col("word_id").alias("x"), F.coalesce("ctx", empty).alias("ctx")
    )


def predict(
    instances: DataFrame, model: SenseModel, window: int = 5, decoder: Broadcast | None = None
) -> DataFrame:
    """``(key, instance, sense)``: the most probable sense of every instance."""
    occurrences = contexts(instances, model.vocab, window).select(
        F.struct("key", "instance").alias("occ_id"), "x", "ctx"
    )
    best = argmax_sense(disambiguate(occurrences, model, decoder=decoder))
    return best.select("occ_id.key", "occ_id.instance", "sense")


def weighted_context_words(
    rows: DataFrame, vocab: DataFrame, window: int, keys: list[str], stop_words: DataFrame | None = None
) -> DataFrame:
    """``(keys, side, r, word_id)`` from ``position`` (from 0) and ``words``; the target counts as left context."""
    at = F.col("position") + 1
    size = F.size("words")
    left = F.reverse(F.slice("words", F.lit(1), F.least(at, size)))
    right = F.slice("words", F.least(at, size) + 1, F.greatest(size - at, F.lit(0)))
    sides = F.array(
        F.struct(F.lit("left").alias("side"), left.alias("ws")), F.struct(F.lit("right").alias("side"), right.alias("ws"))
    )
    ref = F.struct(*keys).alias("ref")
    parted = rows.select(F.monotonically_increasing_id().alias("row_no"), ref, F.inline(sides))
    words = parted.select(_run(), "ref", "side", F.posexplode("ws").alias("i", "word"))
    words = words.withColumn("word", F.lower("word")).filter("word <> ''")
    if stop_words is not None:
        stop = stop_words.select("word")
        stop = F.broadcast(stop) if at_most(stop, BROADCAST_WORDS) else stop
        words = words.join(stop, "word", "left_anti")
    near = _nearest(lookup_words(words, vocab, ("word_id",)).drop("word"), window, ["ref"])
    return near.select("ref.*", "side", "r", "word_id")


def capped_contexts(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The first ``limit`` contexts of each sense, or all of them."""
    if limit is None:
        return rows
    order = W.partitionBy(*(RECORD_KEYS if set(RECORD_KEYS) <= set(rows.columns) else ["word", "sense"])).orderBy("context_id")
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit).drop("rn")


def ambiguous(model: SenseModel, min_prob: float = 1e-3) -> DataFrame:
    """``(word_id, word, n_senses)`` of the vocabulary."""
    pi = expected_pi(F.col("counts"), model.alpha, model.d)
    n = F.size(F.filter(pi, lambda p: p >= min_prob))
    return model.sense_counts.select("word_id", n.alias("n_senses")).join(
        model.vocab.select("word_id", "word"), "word_id"
    )


def weighted_contingency(
    rows: DataFrame,
    model: SenseModel,
    window: int = 5,
    stop_words: DataFrame | None = None,
    min_weight: int = MIN_WORD_WEIGHT,
    decoder: Broadcast | None = None,
    max_contexts: int | None = None,
) -> DataFrame:
    """``(word, truth, pred, n)`` for ambiguous, known ASCII words of enough weight.

    ``rows`` is ``(word, weight, sense, context_id, position, words)``.  Words with one sense are dropped before
    any context is scored.  Rows with ``record`` and ``sense_no`` give ``(record, word, truth, pred, n)``: the truth is then the number of the sense
    in its record, so senses of equal label and records of one word stay apart.
    """
    by_record = set(RECORD_KEYS) <= set(rows.columns)
    wanted = ambiguous(model).filter("n_senses > 1").select("word_id", "word")
    rows = rows.filter((F.col("weight") >= min_weight) & ~F.lower("word").rlike(r"[^\x00-\x7F]"))
    rows = capped_contexts(rows.withColumn("word", F.lower("word")), max_contexts).join(wanted, "word")
    # senses of equal labels and records of one word repeat (word, sense, context_id), so every row gets a written number
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "weighted-rows")
    ctx = _collect(weighted_context_words(rows, model.vocab, window, ["row"], stop_words), ["row"])
    empty = F.array().cast("array<int>")
    named = ["row", "word", "sense"] + (RECORD_KEYS if by_record else [])
    occurrences = rows.select(*named, F.col("word_id").alias("x")).join(ctx, "row", "left").select(
        F.struct(*named).alias("occ_id"), "x", F.coalesce("ctx", empty).alias("ctx")
    )
    best = argmax_sense(disambiguate(occurrences, model, decoder=decoder))
    if by_record:
        pairs = best.select("occ_id.record", "occ_id.word", F.col("occ_id.sense_no").alias("truth"), F.col("sense").alias("pred"))
        return pairs.groupBy("record", "word", "truth", "pred").agg(F.count("*").alias("n"))
    pairs = best.select(F.col("occ_id.word").alias("word"), F.col("occ_id.sense").alias("truth"), F.col("sense").alias("pred"))
    return pairs.groupBy("word", "truth", "pred").agg(F.count("*").alias("n"))


def mean_ari(
    rows: DataFrame,
    model: SenseModel,
    window: int = 5,
    stop_words: DataFrame | None = None,
    min_weight: int = MIN_WORD_WEIGHT,
    decoder: Broadcast | None = None,
    max_contexts: int | None = None,
) -> DataFrame:
    """``(words, mean_ari)``; a word with a single induced sense counts with 0.

    Rows with ``record`` and ``sense_no`` count every record, as often as a word has them.
    """
    key = ["record", "word"] if set(RECORD_KEYS) <= set(rows.columns) else ["word"]
    cells = weighted_contingency(rows, model, window, stop_words, min_weight, decoder, max_contexts)
    per_word = totals(cells, *key).select(*key, ari_column().alias("ari"), F.lit(True).alias("scored"))
    eligible = (
        rows.filter((F.col("weight") >= min_weight) & ~F.lower("word").rlike(r"[^\x00-\x7F]"))
        .withColumn("word", F.lower("word"))
        .select(*key)
        .distinct()
        .join(model.vocab.select("word"), "word")
    )
    ari = F.when(F.col("scored"), F.col("ari")).otherwise(F.lit(0.0))
    return eligible.join(per_word, key, "left").agg(F.count("*").alias("words"), F.avg(ari).alias("mean_ari"))
