"""Nearest senses by cosine, for one query vector or for a table of queries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm, unit
from ..session import at_most
from .kernel import top_k_scorer
from .model import SenseModel

BLOCK_ROWS = 2048
QUERY_ROWS = 4096  # candidates are sent once for each block of queries
SALTS = 16
BROADCAST_ROWS = 1_000_000


def candidates(in_vec: DataFrame, sense_counts: DataFrame | None = None, min_count: float = 1.0) -> DataFrame:
    """``(word_id, sense, vec)`` rows that may be neighbours: counted often enough and not zero."""
    rows = in_vec.select("word_id", "sense", "vec")
    if sense_counts is not None:
        counted = sense_counts.select("word_id", F.posexplode("counts").alias("k", "count"))
        counted = counted.filter(F.col("count") >= min_count)
        rows = rows.join(counted.select("word_id", (F.col("k") + 1).alias("sense")), ["word_id", "sense"])
    return rows.filter(norm(F.col("vec")) > 0)


def nearest_to_vector(
    rows: DataFrame, query: Sequence[float], k: int = 10, exclude: DataFrame | None = None
) -> DataFrame:
    """Top ``k`` by ``dot(vec, query) / |vec|``; the query is not normalised."""
    if exclude is not None:
        gone = exclude.select("word_id", "sense")
        gone = F.broadcast(gone) if at_most(gone, BROADCAST_ROWS) else gone
        rows = rows.join(gone, ["word_id", "sense"], "left_anti")
    q = F.lit([float(e) for e in query])
    scored = rows.select("word_id", "sense", (dot(F.col("vec"), q) / norm(F.col("vec"))).alias("sim"))
    # NaN would sort first in descending order
    scored = scored.filter(~F.isnan("sim"))
    return scored.orderBy(F.col("sim").desc(), "word_id", "sense").limit(k)


def nearest_neighbors(rows: DataFrame, word_id: int, sense: int, k: int = 10) -> DataFrame:
    """Neighbours of one sense; only this sense itself is left out."""
    own = rows.filter((F.col("word_id") == word_id) & (F.col("sense") == sense))
    found = own.select(unit(F.col("vec")).alias("u")).first()
    if found is None or found["u"] is None:
        raise ValueError(f"sense {sense} of word {word_id} has no vector")
    others = rows.filter((F.col("word_id") != word_id) | (F.col("sense") != sense))
    return nearest_to_vector(others, found["u"], k)


def nearest_words(model: SenseModel, word: str, sense: int, k: int = 10, min_count: float = 1.0) -> DataFrame:
    """``(word, sense, sim)``: :func:`nearest_neighbors` asked with a word and answered with words."""
    own = model.vocab.filter(F.col("word") == word).select("word_id").first()
    if own is None:
        raise ValueError(f"unknown word {word}")
    found = nearest_neighbors(candidates(model.in_vec, model.sense_counts, min_count), own["word_id"], sense, k)
    return found.join(model.vocab.select("word_id", "word"), "word_id").select("word", "sense", "sim")


def _blocks(rows: DataFrame, name: str, vec, size: int) -> tuple[DataFrame, int]:
    """Rows packed into blocks of about ``size`` vectors each."""
    count = max(1, math.ceil(rows.count() / size))
    block = F.pmod(F.xxhash64("word_id", "sense"), F.lit(count)).cast("int")
    entry = F.struct(F.col("word_id").cast("bigint").alias("word_id"), F.col("sense").cast("int").alias("sense"), vec.alias("vec"))
    packed = rows.select(block.alias("block"), entry.alias("e"))
    return packed.groupBy("block").agg(F.collect_list("e").alias(name)), count


def nearest_neighbors_batch(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, query_sense, rank, word_id, sense, sim)`` for a table of query senses.

    Candidates and queries are packed into blocks; every pair of blocks is one matrix product in a task and only the
    best ``k`` per query leave it, one list for the candidate blocks of a salt.  The pairs of blocks are met by a join on (query block, salt), so
    neither side is broadcast and no key owns all candidates.
    """
    left, _ = _blocks(rows, "candidates", F.col("vec"), BLOCK_ROWS)
    right, n_queries = _blocks(queries.filter(norm(F.col("vec")) > 0), "queries", unit(F.col("vec")), QUERY_ROWS)
    left = left.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("query_block"),
        F.pmod(F.col("block"), F.lit(SALTS)).alias("salt"),
        "candidates",
    )
    right = right.select(
        F.col("block").alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
        "queries",
    )
    met = left.join(right, ["query_block", "salt"]).select("query_block", "candidates", "queries")
    best = met.mapInArrow(
        top_k_scorer(k), "query_id bigint, query_sense int, word_id bigint, sense int, sim double"
    )
    order = W.partitionBy("query_id", "query_sense").orderBy(F.col("sim").desc(), "word_id", "sense")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
