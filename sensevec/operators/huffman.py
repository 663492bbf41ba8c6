"""Binary codes for hierarchical softmax, from the distinct word frequencies.

Huffman's algorithm takes the 2V-1 items of the tree (words and inner nodes) in order of weight and
merges them two by two.  With ties broken "words first, then older nodes", the item at place ``p`` of that
order (from 0) has parent node ``p // 2 + 1`` and branch 1 if ``p`` is even.  So a code follows from places
alone, and places follow from runs of equal weight: equal words form one run, and merging a run gives one
run of nodes.  Only runs are handled on the driver; their number is bounded by the number of distinct
frequencies, which for N tokens is below ``sqrt(2 N)``.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DISTINCT = 20_000_000
TREE_SCHEMA = "word_id int, depth int, node_id int, code tinyint"


def frequency_groups(vocab: DataFrame) -> DataFrame:
    """``(freq, n, first_id)``: how many words share a frequency, and the first id among them."""
    return vocab.groupBy("freq").agg(F.count("*").alias("n"), F.min("word_id").alias("first_id"))


def merge_runs(groups: list[tuple[int, int]]) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Places of words and nodes from ``(frequency, words)`` in ascending order of frequency.

    Returns the place of the first word of each frequency, and for runs of nodes their first node (from 0)
    and the place of that node.
    """
    words = deque(groups)
    nodes: deque[list[int]] = deque()  # [weight, count, first node]
    first_place: dict[int, int] = {}
    run_node: list[int] = []
    run_place: list[int] = []
    place = made = 0
    left = None  # weight of an item still waiting for its partner

    def emit(weight: int, count: int) -> None:
        nonlocal made
        if count:
            if nodes and nodes[-1][0] == weight:
                nodes[-1][1] += count
            else:
                nodes.append([weight, count, made])
            made += count

    while words or nodes:
        if words and (not nodes or words[0][0] <= nodes[0][0]):
            weight, count = words.popleft()
            first_place[weight] = place
        else:
            weight, count, first = nodes.popleft()
            run_node.append(first)
            run_place.append(place)
        place += count
        if left is not None:
            emit(left + weight, 1)
            count -= 1
            left = None
        emit(2 * weight, count // 2)
        if count % 2:
            left = weight
    return first_place, np.array(run_node, dtype=np.int64), np.array(run_place, dtype=np.int64)


def huffman_tree(vocab: DataFrame) -> DataFrame:
    """``(word_id, depth, node_id, code)``, depth 1 next to the word; a single word has no rows."""
    spark = vocab.sparkSession
    groups = frequency_groups(vocab)
    found = groups.orderBy("freq").limit(MAX_DISTINCT + 1).collect()
    if len(found) > MAX_DISTINCT:
        raise ValueError(f"more than {MAX_DISTINCT} distinct frequencies")
    size = sum(r["n"] for r in found)
    if size < 2:
        return spark.createDataFrame([], TREE_SCHEMA)
    if found[0]["freq"] < 1:
        raise ValueError("frequencies must be positive")
    first_place, run_node, run_place = merge_runs([(r["freq"], r["n"]) for r in found])
    shared = spark.sparkContext.broadcast(
        (
            np.array([r["freq"] for r in found], dtype=np.int64),
            np.array([first_place[r["freq"]] - r["first_id"] for r in found], dtype=np.int64),
            run_node,
            run_place,
        )
    )
    root = size - 1

    def climb(batches):
        freqs, shift, first, places = shared.value
        for pdf in batches:
            ids = pdf["word_id"].to_numpy(np.int64)
            place = ids + shift[np.searchsorted(freqs, pdf["freq"].to_numpy(np.int64))]
            depth = 1
            while len(ids):
                node = place // 2 + 1
                yield pd.DataFrame(
                    {
                        "word_id": ids.astype(np.int32),
                        "depth": np.full(len(ids), depth, dtype=np.int32),
                        "node_id": node.astype(np.int32),
                        "code": (1 - place % 2).astype(np.int8),
                    }
                )
                inner = node < root
                ids, node = ids[inner], node[inner] - 1
                run = np.searchsorted(first, node, side="right") - 1
                place = places[run] + node - first[run]
                depth += 1

    return vocab.select("word_id", "freq").mapInPandas(climb, TREE_SCHEMA)


def code_lengths(tree: DataFrame) -> DataFrame:
    return tree.groupBy("word_id").agg(F.max("depth").alias("length"))


def tree_summary(tree: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row of invariants: words, total cost, Kraft sum, deepest code, inner nodes."""
    lengths = code_lengths(tree).join(vocab.select("word_id", "freq"), "word_id")
    words = lengths.agg(
        F.count("*").alias("words"),
        F.sum(F.col("freq") * F.col("length")).alias("total_cost"),
        F.sum(F.pow(F.lit(2.0), -F.col("length"))).alias("kraft"),
        F.max("length").cast("int").alias("max_depth"),
    )
    return words.crossJoin(tree.agg(F.count_distinct("node_id").alias("nodes")))
