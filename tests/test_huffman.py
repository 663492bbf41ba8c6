import heapq
import random

import numpy as np
import pytest

from sensevec.operators import huffman as H


def heap_cost(freqs):
    heap, cost = list(freqs), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    return cost


def tree_of(spark, freqs):
    rows = [(i + 1, f"w{i:05d}", f) for i, f in enumerate(sorted(freqs, reverse=True))]
    vocab = spark.createDataFrame(rows, "word_id int, word string, freq long")
    return vocab, H.huffman_tree(vocab)


@pytest.mark.parametrize("freqs", [[1, 1, 1, 1], [1, 2, 4, 8], [3, 3, 3], [1] * 37 + [2] * 11 + [50, 7, 7]])
def test_codes(spark, freqs):
    vocab, tree = tree_of(spark, freqs)
    rows = tree.orderBy("word_id", "depth").collect()
    freq = {r.word_id: r.freq for r in vocab.collect()}
    codes, lengths = {}, {}
    for r in rows:
        codes[r.word_id] = str(r.code) + codes.get(r.word_id, "")
        lengths[r.word_id] = r.depth
    assert sum(freq[w] * n for w, n in lengths.items()) == heap_cost(freqs)
    assert sum(2.0**-n for n in lengths.values()) == 1.0
    assert len(set(codes.values())) == len(freqs)
    assert not any(a != b and b.startswith(a) for a in codes.values() for b in codes.values())
    assert {r.node_id for r in rows} == set(range(1, len(freqs)))
    # the node next to the root side of a shared prefix is shared
    assert all(r.node_id == len(freqs) - 1 for r in rows if r.depth == lengths[r.word_id])
    ordered = sorted(freq, key=lambda w: freq[w])
    assert all(lengths[a] >= lengths[b] for a, b in zip(ordered, ordered[1:]) if freq[a] < freq[b])


def test_edges(spark):
    assert tree_of(spark, [5])[1].isEmpty()
    _, tree = tree_of(spark, [5, 1])
    assert sorted((r.word_id, r.node_id, r.code) for r in tree.collect()) == [(1, 1, 0), (2, 1, 1)]


def test_runs_are_optimal_for_random_frequencies():
    rng = random.Random(3)
    for _ in range(200):
        freqs = sorted(rng.choice([1, 1, 2, 3, 5, 8, rng.randint(1, 500)]) for _ in range(rng.randint(2, 300)))
        values, counts = np.unique(freqs, return_counts=True)
        first, nodes, places = H.merge_runs(list(zip(values.tolist(), counts.tolist())))
        cost, root = 0, len(freqs) - 1
        for value, count in zip(values.tolist(), counts.tolist()):
            for i in range(count):
                place, depth = first[value] + i, 1
                while (node := place // 2 + 1) < root:
                    run = np.searchsorted(nodes, node - 1, side="right") - 1
                    place = places[run] + node - 1 - nodes[run]
                    depth += 1
                cost += value * depth
        assert cost == heap_cost(freqs)
