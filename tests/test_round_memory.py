"""What a task of a training round holds does not follow the number of its pairs."""

import tracemalloc

import numpy as np

from sensevec.operators import kernel as K


def test_rare_pairs_are_held_in_small_number():
    size = 1 << 16
    start = np.arange(size + 2) - 1
    start[0] = 0
    nodes = np.arange(size + 1) % 97
    decoder = K.Decoder(np.ones((size + 1, 2), np.float32), start, nodes, np.zeros(size + 1, np.int8))
    words = K.Words(decoder, np.ones((size, 3, 2), np.float32), np.zeros((size, 3)), {})
    sums = K.RoundSums(words, np.full(size, 3), 0.1, 0.0)
    rng, pairs = np.random.default_rng(1), 0
    tracemalloc.start()
    for _ in range(20):
        x, y = rng.integers(K.HOT, size - 1, (2, 1 << 18))
        sums._weigh(x, y, np.ones((len(x), 3)))
        pairs += len(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sums._merge(last=True)
    assert sums.in_weight.sum() == 3 * pairs  # every pair has its step
    assert peak < 160 << 20  # all pairs and their merging took over 300 MB
