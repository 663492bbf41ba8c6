import numpy as np

from sensevec.llm import neighbours


def test_chains_across_blocks_of_a_leaf(spark, monkeypatch):
    """Every vector is linked to its neighbours of a chain only, and the leaf has two blocks."""
    rng = np.random.default_rng(5)
    rows = []
    for chain in range(8):
        ids = rng.permutation(12) + 100 * chain
        basis = np.eye(16)[[2 * chain, 2 * chain + 1]]
        for k, i in enumerate(ids):
            rows.append((int(i), (np.cos(0.17 * k) * basis[0] + np.sin(0.17 * k) * basis[1]).tolist(), 1))
    units = np.array([r[1] for r in rows])
    linked = (units @ units.T >= 0.98) & ~np.eye(len(rows), dtype=bool)
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in np.argwhere(linked):
        low, high = sorted((find(rows[a][0]), find(rows[b][0])))
        root[high] = low
    assert len({find(i) for i in root}) == 8
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 48)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = {r.vec_id: r for r in neighbours.near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in found.items()} == {i: find(i) for i in root}
    assert {r[0]: found[r[0]].n_links for r in rows} == {r[0]: int(n) for r, n in zip(rows, linked.sum(1))}
    assert sum(r.kept for r in found.values()) == 8


def test_links_of_two_blocks_stay_connected():
    linked = np.array([[False, True], [True, True]])
    edges = neighbours._pair_edges(linked, np.array([1, 2]), np.array([11, 12]))
    assert sorted(zip(edges.vec_id, edges.other)) == [(2, 1), (11, 1), (12, 1)]


def test_leaves_of_a_vector_do_not_grow_with_the_table():
    """Leaf rows per vector and recall of pairs just above the threshold, for trees of 10^4 to 10^8 rows of a label."""
    rng = np.random.default_rng(0)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    sample, a = unit(rng.normal(size=(20_000, 64))), unit(rng.normal(size=(1500, 64)))
    noise = rng.normal(size=a.shape)
    noise = unit(noise - (noise * a).sum(1, keepdims=True) * a)
    b = 0.981 * a + np.sqrt(1 - 0.981**2) * noise
    per_vector = []
    for rows in (10**4, 10**5, 10**6, 10**7, 10**8):
        forest = neighbours.Forest(sample, rows, neighbours.TREES, neighbours.LEAF_ROWS, neighbours.SPILL, neighbours.SEED)
        first, second = (set(zip(*(x.tolist() for x in forest.leaves(side)))) for side in (a, b))
        per_vector.append(len(first) / len(a))
        assert len({row for row, _, _ in first & second}) >= 0.97 * len(a)
    assert max(per_vector) < 1.5 * min(per_vector) and max(per_vector) < 2 * neighbours.TREES + 1


def test_one_id_with_two_vectors_and_ids_of_text(spark):
    """Vectors 1b and 3 are linked though 1a and 1b share an id."""
    near, far = [1.0, 0.0, 0.01], [0.0, 1.0, 0.0]
    rows = [("1", far, 1), ("1", near, 1), ("3", [1.0, 0.0, 0.0], 1), ("4", far, 2)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect())
    assert found == [("1", 0, "1", True), ("1", 1, "1", True), ("3", 1, "1", False), ("4", 0, "4", True)]
