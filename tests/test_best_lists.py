"""Nearest neighbours of many queries: one list per query leaves a task for all candidate blocks it has seen."""

import numpy as np
import pyarrow as pa

from sensevec.operators import kernel as K
from sensevec.operators import neighbors as N


def plain(rows, queries, k):
    out = {}
    for q, s, v in queries:
        sims = [(-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), i, t) for i, t, w in rows if (i, t) != (q, s)]
        out.setdefault((q, s), []).extend((i, t, -x) for x, i, t in sorted(sims)[:k])
    return out


def test_lists_of_blocks_are_merged(monkeypatch):
    monkeypatch.setattr(K, "QUERIES_AT_ONCE", 7, raising=False)
    rng = np.random.default_rng(4)
    rows = [(int(i), 1 + int(i) % 2, rng.integers(-2, 3, 3) + [0, 0, 0.5]) for i in rng.permutation(90)]
    # a sense that comes three times
    rows += [(5, 2, rows[0][2]), (5, 2, rows[0][2])]
    rows = [(i, s, np.asarray(v, float)) for i, s, v in rows]
    cell = lambda part: [{"word_id": i, "sense": s, "vec": v.tolist()} for i, s, v in part]
    entry = pa.list_(pa.struct([("word_id", pa.int64()), ("sense", pa.int32()), ("vec", pa.list_(pa.float64()))]))
    queries = [(i, s, v / np.linalg.norm(v)) for i, s, v in rows[:40]] + [(777, 1, np.full(3, np.nan))]
    blocks = [rows[:4], rows[4:30], rows[30:60], rows[60:]]
    columns = [pa.array([3] * 4, pa.int32()), pa.array([cell(b) for b in blocks], entry), pa.array([cell(queries)] * 4, entry)]
    batch = pa.RecordBatch.from_arrays(columns, names=["query_block", "candidates", "queries"])
    out = pa.Table.from_batches(K.top_k_scorer(6)(iter([batch.slice(0, 2), batch.slice(2)]))).to_pylist()
    assert len(out) == 40 * 6
    found = {}
    for r in out:
        found.setdefault((r["query_id"], r["query_sense"]), []).append(r["sim"])
    wanted = plain(rows, queries[:40], 6)
    assert found.keys() == wanted.keys()
    assert all(np.allclose(found[q], [x for _, _, x in best], atol=1e-9) for q, best in wanted.items())


def test_blocks_of_queries_and_candidates(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vecs = [(i, 1, rng.normal(size=4)) for i in range(300)]
    rows = spark.createDataFrame([(i, s, v.tolist()) for i, s, v in vecs], "word_id long, sense int, vec array<double>")
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "QUERY_ROWS", 50)
    monkeypatch.setattr(N, "SALTS", 2)
    found = {}
    for r in N.nearest_neighbors_batch(rows, rows, 4).orderBy("query_id", "rank").collect():
        found.setdefault((r.query_id, r.query_sense), []).append((r.word_id, r.sense))
    assert found == {q: [(i, s) for i, s, _ in best] for q, best in plain(vecs, vecs, 4).items()}
