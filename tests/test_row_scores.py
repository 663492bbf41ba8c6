"""Rows are scored where they are: nothing is shuffled by word while the vectors of all words fit a broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensevec.operators import kernel as K
from sensevec.operators import model as M
from sensevec.operators import score as S
from sensevec.session import materialize


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i + 1, f"w{i}", f) for i, f in enumerate([40, 21, 13, 13, 8, 8, 5, 2, 1])]
    vocab = materialize(spark.createDataFrame(rows, "word_id int, word string, freq long"), "vocab")
    base = M.new_model(vocab, 6, 3, 0.1, 0.05)
    counts = vocab.select("word_id", F.array(*[(F.col("freq") * s).cast("double") for s in (0.6, 0.3, 0.1)]).alias("counts"))
    # a word without its last sense
    vecs = M.init_in(vocab, 6, 3, 5, 3.0).filter("not (word_id = 4 and sense = 3)")
    return base.with_tables(
        in_vec=materialize(vecs, "in"),
        out_vec=materialize(M.init_out(vocab, 6, 6, 3.0), "out"),
        sense_counts=materialize(counts, "counts"),
        tree=materialize(base.tree, "tree"),
    )


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")



def test_contexts_are_summed_without_a_shuffle(spark, model, monkeypatch):
    rows = [(1, 1, [2, 3, 4]), (2, 1, []), (3, 5, [1, 1, 9]), (4, 4, [7, 7]), (5, 99, [1])]
    occ = materialize(spark.createDataFrame(rows, "occ_id long, x int, ctx array<int>"), "occ")
    scored = S.context_loglik(occ, model)
    assert exchanges(scored) == 0
    found = {(r.occ_id, r.sense): r.ll for r in scored.collect()}
    monkeypatch.setattr(S, "SIDE_BYTES", 0)
    other = {(r.occ_id, r.sense): r.ll for r in S.context_loglik(occ, model).collect()}
    assert set(found) == {(o, k) for o in (1, 3, 4) for k in (1, 2, 3)} - {(4, 3)}
    assert found == pytest.approx(other)


def test_groups_are_averaged_with_one_shuffle_of_sums(spark, model, monkeypatch):
    rows = [(g, c, x, y, 1 + (x * y) % 3) for g in (1, 2, None) for c in (0, 1) for x in range(1, 10) for y in range(1, 10)]
    counted = materialize(spark.createDataFrame(rows, "g long, c int, x int, y int, n long"), "counted")
    by = S.likelihood_by(counted, model, "g", min_prob=0.005)
    assert exchanges(by) == 1  # by group; it was also by word and slice
    found = {r.g: (r.mean, r.n) for r in by.collect()}
    whole = S.likelihood(counted, model, 0.005).first()
    monkeypatch.setattr(S, "SIDE_BYTES", 0)
    other = {r.g: (r.mean, r.n) for r in S.likelihood_by(counted, model, "g", min_prob=0.005).collect()}
    assert found.keys() == other.keys() == {1, 2, None}
    assert all(found[g] == pytest.approx(other[g]) for g in found)
    again = S.likelihood(counted, model, 0.005).first()
    assert whole.n == again.n and whole.mean == pytest.approx(again.mean)


@pytest.mark.parametrize("scale", [1.0, 400.0])
def test_pairs_score_alike_from_paths_and_from_the_kept_table(model, scale):
    paths = S.collect_paths(model)
    decoder = K.Decoder(S.collect_nodes(model, len(paths[0]) - 1) * np.float32(scale), *paths)
    rng = np.random.default_rng(1)
    vecs, base = rng.random((10, 3, 6)).astype(np.float32), np.zeros((10, 3))
    words, kept = K.Words(decoder, vecs, base, {}), K.Words(decoder, vecs, base, {"met": 1 << 40})
    x, y = rng.integers(1, 10, 300), rng.integers(1, 10, 300)
    plain = np.stack([decoder.loglik(vecs[a].astype(float), np.array([b]))[0] for a, b in zip(x, y)])
    assert words.plain == (scale == 1.0) and words.table() is None and kept.table() is not None
    assert np.allclose(words.loglik(x, y), plain) and np.allclose(kept.loglik(x, y), plain)
