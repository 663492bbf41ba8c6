"""Training rounds are summed where the occurrences are: nothing is shuffled or grouped by word while the vectors of all words fit a broadcast."""

import pytest
from pyspark.sql import functions as F

from sensevec.operators import kernel as K
from sensevec.operators import score as S
from sensevec.operators import train as R
from sensevec.plans import train as plan
from sensevec.session import materialize
from test_reading import words_of
from test_row_scores import exchanges, model  # noqa: F401
from test_train_stream import planted


def sums_of(df):
    return {(r.kind, r.id, r.sense): (r.weight, r.n, r.top, r.vec) for r in df.collect()}


@pytest.mark.parametrize("hot", [2048, 4])
@pytest.mark.parametrize("ordered", [False, True])
def test_sums_of_a_round_leave_tasks_as_sums_only(spark, model, monkeypatch, hot, ordered):  # noqa: F811
    rows = [(o, 1 + o % 9, [1 + (o * k) % 9 for k in range(1, o % 5)], o % 3) for o in range(200)] + [(900, 99, [1], 0), (901, 4, [], 1)]
    occ = spark.createDataFrame(rows, "occ_id long, x int, ctx array<int>, behind long")
    occ = materialize(occ if ordered else occ.drop("behind"), "occ")
    monkeypatch.setattr(K, "HOT", hot)
    summed = R.model_sums(occ, model, 0.1, 0.2)
    assert exchanges(summed) == 1  # of the sums; it was also by word and slice
    found = sums_of(summed)
    monkeypatch.setattr(S, "SIDE_BYTES", 0)
    other = sums_of(R.model_sums(occ, model, 0.1, 0.2))
    assert found.keys() == other.keys()
    for key, (weight, n, top, vec) in other.items():
        mine = found[key]
        assert mine[0] == pytest.approx(weight) and mine[1:3] == (n, top) and mine[3] == pytest.approx(vec, abs=1e-12), key


def test_training_writes_occurrences_as_they_come(spark, monkeypatch):
    tokens, vocab = words_of(spark, [t for _, t, _ in planted(1, 40)])
    params = plan.TrainParams(dim=4, senses=2, min_freq=1, rounds=2, window=2)
    runner = plan.train_tokens(tokens, vocab, params)
    # they were shuffled once more, by word and slice
    assert sorted(spark.read.parquet(f"{runner.folder}/slices-0").columns) == ["behind", "ctx", "round", "x"]
    monkeypatch.setattr(S, "SIDE_BYTES", 0)
    other = plan.train_tokens(tokens, vocab, params)
    assert "occs" in spark.read.parquet(f"{other.folder}/slices-0").columns
    assert [h[:2] + h[3:5] for h in runner.history] == [h[:2] + h[3:5] for h in other.history]
    assert [h[5] for h in runner.history] == pytest.approx([h[5] for h in other.history])


def test_a_kept_pair_is_not_scored_again(model):  # noqa: F811
    import numpy as np

    paths = S.collect_paths(model)
    decoder = K.Decoder(S.collect_nodes(model, len(paths[0]) - 1), *paths)
    rng = np.random.default_rng(2)
    words = K.Words(decoder, rng.random((10, 3, 6)).astype(np.float32), np.zeros((10, 3)), {})
    words.hot = 0
    x, y = rng.integers(1, 10, 200), rng.integers(1, 10, 200)
    first, scored = words.loglik(x, y), []
    words.distinct = lambda a, b: scored.append(len(a)) or np.zeros((len(a), 3))
    assert np.array_equal(words.loglik(x, y), first) and sum(scored) == 0
