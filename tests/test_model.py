"""Scores, posteriors and one training round against a small model written in plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensevec.functions import vectors as X
from sensevec.functions.priors import expected_logpi, expected_pi
from sensevec.operators import model as M
from sensevec.operators import neighbors as N
from sensevec.operators import score as S
from sensevec.operators import train as R
from sensevec.session import materialize

DIM, SENSES, ALPHA, DISCOUNT = 6, 3, 0.1, 0.05


class Numpy:
    """The model of a few words, computed word by word."""

    def __init__(self, model):
        self.freq = {r.word_id: r.freq for r in model.vocab.collect()}
        self.vec = {(r.word_id, r.sense): np.array(r.vec, float) for r in model.in_vec.collect()}
        self.out = {r.node_id: np.array(r.vec, float) for r in model.out_vec.collect()}
        self.counts = {r.word_id: np.array(r.counts, float) for r in model.sense_counts.collect()}
        self.path = {}
        for r in model.tree.orderBy("word_id", "depth").collect():
            self.path.setdefault(r.word_id, []).append((r.node_id, r.code))

    def ll(self, x, k, y):
        total = 0.0
        for n, c in self.path[y]:
            f = float(self.vec[x, k] @ self.out[n]) * (1 - 2 * c)
            total += -math.log(1 + math.exp(-f))
        return total

    def pi(self, x):
        rest, out, counts = 1.0, [], self.counts[x]
        for k in range(SENSES - 1):
            a, b = 1 + counts[k] - DISCOUNT, ALPHA + (k + 1) * DISCOUNT + counts[k + 1 :].sum()
            out.append(a / (a + b) * rest)
            rest -= out[-1]
        return np.array([*out, rest])

    def logpi(self, x):
        rest, out, counts = 0.0, [], self.counts[x]
        for k in range(SENSES - 1):
            a, b = 1 + counts[k] - DISCOUNT, ALPHA + (k + 1) * DISCOUNT + counts[k + 1 :].sum()
            out.append(rest + digamma(a) - digamma(a + b))
            rest += digamma(b) - digamma(a + b)
        return np.array([*out, rest])

    def posterior(self, x, ctx, start):
        z = start + np.array([sum(self.ll(x, k + 1, y) for y in ctx) for k in range(SENSES)])
        z = np.exp(z - z.max())
        return z / z.sum()


def digamma(x):
    total = 0.0
    while x < 30:
        total -= 1 / x
        x += 1
    return total + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i + 1, f"w{i}", f) for i, f in enumerate([40, 21, 13, 13, 8, 8, 5, 2, 1])]
    vocab = materialize(spark.createDataFrame(rows, "word_id int, word string, freq long"), "vocab")
    base = M.new_model(vocab, DIM, SENSES, ALPHA, DISCOUNT)
    counts = vocab.select("word_id", F.array(*[(F.col("freq") * s).cast("double") for s in (0.6, 0.3, 0.1)]).alias("counts"))
    return base.with_tables(
        in_vec=materialize(M.init_in(vocab, DIM, SENSES, 5, 3.0), "in"),
        out_vec=materialize(M.init_out(vocab, DIM, 6, 3.0), "out"),
        sense_counts=materialize(counts, "counts"),
        tree=materialize(base.tree, "tree"),
    )


@pytest.fixture(scope="module")
def plain(model):
    return Numpy(model)


CONTEXTS = [(1, 1, [2, 3, 4]), (2, 1, []), (3, 5, [1, 1, 9]), (4, 9, [7]), (5, 2, [1, 2, 3, 4, 5, 6, 7, 8]), (6, 1, [2, 9])]


@pytest.fixture(scope="module")
def occurrences(spark):
    return materialize(spark.createDataFrame(CONTEXTS, "occ_id long, x int, ctx array<int>"), "occ")


def joined(monkeypatch):
    """Make every operator believe that the model is too large for a broadcast."""
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)


@pytest.mark.parametrize("x", [0.1, 0.5, 1.0, 3.3, 10.0, 1e6])
def test_digamma(spark, x):
    assert spark.range(1).select(X.digamma(F.lit(x))).first()[0] == pytest.approx(digamma(x), abs=1e-9)


def test_scalar_edges(spark):
    row = spark.range(1).select(
        X.log_sigmoid(F.lit(-800.0)),
        X.log_sigmoid(F.lit(800.0)),
        X.cos_dist(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0))),
        X.cos_dist(F.array(F.lit(0.0)), F.array(F.lit(1.0))),
        X.softmax(F.array(F.lit(float("-inf")), F.lit(float("-inf")))),
        X.unit(F.array(F.lit(0.0))),
    ).first()
    assert row[0] == -800.0 and row[1] == 0.0 and row[2] == pytest.approx(0.0, abs=1e-12)
    assert row[3] is None and row[4] is None and row[5] is None


def test_priors(model, plain):
    rows = model.sense_counts.select(
        "word_id", expected_pi(F.col("counts"), ALPHA, DISCOUNT), expected_logpi(F.col("counts"), ALPHA, DISCOUNT)
    ).collect()
    for word, pi, logpi in rows:
        assert np.allclose(pi, plain.pi(word)) and sum(pi) == pytest.approx(1.0)
        assert np.allclose(logpi, plain.logpi(word), atol=1e-8)


@pytest.mark.parametrize("form", ["kernel", "joined"])
def test_word_probabilities_add_up(spark, model, plain, form, monkeypatch):
    if form == "joined":
        joined(monkeypatch)
    pairs = model.vocab.select(F.col("word_id").alias("x")).crossJoin(model.vocab.select(F.col("word_id").alias("y")))
    rows = S.log_skip_gram(pairs, model).collect()
    assert len(rows) == 9 * 9 * SENSES
    totals = {}
    for r in rows:
        assert r.ll == pytest.approx(plain.ll(r.x, r.sense, r.y), abs=1e-6)
        totals[r.x, r.sense] = totals.get((r.x, r.sense), 0.0) + math.exp(r.ll)
    assert all(t == pytest.approx(1.0, abs=1e-6) for t in totals.values())


@pytest.mark.parametrize("form", ["kernel", "joined"])
@pytest.mark.parametrize("prior", ["pi", "logpi", "none"])
def test_posteriors(model, plain, occurrences, form, prior, monkeypatch):
    if form == "joined":
        joined(monkeypatch)
    found = {r.occ_id: r.z for r in S.posteriors(occurrences, model, prior).collect()}
    assert set(found) == {c[0] for c in CONTEXTS}
    for occ, x, ctx in CONTEXTS:
        pi = plain.pi(x)
        with np.errstate(divide="ignore"):
            start = {"pi": np.log(np.where(pi < 1e-3, 0, pi)), "logpi": plain.logpi(x), "none": np.zeros(SENSES)}[prior]
        assert np.allclose(found[occ], plain.posterior(x, ctx, start), atol=1e-6)


@pytest.mark.parametrize("form", ["kernel", "joined"])
def test_pruned_senses_get_no_probability(model, occurrences, form, monkeypatch):
    if form == "joined":
        joined(monkeypatch)
    pruned = model.with_tables(in_vec=model.in_vec.filter("sense <> 2"))
    for r in S.disambiguate(occurrences, pruned).collect():
        assert r.z[1] == 0.0 and sum(r.z) == pytest.approx(1.0)


@pytest.mark.parametrize("form", ["kernel", "joined"])
def test_nothing_left_gives_null(model, occurrences, form, monkeypatch):
    if form == "joined":
        joined(monkeypatch)
    assert all(r.z is None for r in S.disambiguate(occurrences, model, min_prob=2.0).collect())


@pytest.mark.parametrize("form", ["kernel", "joined"])
def test_likelihood(spark, model, plain, form, monkeypatch):
    if form == "joined":
        joined(monkeypatch)
    pairs = [(1, 2, 3), (1, 9, 1), (5, 5, 2)]
    df = spark.createDataFrame(pairs, "x int, y int, n long")
    row = S.likelihood(df, model).first()
    values = [math.log(sum(p * math.exp(plain.ll(x, k + 1, y)) for k, p in enumerate(plain.pi(x)))) for x, y, _ in pairs]
    assert row.n == 6 and row["mean"] == pytest.approx(sum(v * n for v, (_, _, n) in zip(values, pairs)) / 6, abs=1e-6)
    none = S.likelihood(df.limit(0), model).first()
    assert (none["mean"], none.n) == (0.0, 0)


@pytest.mark.parametrize("form", ["kernel", "joined"])
def test_one_round(model, plain, occurrences, form, monkeypatch):
    if form == "joined":
        joined(monkeypatch)
    lr, d_in, d_out, w_in, w_out, z_sum, m = 0.025, {}, {}, {}, {}, {}, {}
    for _, x, ctx in CONTEXTS:
        z = plain.posterior(x, ctx, plain.logpi(x))
        z_sum[x] = z_sum.get(x, 0) + z
        m[x] = m.get(x, 0) + 1
        for y in ctx:
            for n, c in plain.path[y]:
                for k in range(1, SENSES + 1):
                    f = float(plain.vec[x, k] @ plain.out[n])
                    g = z[k - 1] * lr * (1 - c - 1 / (1 + math.exp(-f)))
                    d_in[x, k] = d_in.get((x, k), 0) + g * plain.out[n]
                    d_out[n] = d_out.get(n, 0) + g * plain.vec[x, k]
                    w_in[x, k] = w_in.get((x, k), 0) + z[k - 1]
                    w_out[n] = w_out.get(n, 0) + z[k - 1]
    sums = materialize(R.model_sums(occurrences, model, lr, 1e-32), "sums")
    cap = 2.0
    new_in, new_out = R.apply_gradients(model, sums, cap)
    for r in new_in.collect():
        key = (r.word_id, r.sense)
        step = d_in.get(key, np.zeros(DIM)) * min(1, cap / w_in[key]) if key in w_in else 0
        assert np.allclose(r.vec, plain.vec[key] + step, atol=1e-6)
    for r in new_out.collect():
        step = d_out[r.node_id] * min(1, cap / w_out[r.node_id]) if r.node_id in w_out else 0
        assert np.allclose(r.vec, plain.out[r.node_id] + step, atol=1e-6)
    for r in R.apply_counts(model, sums, lr).collect():
        before, keep = plain.counts[r.word_id], (1 - lr) ** m.get(r.word_id, 0)
        wanted = before if r.word_id not in m else before * keep + plain.freq[r.word_id] * z_sum[r.word_id] / m[r.word_id] * (1 - keep)
        assert np.allclose(r.counts, wanted, atol=1e-6)
        assert sum(r.counts) == pytest.approx(plain.freq[r.word_id])


def test_partitioning_does_not_matter(spark, model, occurrences):
    results = []
    for parts in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = R.model_sums(occurrences.repartition(int(parts)), model, 0.025).collect()
        results.append({(r.kind, r.id, r.sense): r.vec for r in rows if r.kind < 3})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0].keys() == results[1].keys()
    assert all(np.allclose(results[0][k], results[1][k]) for k in results[0])


def test_hot_words_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_ROWS", 50)
    rows = spark.range(2000).select(F.col("id").alias("occ_id"), F.lit(1).alias("x"), F.array(F.lit(2)).alias("ctx"))
    sizes = [r[0] for r in S.slice_occurrences(rows).select(F.size("occs")).collect()]
    assert sum(sizes) == 2000 and max(sizes) < 120


def test_argmax_takes_the_first(spark):
    z = spark.createDataFrame([(1, [0.4, 0.4, 0.2]), (2, None)], "occ_id long, z array<double>")
    assert [tuple(r) for r in S.argmax_sense(z).collect()] == [(1, 1)]


def test_unknown_words_are_dropped(spark, model, plain):
    asked = [(1, "w0", ["w1", "nowhere", "w2"]), (2, "nowhere", ["w1"]), (3, "w4", [])]
    rows = S.disambiguate_words(spark.createDataFrame(asked, "occ_id long, word string, context array<string>"), model)
    found = {r.occ_id: r.z for r in rows.collect()}
    assert set(found) == {1, 3}
    assert np.allclose(found[1], plain.posterior(1, [2, 3], np.log(plain.pi(1))), atol=1e-6)
    assert np.allclose(found[3], plain.pi(5), atol=1e-9)


def test_neighbours(spark, model, plain):
    rows = N.candidates(model.in_vec, model.sense_counts, 1.0)
    found = [tuple(r)[:2] for r in N.nearest_neighbors(rows, 1, 1, 5).collect()]
    q = plain.vec[1, 1] / np.linalg.norm(plain.vec[1, 1])
    sims = {k: v @ q / np.linalg.norm(v) for k, v in plain.vec.items() if plain.counts[k[0]][k[1] - 1] >= 1 and k != (1, 1)}
    assert found == sorted(sims, key=lambda k: (-sims[k], k))[:5]
    batch = N.nearest_neighbors_batch(rows, rows.filter("word_id = 1 and sense = 1"), 5).orderBy("rank")
    assert [(r.word_id, r.sense) for r in batch.collect()] == found
    assert N.nearest_neighbors(rows, 1, 1, 100).count() == len(sims)
    plan = N.nearest_to_vector(rows, [1.0] * DIM)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_many_blocks_give_the_same_neighbours(model, monkeypatch):
    rows = N.candidates(model.in_vec)
    one = sorted(tuple(r) for r in N.nearest_neighbors_batch(rows, rows, 3).select("query_id", "query_sense", "rank", "word_id", "sense").collect())
    monkeypatch.setattr(N, "BLOCK_ROWS", 4)
    many = sorted(tuple(r) for r in N.nearest_neighbors_batch(rows, rows, 3).select("query_id", "query_sense", "rank", "word_id", "sense").collect())
    assert one == many and len(one) == 27 * 3


def test_save_and_load(spark, model, tmp_path):
    M.save_model(model, str(tmp_path / "m"), 0.05)
    loaded = M.load_model(spark, str(tmp_path / "m"))
    assert (loaded.alpha, loaded.d, loaded.dim, loaded.senses) == (ALPHA, DISCOUNT, DIM, SENSES)
    kept = {(r.word_id, r.sense) for r in loaded.in_vec.collect()}
    inventory = {(r.word_id, r.sense) for r in M.sense_inventory(model, 0.05).collect()}
    assert kept == inventory and loaded.sense_counts.count() == 9
