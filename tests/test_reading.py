"""Reading order, word budgets, counts in order and steps that use all data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensevec.operators import context as C
from sensevec.operators import reading as RO
from sensevec.operators import train as R
from sensevec.operators import model as M
from sensevec.operators.vocab import build_vocab, lookup_words, word_count
from sensevec.plans.train import TrainParams, rounds_of, train, train_tokens
from sensevec.session import materialize
from sensevec.sources.corpus import scan_words
from test_train_stream import planted


def words_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = scan_words(docs)
    vocab = materialize(build_vocab(word_count(words), 1, 0), "vocab")
    return materialize(lookup_words(words, vocab).select("doc_id", "pos", "word_id", "freq"), "tokens"), vocab


def test_places_have_no_gaps_and_follow_the_text(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 60))) for _ in range(50)]
    tokens, _ = words_of(spark, texts)
    rows = RO.numbered(C.chunked(tokens, 16)).collect()
    ordered = sorted((r.doc_id, r.pos, r.at) for r in rows)
    assert [at for _, _, at in ordered] == list(range(len(rows)))


def test_followers_of_hot_and_rare_words(spark):
    rng = random.Random(5)
    rows = [(k % 3, rng.choice("aaaaab"), at) for k, at in enumerate(rng.sample(range(2000), 700))]
    df = spark.createDataFrame(rows, "round int, x string, at long")
    found = RO.followers(df, ["round", "x"], block_tokens=64).collect()
    for r in found:
        assert r.behind == sum(a == r.round and b == r.x and c > r["at"] for a, b, c in rows)
    assert len(found) == len(rows)


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_counts_equal_a_plain_loop(spark, limit):
    """One round over words with changing posteriors, occurrence by occurrence."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd") if k % 2 else rng.choice("efgh") for k in range(rng.randrange(5, 40))) for _ in range(25)]
    tokens, vocab = words_of(spark, texts)
    params = TrainParams(dim=6, senses=3, min_freq=1, rounds=1, start_lr=0.2, window=2)
    model = M.new_model(vocab, 6, 3)
    sharper = F.transform("vec", lambda v: (v * F.lit(30.0)).cast("float")).alias("vec")
    start = model.with_tables(in_vec=model.in_vec.select("word_id", "sense", sharper), out_vec=model.out_vec.select("node_id", sharper))
    even = model.sense_counts.select("word_id", F.transform("counts", lambda c: F.lit(2.0)).alias("counts"))
    start = start.with_tables(sense_counts=even)
    from sensevec.plans import train as plan

    placed = RO.numbered(C.chunked(tokens, params.batch))
    occ = plan.occurrences(placed, params)
    path = plan.scratch_path(spark, "slices")
    plan.write_slices(occ, params, path, 1)
    runner = plan.RoundRunner(start, params, limit)
    runner.run(spark.read.parquet(path).select("x", "slice", "occs"), 0.2, 0, 0, 1.0)
    found = {r.word_id: r.counts for r in runner.current().sense_counts.collect()}
    z = {tuple(r.occ_id): r.z for r in R.train_posteriors(occ.select("occ_id", "x", "ctx"), start).collect()}
    wanted = {r.word_id: np.full(3, 2.0) for r in vocab.collect()}
    for r in sorted(occ.collect(), key=lambda r: r["at"]):
        wanted[r.x] += 0.2 * (np.array(z[tuple(r.occ_id)]) * r.freq - wanted[r.x])
    assert np.ptp([v for v in z.values()], axis=0).max() > 0.2
    for w, counts in wanted.items():
        assert found[w] == pytest.approx(counts, rel=1e-9, abs=1e-9)


def test_budget_is_met_to_the_word(spark):
    tokens, vocab = words_of(spark, [t for _, t, _ in planted(1, 40)])
    total = tokens.count()
    for epochs in (0.5, 1, 2.3):
        runner = train_tokens(tokens, vocab, TrainParams(dim=3, senses=2, min_freq=1, rounds=2, epochs=epochs, window=2))
        assert runner.words_read == round(total * epochs)
        assert sum(h[3] for h in runner.history) == round(total * epochs)
        assert runner.history[-1][-1] == pytest.approx(1.0)
    assert train_tokens(tokens, vocab, TrainParams(dim=3, senses=2, min_freq=1, epochs=0)).history == []


def test_budget_of_a_larger_dictionary_wraps_round(spark):
    assert RO.passes(25, 10) == [10, 10, 5] and RO.passes(10, 10) == [10] and RO.passes(4, 10) == [4]
    assert RO.passes(0, 10) == [] and RO.passes(10, 0) == []
    assert rounds_of(10**9, TrainParams()) == 64 and rounds_of(10**10, TrainParams()) == 500
    assert rounds_of(1000, TrainParams(), 0.5) == 32


def test_a_frequent_row_moves_no_less():
    """100 times the gradient is the same step, and every element of it counts."""
    grads = np.random.default_rng(1).normal(size=(30, 5)) + 0.5
    for scale in (1.0, 100.0):
        acc, moved = 0.0, 0.0
        for g in grads * scale:
            acc = acc + g**2
            moved = moved + 0.3 * g / np.sqrt(acc)
        if scale == 1.0:
            first = moved
    assert moved == pytest.approx(first)


def test_adaptive_step_in_columns(spark):
    rows = [([1.0, 2.0], [0.5, 0.0], None), ([1.0, 2.0], None, [4.0, 1.0]), ([0.0, 0.0], [0.02, -0.02], [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec array<double>, g array<double>, acc array<double>")
    lr, pace = 0.02, 10.0
    df = df.withColumn("acc", R.squared_sum(F.col("acc"), F.col("g"), lr))
    got = df.select("acc", R.adaptive_step(F.col("vec"), F.col("g"), F.col("acc"), pace).alias("v")).collect()
    assert got[0].v == pytest.approx([1.0 + 0.2, 2.0]) and got[1].v == [1.0, 2.0] and got[1].acc == [4.0, 1.0]
    assert got[2].acc == pytest.approx([4.0, 1.0]) and got[2].v == pytest.approx([0.1, -0.2])


@pytest.mark.parametrize("size", [1000, 10000])
def test_two_senses_with_default_settings(spark, size):
    """One epoch, default parameters but for the width: the ambiguous word has two senses whatever the size."""
    docs = materialize(spark.createDataFrame(planted(1, size), "doc_id long, text string, topic string").select("doc_id", "text"), "planted")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    runner = train(docs, TrainParams(dim=20))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    model = runner.current()
    priors = M.sense_priors(model).join(model.vocab, "word_id").select("word", "pi").collect()
    found = {r.word: sum(p > 0.3 for p in r.pi) for r in priors}
    some = {r.word: sum(p >= 1e-3 for p in r.pi) for r in priors}
    assert found["apple"] == 2
    assert np.mean([n for w, n in some.items() if w != "apple"]) < 1.2
    assert runner.history[-1][5] > -3.72 and runner.history[0][5] < -4.2
