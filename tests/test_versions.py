"""Models are published whole or not at all; stream versions are retired; likelihood by document."""

import re

import pytest
from pyspark.sql import functions as F

from sensevec.operators import context as C
from sensevec.operators import model as M
from sensevec.operators import score as S
from sensevec.operators import versions as V
from sensevec.operators.vocab import build_vocab, lookup_words, word_count
from sensevec.plans.train import TrainingDiverged, TrainParams, train_tokens
from sensevec.session import materialize
from sensevec.sources.corpus import scan_words
from sensevec.streaming.train import StreamTrainer
from test_train_stream import planted


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame(planted(1, 60), "doc_id long, text string, topic string").select("doc_id", "text")
    words = scan_words(docs)
    vocab = materialize(build_vocab(word_count(words), 1, 0), "vocab")
    tokens = materialize(lookup_words(words, vocab).select("doc_id", "pos", "word_id", "freq"), "tokens")
    model = M.new_model(vocab, 4, 2)
    return docs, tokens, vocab, model.with_tables(tree=materialize(model.tree, "tree"))


def vectors(model):
    return {(r.word_id, r.sense): r.vec for r in model.in_vec.collect()}


def test_a_failed_save_leaves_the_old_model(spark, small, tmp_path):
    model, path = small[3], str(tmp_path / "model")
    M.save_model(model, path, 0.0)
    before = vectors(M.load_model(spark, path))
    broken = model.with_tables(
        in_vec=model.in_vec.withColumn("vec", F.transform("vec", lambda v: v + 1)),
        sense_counts=model.sense_counts.withColumn("counts", F.when(F.col("word_id") > 0, F.raise_error(F.lit("killed")).cast("array<double>"))),
    )
    with pytest.raises(Exception, match="killed"):
        M.save_model(broken, path, 0.0)
    assert vectors(M.load_model(spark, path)) == before
    for step in range(1, 4):
        moved = model.with_tables(in_vec=model.in_vec.withColumn("vec", F.transform("vec", lambda v: v + step)))
        M.save_model(moved, path, 0.0)
        assert vectors(M.load_model(spark, path)) != before
    assert len(V.entries(spark, path)) == V.KEEP
    assert len([p for p in (tmp_path / "model").iterdir() if p.name.startswith("version-")]) == V.KEEP + 1  # and the failed one
    with pytest.raises(FileNotFoundError):
        M.load_model(spark, str(tmp_path / "nothing"))


def test_stream_versions_are_bounded_and_guarded(spark, small, tmp_path):
    docs, _, _, model = small
    trainer = StreamTrainer(model, TrainParams(dim=4, senses=2, min_freq=1), str(tmp_path / "versions"), 5000.0)
    for batch in range(4):
        trainer.step(docs.filter(F.col("doc_id") % 4 == batch), batch)
    assert {p.name for p in (tmp_path / "versions").iterdir()} == {f"version-{v}{s}" for v in (1, 2, 3) for s in ("", "-read")}
    assert trainer.words_read(3) == 60 * 12
    wild = StreamTrainer(model, TrainParams(dim=4, senses=2, min_freq=1, start_lr=1e305), str(tmp_path / "wild"), 5000.0)
    with pytest.raises(TrainingDiverged):
        for batch in range(4):
            wild.step(docs.filter(F.col("doc_id") % 4 == batch), batch)


def test_words_a_second(small):
    _, tokens, vocab, _ = small
    runner = train_tokens(tokens, vocab, TrainParams(dim=4, senses=2, min_freq=1, rounds=2))
    rows = runner.speed().collect()
    assert len(rows) == 2
    assert all(r.kwords_per_second * r.seconds * 1000 == pytest.approx(h[3]) for r, h in zip(rows, runner.history))


def test_likelihood_by_group_in_both_forms(spark, small):
    docs, tokens, vocab, model = small
    sharper = F.transform("vec", lambda v: (v * F.lit(20.0)).cast("float")).alias("vec")
    model = model.with_tables(in_vec=model.in_vec.select("word_id", "sense", sharper))
    pairs = C.context_pairs(C.chunked(tokens, 7), 2)
    counted = materialize(C.pair_counts(pairs, "doc_id", "chunk_id"), "counted")
    kernel = S.likelihood_by(counted, model, "doc_id", "chunk_id")
    values = S.pair_values(counted.select("x", "y").distinct(), model).drop("n")
    plain = S.weighted_mean(counted.join(values, ["x", "y"]), "doc_id", "chunk_id")
    want = {(r.doc_id, r.chunk_id): (r["mean"], r.n) for r in plain.collect()}
    got = {(r.doc_id, r.chunk_id): (r["mean"], r.n) for r in kernel.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    more = docs.select("doc_id").union(spark.createDataFrame([(999,)], "doc_id long"))
    by_doc = {r.doc_id: (r["mean"], r.n) for r in S.likelihood_by(counted.drop("chunk_id"), model, "doc_id", groups=more).collect()}
    assert by_doc[999] == (0.0, 0) and len(by_doc) == 61 and all(n > 0 for d, (_, n) in by_doc.items() if d != 999)
    plan = S.likelihood_by(counted, model, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(x#\d+, y#", plan)  # nothing is joined back by pair
