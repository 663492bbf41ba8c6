"""Training end to end on a planted corpus, and streams against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from sensevec.operators import model as M
from sensevec.operators import score as S
from sensevec.operators.vocab import build_vocab, lookup_words, word_count
from sensevec.plans import evaluate as EV
from sensevec.plans import likelihood as L
from sensevec.plans.train import TrainingDiverged, TrainParams, train, train_job, train_tokens
from sensevec.session import materialize
from sensevec.sources.corpus import scan_words
from sensevec.streaming import counts as SC
from sensevec.streaming import score as SS
from sensevec.streaming.train import StreamTrainer

TOPICS = {"fruit": [f"a{i}" for i in range(40)], "machine": [f"b{i}" for i in range(40)]}


def planted(seed, size):
    """Documents of one topic each, with an ambiguous word in the middle."""
    rng, rows = random.Random(seed), []
    for i in range(size):
        topic = rng.choice(sorted(TOPICS))
        words = [rng.choice(TOPICS[topic]) for _ in range(12)]
        words[6] = "apple"
        rows.append((i, " ".join(words), topic))
    return rows


@pytest.fixture(scope="module")
def corpus(spark):
    return materialize(spark.createDataFrame(planted(1, 1000), "doc_id long, text string, topic string"), "planted")


@pytest.fixture(scope="module")
def trained(spark, corpus):
    # a hundred rounds over a small corpus: few tasks per round keep the test short
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    params = TrainParams(dim=20, senses=5, min_freq=1, epochs=20, rounds=5, cap=250.0)
    runner = train(corpus.select("doc_id", "text"), params)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return runner


def test_planted_senses_are_found(spark, trained):
    model = trained.current()
    senses = M.sense_priors(model).join(model.vocab, "word_id").select(
        "word", F.size(F.filter("pi", lambda p: p >= 1e-3)).alias("n"), "pi"
    )
    apple = senses.filter("word = 'apple'").first()
    assert sum(p > 0.3 for p in apple.pi) == 2
    assert senses.filter("word <> 'apple'").agg(F.avg("n")).first()[0] < 1.2
    held = spark.createDataFrame(planted(2, 200), "occ_id long, text string, topic string")
    words = F.split("text", " ")
    context = F.concat(F.slice(words, 3, 4), F.slice(words, 8, 4))
    asked = held.select("occ_id", F.lit("apple").alias("word"), context.alias("context"))
    best = S.argmax_sense(S.disambiguate_words(asked, model)).join(held, "occ_id")
    rows = {(r.topic, r.sense): r["count"] for r in best.groupBy("topic", "sense").count().collect()}
    pure = sum(max((rows.get((t, k), 0) for t in TOPICS)) for k in range(1, 6))
    assert pure / sum(rows.values()) > 0.95


def test_training_improves_and_keeps_counts(trained):
    rows = trained.metrics().orderBy("epoch", "round").collect()
    assert len(rows) == 100 and rows[-1].mean_ll > rows[0].mean_ll + 0.2
    assert [r.lr for r in rows] == sorted((r.lr for r in rows), reverse=True)
    assert sum(r.occurrences for r in rows[:5]) == 12_000
    model = trained.current()
    drift = model.sense_counts.join(model.vocab, "word_id").select(
        F.abs(F.aggregate("counts", F.lit(0.0), lambda a, c: a + c) - F.col("freq")).alias("e")
    )
    assert drift.agg(F.max("e")).first()[0] < 1e-6


def test_statistics_of_a_round_in_both_forms(spark, corpus):
    docs = corpus.filter("doc_id < 30").select("doc_id", "text")
    vocab = materialize(build_vocab(word_count(scan_words(docs)), 1, 0), "vocab")
    tokens = materialize(lookup_words(scan_words(docs), vocab).select("doc_id", "pos", "word_id", "freq"), "tokens")
    params = TrainParams(dim=4, senses=2, min_freq=1, rounds=1)
    kernel, joined = (train_tokens(tokens, vocab, params, limit).metrics().first() for limit in (1 << 28, 0))
    assert tuple(joined) == pytest.approx(tuple(kernel))
    assert kernel.pairs > 0 and kernel.occurrences == tokens.count()


def test_divergence_is_reported(corpus):
    params = TrainParams(dim=20, senses=5, min_freq=1, epochs=1, rounds=4, cap=None, start_lr=1e305)
    with pytest.raises(TrainingDiverged):
        train(corpus.select("doc_id", "text"), params)


def test_train_job_and_held_out_likelihood(spark, corpus, trained, tmp_path):
    corpus.write.parquet(str(tmp_path / "corpus"))
    stop = tmp_path / "stop.txt"
    stop.write_text("a0\nb0\n")
    params = TrainParams(
        dim=8, senses=2, min_freq=1, rounds=2, epochs=2, context_cut=True, subsample=1e-2, regex="^[ab]", cap=50.0
    )
    metrics = train_job(spark, str(tmp_path / "corpus"), str(tmp_path / "model"), params, str(stop))
    assert metrics.count() == 4
    model = M.load_model(spark, str(tmp_path / "model"))
    words = {r.word for r in model.vocab.collect()}
    assert "a0" not in words and "a1" in words and "apple" in words
    held = spark.createDataFrame(planted(3, 50), "doc_id long, text string, topic string")
    whole = L.text_likelihood(held, trained.current(), window=4).first()
    merged = L.parallel_likelihood(held, trained.current(), window=4, log_path=str(tmp_path / "log")).first()
    assert whole["mean"] == pytest.approx(merged["mean"]) and whole.n == merged.n > 0
    assert whole["mean"] > L.text_likelihood(held, model, window=4).first()["mean"]
    assert spark.read.parquet(str(tmp_path / "log")).count() == 50


def test_evaluation_job(spark, trained):
    rows = planted(4, 100)
    parts = [(t, " ".join(x.split()[:6]), " ".join(x.split()[7:]), i) for i, x, t in rows]
    instances = spark.createDataFrame(
        [(f"set{i % 2}", "apple.n", i, left, right) for _, left, right, i in parts],
        "dataset string, key string, instance int, left string, right string",
    )
    answers = spark.createDataFrame(
        [(f"set{i % 2}", "apple.n", i, t) for t, _, _, i in parts],
        "dataset string, key string, instance int, sense string",
    )
    out = EV.evaluate_instances(instances, answers, trained.current()).orderBy("dataset").collect()
    assert [r.dataset for r in out] == ["set0", "set1"]
    assert all(r.mean_ari > 0.9 and r.mean_v > 0.9 and r.mean_f > 0.9 and r.one_sense_keys == 0 for r in out)


def test_stream_counts(spark, folder, fixture):
    streamed = SC.count_available(spark, folder, "documents.parquet")
    batch = word_count(fixture.words())
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_stream_scores(spark, fixture, trained):
    held = spark.createDataFrame(planted(5, 40), "doc_id long, text string, topic string")
    model = trained.current()
    ids = model.vocab.select("word", "word_id")
    tokens = scan_words(held).join(ids, "word")
    occurrences = tokens.groupBy("doc_id").agg(
        F.max(F.when(F.col("word") == "apple", F.col("word_id"))).alias("x"),
        F.collect_list(F.when(F.col("word") != "apple", F.col("word_id"))).alias("ctx"),
    ).withColumnRenamed("doc_id", "occ_id")
    occurrences = materialize(occurrences.repartition(3), "occ")
    streamed = {r.occ_id: r.z for r in SS.score_available(spark, occurrences, model).collect()}
    batch = {r.occ_id: r.z for r in S.disambiguate(occurrences, model).collect()}
    assert streamed.keys() == batch.keys()
    assert all(streamed[k] == pytest.approx(batch[k]) for k in batch)


def test_stream_training_replays_to_the_same_model(spark, corpus, tmp_path):
    docs = corpus.select("doc_id", "text")
    vocab = materialize(build_vocab(word_count(scan_words(docs)), 1, 0), "vocab")
    model = M.new_model(vocab, 8, 2)
    model = model.with_tables(tree=materialize(model.tree, "tree"))
    params = TrainParams(dim=8, senses=2, min_freq=1, cap=50.0)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    trainer = StreamTrainer(model, params, str(tmp_path / "versions"), 12_000.0)
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    trainer.start(source, str(tmp_path / "progress")).awaitTermination()
    assert trainer.words_read(2) == 12_000

    def numbers(version):
        rows = trainer.state(version).filter("kind < 3").collect()
        return {(r.kind, r.id, r.sense): r.vec for r in rows}

    before = numbers(2)
    last = [p for p in (tmp_path / "in").glob("*.parquet")]
    # the batch that came last is found by trying: exactly one file reproduces version 2 from version 1
    same = 0
    for path in last:
        trainer.step(spark.read.schema(docs.schema).parquet(str(path)), 2)
        again = numbers(2)
        same += all(again[k] == pytest.approx(before[k], abs=1e-12) for k in before)
    assert same == 1
