"""Tasks that count pairs by chunk have a bounded number of tokens, so neither counts nor windows grow with the corpus."""

import pytest
from pyspark.sql import functions as F

from sensevec.catalog.queries import all_queries
from sensevec.operators import context as C
from sensevec.operators import model as M
from sensevec.plans import likelihood as L
from test_reading import words_of


def test_pairs_are_counted_in_more_tasks_than_shuffles_have(spark, fixture, monkeypatch):
    keys = ["doc_id", "chunk_id"]
    plain = sorted(map(tuple, C.pair_counts(C.context_pairs(fixture.kept(), 4), *keys).collect()))
    monkeypatch.setattr(C, "PAIR_TOKENS", fixture.vocab.agg(F.sum("freq")).first()[0] // 30)
    counted = C.pair_counts(fixture.pairs(), *keys)
    assert sorted(map(tuple, counted.collect())) == plain
    # there were as many as shuffles have, eight
    assert counted.select(F.spark_partition_id().alias("p")).distinct().count() > 16


def test_whole_documents_are_shuffled_once(spark, folder):
    plan = all_queries()["parallel_likelihood"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 2  # tokens and the sums; tokens went twice, by two kinds of chunks


def test_held_out_text_is_dealt_by_its_own_words(spark, monkeypatch):
    tokens, vocab = words_of(spark, ["a b c d a b"] * 3)
    model = M.new_model(vocab, 4, 2, 0.1, 0.0)
    docs = spark.createDataFrame([(k % 50, "a b zz c d " * 4) for k in range(100)] + [(None, "a b"), (7, None)], "doc_id long, text string")
    wanted = {(r.x, r.y): r["count"] for r in L.text_pairs(docs, model, 2).groupBy("x", "y").count().collect()}
    monkeypatch.setattr(C, "PAIR_TOKENS", 60)
    pairs = L.text_pairs(docs, model, 2)
    assert {(r.x, r.y): r["count"] for r in pairs.groupBy("x", "y").count().collect()} == wanted
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 16
    whole, merged = L.text_likelihood(docs, model, 2).first(), L.parallel_likelihood(docs, model, 2).first()
    assert whole.n == merged.n > 0 and whole["mean"] == pytest.approx(merged["mean"])
