"""A hot word meets its vectors by word and slice, not by word alone, where these are too many for a broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from sensevec.operators import context as C
from sensevec.operators import model as M
from sensevec.operators import score as S
from sensevec.operators import train as R
from sensevec.operators.vocab import build_vocab, lookup_words, word_count
from sensevec.session import materialize
from sensevec.sources.corpus import scan_words
from test_train_stream import planted


def test_rows_of_a_hot_word_stay_spread(spark, monkeypatch):
    docs = spark.createDataFrame(planted(3, 80), "doc_id long, text string, topic string")
    words = scan_words(docs)
    vocab = materialize(build_vocab(word_count(words), 1, 0), "vocab")
    tokens = materialize(lookup_words(words, vocab).select("doc_id", "pos", "word_id", "freq"), "tokens")
    model = M.new_model(vocab, 4, 2)
    model = model.with_tables(tree=materialize(model.tree, "tree"))
    around = C.contexts(C.chunked(tokens), 2)
    occ = materialize(around.select(F.struct("doc_id", "pos").alias("occ_id"), F.col("word_id").alias("x"), "ctx", "freq"), "occ")
    z = {tuple(r.occ_id): r.z for r in S.posteriors(occ, model, "logpi").collect()}
    sums = {(r.kind, r.id, r.sense): r.vec for r in R.model_sums(occ, model, 0.1).collect()}
    monkeypatch.setattr(S, "SIDE_BYTES", 0)
    monkeypatch.setattr(S, "SLICE_ROWS", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = S.posteriors(occ, model, "logpi")
        plan = spread._jdf.queryExecution().executedPlan().toString()
        again = {tuple(r.occ_id): r.z for r in spread.collect()}
        moved = {(r.kind, r.id, r.sense): r.vec for r in R.model_sums(occ, model, 0.1).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert again.keys() == z.keys() and all(again[k] == pytest.approx(z[k]) for k in z)
    assert moved.keys() == sums.keys() and all(moved[k] == pytest.approx(sums[k]) for k in sums)
    # the exchange that feeds the kernel's big side is by word and slice
    assert re.search(r"hashpartitioning\(x#\d+, slice#\d+L", plan)
