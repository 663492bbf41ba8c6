"""Ranks in reading order move each token twice: to its stretch of the corpus and to its block; nothing is joined by word."""

import random

import pytest
from pyspark.sql import functions as F

from sensevec.catalog.queries import all_queries
from sensevec.operators import context as C
from sensevec.operators import reading as RO
from test_reading import words_of


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    tokens, vocab = words_of(spark, [" ".join(rng.choice("aaab" if k % 3 else "cdef") for k in range(rng.randrange(0, 70))) for _ in range(60)])
    words = tokens.join(vocab.select("word_id", "word"), "word_id").select("doc_id", "pos", "word")
    # one document comes twice, one has no id
    twice = words.filter("doc_id = 7")
    nameless = words.filter("doc_id = 8").withColumn("doc_id", F.lit(None).cast("bigint"))
    return words.unionByName(twice).unionByName(nameless), vocab, tokens.count()


def ordered(words, vocab):
    return C.encode(words, vocab, 16, in_order=True, freq=False)


@pytest.mark.parametrize("tasks", [4, 24])
def test_stretches_are_numbered_where_they_are(spark, corpus, monkeypatch, tasks):
    words, vocab, total = corpus
    monkeypatch.setattr(C, "TASK_TOKENS", total // tasks)
    encoded = ordered(words, vocab)
    assert encoded.columns == ["doc_id", "chunk_id", "pos", "word_id"]
    placed = RO.numbered(encoded, in_order=True)
    rows = placed.collect()
    # what has no id has no place, as without ``in_order``
    assert len(rows) == RO.numbered(C.encode(words, vocab, 16)).count() == words.filter("doc_id IS NOT NULL").count()
    assert [r["at"] for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_id, r.pos))] == list(range(len(rows)))
    place = {(r.doc_id, r.chunk_id, r.pos): r["at"] for r in rows}
    stretches = {}
    for r in spark.read.parquet(*placed.inputFiles()).withColumn("file", F.input_file_name()).collect():
        stretches.setdefault(r.file, []).append(place[r.doc_id, r.chunk_id, r.pos])
    assert all(max(at) - min(at) + 1 == len(at) for at in stretches.values())
    assert len(stretches) > 8 == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert encoded.rdd.getNumPartitions() == C.stretches_of(vocab) >= max(tasks, 16)


@pytest.mark.parametrize("block", [1, 64, 1 << 20])
@pytest.mark.parametrize("order", [None, ["doc_id", "chunk_id", "pos"]])
def test_ranks_equal_a_plain_loop(corpus, block, order):
    words, vocab, _ = corpus
    placed = RO.numbered(ordered(words, vocab), in_order=True)
    found = RO.followers(placed, ["word_id"], block, 5, order).collect()
    seen, wanted = {}, {}
    rows = placed.collect()
    for r in sorted(rows, key=lambda r: -r["at"]):
        key = (r.doc_id, r.chunk_id, r.pos)
        wanted[key] = (r.word_id, seen.get(r.word_id, 0))
        seen[r.word_id] = seen.get(r.word_id, 0) + 1
    assert len(found) == len(rows) == len(wanted)
    assert {(r.doc_id, r.chunk_id, r.pos): (r.word_id, r.behind) for r in found} == wanted


def test_rows_without_key_or_place_are_left_out(spark):
    rows = [(1, "a", 0), (1, "a", 3), (1, None, 1), (None, "a", 2), (1, "a", None)]
    df = spark.createDataFrame(rows, "round int, x string, at long")
    assert sorted((r["at"], r.behind) for r in RO.followers(df, ["round", "x"], 2).collect()) == [(0, 1), (3, 0)]


def test_tokens_are_not_shuffled_by_word(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = all_queries()["later_occurrences"](spark, folder)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "SortMergeJoin" not in plan
    assert sum("hashpartitioning(block" in line for line in moved) == 1
