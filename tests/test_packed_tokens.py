"""Tokens move packed: stretches of a chunk as lists, whatever the ids, gaps and repeated documents."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sensevec.operators import context as C
from sensevec.operators import kernel as K
from test_reading import words_of


def rows_of(spark):
    rng = random.Random(3)
    rows = []
    for doc in [5, 6, 6, None, 7, None, -1]:  # a document that comes twice, ids that are null
        rows += [(doc, (p - 1) // 10, p, rng.randrange(1, 9)) for p in range(1, 40) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "doc_id long, chunk_id int, pos int, word_id int")


def test_stretches_of_a_chunk_become_lists():
    batch = pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([1, 1, 1, 1, None, None, 1], pa.int64()),
            "chunk_id": pa.array([0, 0, 0, 1, 1, 1, 1], pa.int32()),
            "pos": pa.array([1, 2, 5, 6, 6, 7, 6], pa.int32()),
            "word_id": pa.array([9, 8, 7, 6, 5, 4, 3], pa.int32()),
        }
    )
    (out,) = K.chunk_packer(["word_id"])(iter([batch.slice(0, 0), batch]))
    assert out.column("doc_id").to_pylist() == [1, 1, None, 1]
    assert out.column("shift").to_pylist() == [[1, 1, 3], [6], [6, 6], [6]]
    assert out.column("word_id").to_pylist() == [[9, 8, 7], [6], [5, 4], [3]]
    (part,) = K.chunk_packer(["word_id"])(iter([batch.slice(2, 3)]))
    assert part.column("word_id").to_pylist() == [[7], [6], [5]]


def test_tokens_are_the_same_after_they_moved(spark):
    tokens = rows_of(spark)
    assert sorted(map(repr, C.unpacked(C.packed(tokens)).collect())) == sorted(map(repr, tokens.select("doc_id", "chunk_id", "pos", "word_id").collect()))
    assert C.unpacked(C.packed(tokens.filter("false"))).isEmpty()
    wide = tokens.withColumn("freq", F.col("word_id").cast("bigint") * 7)
    assert sorted(map(repr, C.unpacked(C.packed(wide)).collect())) == sorted(map(repr, wide.collect()))


def test_a_corpus_moves_once_and_packed(spark):
    tokens, vocab = words_of(spark, ["a b c d e f " * 8] * 30)
    words = tokens.join(F.broadcast(vocab.select("word_id", "word")), "word_id").select("doc_id", "pos", "word")
    plan = C.contexts(C.encode(words, vocab), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1  # windows find their chunks where they are
    assert plan.index("posexplode(shift") < plan.index("Exchange hashpartitioning(doc_id") < plan.index("MapInArrow")
    assert "REPARTITION_BY_NUM" in plan  # packed rows are small: merged at run time, a task would sort many times as many tokens
