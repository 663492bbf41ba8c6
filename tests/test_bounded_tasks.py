"""What a task sorts does not grow with the corpus: few words per context, counts per document, chunks dealt by their number."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sensevec.catalog.queries import all_queries
from sensevec.operators import context as C
from sensevec.operators import kernel as K
from sensevec.operators import wsi
from test_reading import words_of


def test_heads_of_runs():
    batch = pa.RecordBatch.from_pydict({"run": np.array([1, 1, 1, 2, 2, 2, 2, 1]), "i": np.array([0, 4, 5, 0, 3, 1, 2, 9]), "v": list("abcdefgh")})
    (kept,) = K.run_heads(2)(iter([batch]))
    assert kept.schema.names == ["i", "v"] and kept.column("v").to_pylist() == list("abdefgh")


def test_only_the_nearest_words_are_sorted(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["a", "b", "c", "d", "zz"]) for _ in range(rng.randrange(60)))
    # a key that comes twice, and one that is null
    rows = [(k, n, text(), text()) for k, n in [("a.n", 1), ("a.n", 1), ("b.n", 2), (None, 3), ("c.n", None)]]
    instances = spark.createDataFrame(rows, "key string, instance int, left string, right string")
    vocab = spark.createDataFrame([(k + 1, w, 9) for k, w in enumerate("abcd")], "word_id int, word string, freq long")
    near = wsi.context_words(instances, vocab, 3, ["key", "instance"])
    plan = near._jdf.queryExecution().executedPlan().toString()
    # words leave for the sort after the kernel
    assert plan.index("Window") < plan.index("MapInArrow")
    wanted = {}
    for key, n, left, right in rows:
        for side, words in (("left", left.split()[::-1]), ("right", right.split())):
            wanted.setdefault((key, n, side), []).extend(i for i, w in enumerate(words) if w != "zz")
    found = {}
    for r in near.collect():
        found.setdefault((r.key, r.instance, r.side), []).append(r.r)
    assert {k: sorted(v) for k, v in found.items()} == {k: list(range(1, min(3, len(v)) + 1)) for k, v in wanted.items() if v}


def test_languages_meet_documents_not_tokens(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = all_queries()["lr_schedule"](spark, folder)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"HashAggregate\(keys=\[doc_id", plan)


def test_chunks_are_dealt_to_more_tasks(spark, monkeypatch):
    tokens, vocab = words_of(spark, ["a b c d " * 5] * 40)
    words = tokens.join(vocab.select("word_id", "word"), "word_id").select("doc_id", "pos", "word")
    plain = {tuple(r) for r in C.encode(words, vocab).collect()}
    total = vocab.agg(F.sum("freq")).first()[0]
    monkeypatch.setattr(C, "TASK_TOKENS", total // 12)
    encoded = C.encode(words, vocab)
    assert {tuple(r) for r in encoded.collect()} == plain
    sizes = encoded.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 8 == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lines_with_text_are_not_shuffled_to_their_heads(spark, tmp_path):
    from sensevec.sources import nested as NS
    from sensevec.sources.wsi import NESTED_SCHEMA

    contexts = [(k, ["a", "b", f"c{k}"]) for k in range(3)]
    records = [(w, w, 5, [("s", 1, contexts), ("t", 2, contexts[:1])]) for w in ("x", "y", "y")]
    path = str(tmp_path / "nested")
    NS.write_nested(spark.createDataFrame(records, NESTED_SCHEMA), path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = NS.read_nested(spark, path)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        found = sorted((r.word, r.sense, r.context_id, r.position, tuple(r.words)) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wanted = [(w, s, k + 1, c[0], tuple(c[1])) for w in ("x", "y", "y") for s, n in (("s", 3), ("t", 1)) for k, c in enumerate(contexts[:n])]
    assert found == sorted(wanted)
    assert "hashpartitioning(line_no" not in plan
