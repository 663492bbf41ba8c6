"""Near-duplicates: texts that no join needs stay where they are."""

import random

from pyspark.sql import functions as F

from sensevec.llm import near_text
from sensevec.llm.common import materialize, possible_keys


def test_a_filter_of_keys_misses_none(spark):
    keys = materialize(spark.range(0, 3000, 7).select(F.xxhash64("id").alias("k")), "keys")
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("k"))
    found = {r.id: r.some for r in possible_keys(rows, "k", keys, "some").collect()}
    assert len(found) == 3000 and all(found[i] for i in range(0, 3000, 7))
    assert sum(found.values()) < 800
    none = possible_keys(rows, "k", keys.limit(0), "some")
    assert none.filter("some").isEmpty() and none.count() == 3000


def test_kept_texts_are_not_shuffled(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(400)]
    copies = [texts[k] + " end" for k in range(0, 400, 8)]
    # copies, a row that comes twice, null ids and a null text
    rows = [*enumerate(texts + copies), (3, texts[3]), (None, texts[9]), (None, None), (None, None)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit("x")), "docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_text.one_of_each(docs)
        assert kept.columns == docs.columns
        out = kept.collect()
        moved = kept._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "__bits" in moved
    assert len(out) == 401 and sorted((r.doc_id, r.text) for r in out if r.doc_id is not None) == sorted(enumerate(texts))
    assert [(r.doc_id, r.text) for r in out if r.doc_id is None] == [(None, None)]
