"""Frequent values from sketches, and words that meet a large vocabulary by head and tail."""

import random
import re
from collections import Counter

from sensevec.operators import hitters
from sensevec.operators import vocab as V


def test_no_frequent_value_is_missed(spark):
    rng = random.Random(2)
    rows = ["hot"] * 9000 + ["warm"] * 400 + [f"w{int(rng.paretovariate(0.6)) % 40_000}" for _ in range(20_000)] + [None] * 5000
    rng.shuffle(rows)
    df = spark.createDataFrame([(r,) for r in rows], "w string").repartition(7)
    counts = Counter(r for r in rows if r is not None)
    total = sum(counts.values())
    for share, counters in ((0.01, 400), (0.002, 2000), (0.25, 8)):
        found = {r.value for r in hitters.frequent(df, "w", share, counters).collect()}
        assert {w for w, n in counts.items() if n >= share * total} <= found
        assert len(found) < 1 / (share - 1 / counters) and found <= set(counts)
    assert hitters.frequent(df.filter("w is null"), "w").count() == 0
    assert hitters.frequent(df.filter("false"), "w").count() == 0


def test_head_and_tail_give_the_same_rows(spark, monkeypatch):
    words = [(k, "the" if k % 3 else f"w{k % 900}" if k % 2 else "unknown") for k in range(6000)]
    df = spark.createDataFrame(words, "pos int, word string")
    vocab = spark.createDataFrame([(k + 1, w, 7) for k, w in enumerate(["the", *(f"w{k}" for k in range(0, 900, 9))])], "word_id int, word string, freq int")
    small = sorted(map(tuple, V.lookup_words(df, vocab).select("pos", "word", "word_id", "freq").collect()))
    monkeypatch.setattr(V, "BROADCAST_WORDS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = V.lookup_words(df, vocab).select("pos", "word", "word_id", "freq")
        rows = sorted(map(tuple, large.collect()))
        plan = large._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == small and len(rows) > 4000
    # the vocabulary is shuffled once and not multiplied, the frequent words are filtered before they would be shuffled
    assert not re.search(r"explode|Generate", plan)
    assert plan.count("LeftAnti") >= 1
