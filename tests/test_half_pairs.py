"""Pairs of words are counted once for both directions, and likelihoods take them counted in any parts."""

import pytest
from pyspark.sql import functions as F

from sensevec.catalog.queries import all_queries
from sensevec.operators import context as C
from sensevec.operators import score as S
from test_row_scores import model  # noqa: F401


def test_both_directions(spark):
    docs = [[1, 2, 1, 1, 3], [2, 2, 2, 2], [5], [], [1, 3, 1, 4, 4, 2, 1]]
    rows = [(d if d else None, 0, p + 1, w) for d, ws in enumerate(docs) for p, w in enumerate(ws)]
    rows += [rows[0], (9, 0, 1, 1), (9, 1, 1, 2), (9, 1, 2, 1)]
    tokens = spark.createDataFrame(rows, "doc_id long, chunk_id int, pos int, word_id int")
    half = C.later_pairs(tokens, 3)
    every = C.context_pairs(tokens, 3)
    assert 2 * half.count() == every.count() > 0
    found = C.both_ways(C.pair_counts(half))
    wanted = C.pair_counts(every)
    assert found.dtypes == wanted.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_likelihood_of_pairs_counted_in_parts(spark, model, monkeypatch):  # noqa: F811
    parts = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (5, 1, 2), (9, 9, 1), (5, 1, 1)], "x int, y int, n long")
    whole = parts.groupBy("x", "y").agg(F.sum("n").alias("n"))
    wanted = S.likelihood(whole, model).first()
    for side, nodes in ((None, None), (0, None), (0, 0)):
        if side is not None:
            monkeypatch.setattr(S, "SIDE_BYTES", side)
        if nodes is not None:
            monkeypatch.setattr(S, "BROADCAST_BYTES", nodes)
        found = S.likelihood(parts, model).first()
        assert found.n == wanted.n == 11 and found["mean"] == pytest.approx(wanted["mean"], rel=1e-9)


def test_likelihood_shuffles_no_pairs(spark, folder):
    plan = all_queries()["likelihood"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(x" not in plan
