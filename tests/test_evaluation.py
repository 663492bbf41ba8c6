import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sensevec.operators import metrics as E
from sensevec.operators import neighbors as N
from sensevec.operators import summation as K
from sensevec.operators import wsi
from sensevec.sources import vectors as XS
from sensevec.sources import wsi as WS
from sensevec.sources.corpus import read_text


def labels(spark, truth, pred, key="k"):
    rows = [(key, i, str(a), str(b)) for i, (a, b) in enumerate(zip(truth, pred))]
    return spark.createDataFrame(rows, "key string, instance int, truth string, pred string")


def by_pairs(truth, pred):
    same = lambda ls: {p for p in itertools.combinations(range(len(ls)), 2) if ls[p[0]] == ls[p[1]]}
    a, b = same(truth), same(pred)
    p, r = len(a & b) / len(b), len(a & b) / len(a)
    return 2 * p * r / (p + r)


def test_scores_against_pair_sets(spark):
    rng = random.Random(5)
    truth = [rng.randint(0, 2) for _ in range(60)]
    pred = [t if rng.random() < 0.6 else rng.randint(0, 3) for t in truth]
    row = E.scores(labels(spark, truth, pred), "key").first()
    assert row.f == pytest.approx(by_pairs(truth, pred))
    renamed = E.scores(labels(spark, [f"t{t}" for t in truth], [9 - p for p in pred]), "key").first()
    assert (row.ari, row.v, row.f) == pytest.approx((renamed.ari, renamed.v, renamed.f))


@pytest.mark.parametrize(
    "truth, pred, ari, v, f",
    [
        ("aabb", "xxyy", 1.0, 1.0, 1.0),
        ("aaaa", "xxxx", None, 1.0, 1.0),
        ("aabb", "xxxx", 0.0, 0.0, 0.5),
        ("abcd", "wxyz", 1.0, 1.0, None),
        ("aabb", "wxyz", 0.0, 2 / 3, None),
    ],
)
def test_degenerate_labellings(spark, truth, pred, ari, v, f):
    row = E.scores(labels(spark, truth, pred), "key").first()
    assert row.ari == (None if ari is None else pytest.approx(ari, abs=1e-12))
    assert row.v == pytest.approx(v, abs=1e-12)
    assert row.f == (None if f is None else pytest.approx(f))


def test_undefined_index_is_null(spark):
    assert E.ari(labels(spark, "aaaa", "xxxx"), "key").first().ari is None


def test_alignment_ignores_order(spark):
    truth = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "key string, instance int, sense string")
    pred = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "key string, instance int, sense string")
    rows = {(r.truth, r.pred) for r in E.align(truth, pred).collect()}
    assert rows == {("a", "x"), ("b", "y")}


def test_compensated_sum(spark):
    rows = [("a", 1e16), ("a", 1.0), ("a", -1e16), ("a", 1.0), ("b", None), ("b", 0.5)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    found = {r.k: (r.total, r.n) for r in K.compensated_sum(df, "k", "v").collect()}
    assert found == {"a": (2.0, 4), "b": (0.5, 1)}
    tenth = spark.range(100_000).select(F.lit("k").alias("k"), F.lit(0.1).alias("v"))
    assert K.stable_mean(tenth, "k", "v").first()["mean"] == math.fsum([0.1] * 100_000) / 100_000


def test_sums_keep_nan_and_infinities(spark):
    inf, nan = math.inf, math.nan
    rows = [("n", 1.0), ("n", nan), ("n", None), ("i", inf), ("i", 1.0), ("b", inf), ("b", -inf), ("o", 1e308), ("o", 1e308)]
    df = spark.createDataFrame(rows, "k string, v double")
    for parts in (1, 5):
        found = {r.k: (r.total, r.n) for r in K.compensated_sum(df.repartition(parts), "k", "v").collect()}
        assert math.isnan(found["n"][0]) and found["n"][1] == 2 and math.isnan(found["b"][0])
        assert found["i"] == (inf, 2) and found["o"] == (inf, 2)


VOCAB = [(1, "bank", 9), (2, "river", 5), (3, "money", 5), (4, "near", 2)]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(VOCAB, "word_id int, word string, freq long")


def test_context_takes_the_nearest_known_words(spark, vocab):
    rows = [("bank.n", 1, "Money zzz river near", "near qqq money river"), ("bank.n", 2, "", "zzz")]
    found = {
        r.instance: (r.x, r.ctx)
        for r in wsi.contexts(spark.createDataFrame(rows, "key string, instance int, left string, right string"), vocab, 2).collect()
    }
    assert found[1][0] == 1 and sorted(found[1][1]) == [2, 3, 4, 4]
    assert found[2] == (1, [])


def test_weighted_context_counts_the_target_as_left(spark, vocab):
    rows = [("bank", "s", 1, 1, ["river", "bank", "near", "money"])]
    df = spark.createDataFrame(rows, "word string, sense string, context_id long, position int, words array<string>")
    stop = spark.createDataFrame([("near",)], "word string")
    found = wsi.weighted_context_words(df, vocab, 2, ["word", "sense", "context_id"], stop)
    assert {(r.side, r.r, r.word_id) for r in found.collect()} == {("left", 1, 1), ("left", 2, 2), ("right", 1, 3)}
    beyond = wsi.weighted_context_words(df.withColumn("position", F.lit(9)), vocab, 9, ["context_id"])
    assert {r.side for r in beyond.collect()} == {"left"}


def test_context_file(spark, tmp_path, monkeypatch):
    lines = ["bank.n 2", "a b\tc", "\td", "river.v 1", "x\ty"]
    (tmp_path / "data.txt").write_text("\n".join(lines) + "\n")
    wanted = {("bank.n", 1, "a b", "c"), ("bank.n", 2, "", "d"), ("river.v", 1, "x", "y")}
    for block in (65_536, 2):  # with small blocks a header has to be carried over
        monkeypatch.setattr(WS, "LINE_BLOCK", block)
        assert {tuple(r) for r in WS.read_contexts(spark, str(tmp_path / "data.txt")).collect()} == wanted


def test_context_files_in_small_splits(spark, tmp_path):
    wanted = set()
    for key, size in (("alpha.n", 300), ("beta.n", 90), ("gamma.v", 700)):
        lines = [f"{key} {size}"] + [f"{key} left {i}\tright {i}" for i in range(size)]
        (tmp_path / f"{key}.txt").write_text("\n".join(lines) + "\n")
        wanted |= {(key, i + 1, f"{key} left {i}", f"right {i}") for i in range(size)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = [tuple(r) for r in WS.read_contexts(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == len(wanted) and set(found) == wanted


def test_answer_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("bank.n", 3, 2), ("bank.n", 1, 1)], "key string, instance int, sense int")
    WS.write_predictions(rows, str(tmp_path / "p"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "p")).collect())
    assert lines == ["bank.n bank.n.1 bank.n.senses.1", "bank.n bank.n.3 bank.n.senses.2"]
    found = {tuple(r) for r in WS.read_answers(spark, str(tmp_path / "p")).collect()}
    assert found == {("bank.n", 1, "bank.n.senses.1"), ("bank.n", 3, "bank.n.senses.2")}


def test_nested_contexts(spark, tmp_path):
    text = '{"plain_word":"B","word":"Bank","weight":7,"senses":[{"sense":"Ufér","weight":2,"contexts":[{"position":0,"words":["A","b"]},{"position":1,"words":["c"]}]}]}'
    (tmp_path / "w.json").write_text(text)
    rows = WS.flatten_weighted(WS.read_weighted(spark, str(tmp_path / "w.json"))).orderBy("context_id").collect()
    assert [tuple(r) for r in rows] == [
        ("bank", 7, "ufr", 2, True, 1, 0, ["a", "b"]),
        ("bank", 7, "ufr", 2, True, 2, 1, ["c"]),
    ]


def test_cap_of_contexts_per_sense(spark):
    df = spark.range(30).select(F.lit("w").alias("word"), (F.col("id") % 2).cast("string").alias("sense"), F.col("id").alias("context_id"))
    assert wsi.capped_contexts(df, 5).groupBy("sense").count().select("count").distinct().first()[0] == 5
    assert wsi.capped_contexts(df).count() == 30


def test_text_ids_do_not_depend_on_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"text {k} {i}\n" for i in range(100)))
    found = []
    for size in ("500", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append({tuple(r) for r in read_text(spark, str(tmp_path)).collect()})
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len({i for i, _ in found[0]}) == 300


def test_neighbours_by_word(spark, fixture):
    word = fixture.vocab.filter("word_id = 1").first().word
    rows = N.candidates(fixture.model.in_vec, fixture.model.sense_counts)
    ids = N.nearest_neighbors(rows, 1, 1, 5).join(fixture.vocab, "word_id")
    wanted = {(r.word, r.sense, round(r.sim, 9)) for r in ids.collect()}
    assert {(r.word, r.sense, round(r.sim, 9)) for r in N.nearest_words(fixture.model, word, 1, 5).collect()} == wanted
    with pytest.raises(ValueError):
        N.nearest_words(fixture.model, "no such word", 1)


def test_vector_file(spark, fixture, tmp_path):
    XS.write_vectors(fixture.model, str(tmp_path / "v"))
    first = spark.read.text(str(tmp_path / "v")).filter("value rlike '^[0-9]+ [0-9]+$'").first()[0]
    assert first == f"{fixture.vocab.count()} 8"
    read = XS.read_vectors(spark, str(tmp_path / "v")).join(fixture.vocab, "word").select("word_id", "vec")
    own = fixture.model.in_vec.filter("sense = 1").select("word_id", "vec")
    assert read.exceptAll(own).isEmpty() and own.exceptAll(read).isEmpty()
