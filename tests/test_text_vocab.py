import pytest
from pyspark.sql import functions as F

from sensevec.functions import text as T
from sensevec.operators import context as C
from sensevec.operators import vocab as V
from sensevec.sources import dictionary as D
from sensevec.sources.corpus import scan_words


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Café au lait", "caf au lait"),
        ("a\x01,b", "a b"),
        ("Don't  STOP\tnow\n", "don t stop now"),
        ("Kelvin", "elvin"),  # the Kelvin sign would fold to an ASCII k
        ("...", ""),
        ("", ""),
    ],
)
def test_simple_tokenize(spark, raw, clean):
    assert one(spark, raw, T.simple_tokenize) == clean


def test_words_split_on_any_white_space(spark):
    docs = spark.createDataFrame([(1, " a  b\tc\nD ")], "doc_id long, text string")
    assert [tuple(r) for r in scan_words(docs).orderBy("pos").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "D")]


def test_blank_and_cleanup(spark):
    assert one(spark, "", T.is_blank) and one(spark, " \t", T.is_blank) and not one(spark, "\n", T.is_blank)
    assert one(spark, "Hi , There ! 42", T.clean_tokens) == "hi there 42"
    assert one(spark, "né", T.has_non_ascii) and not one(spark, "ne", T.has_non_ascii)


def test_dictionary_lines(spark, tmp_path):
    lines = ["good 3", "lonely", "bad x", "three 4 5", "spaced    6", "good 9"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    rows = sorted(tuple(r) for r in D.parse_lines(df).collect())
    assert rows == [("good", 3), ("good", 9), ("spaced", 6), ("three", 4)]
    counts = spark.createDataFrame([("b", 2), ("a", 1)], "word string, freq long")
    D.write_dictionary(counts, str(tmp_path / "d"))
    assert {tuple(r) for r in D.read_dictionary(spark, str(tmp_path / "d")).collect()} == {("a", 1), ("b", 2)}


def test_ranks_break_ties_by_word(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("z", 9), ("c", 1)], "word string, freq long")
    ranked = [tuple(r) for r in V.assign_ids(counts).orderBy("word_id").collect()]
    assert ranked == [(1, "z", 9), (2, "a", 5), (3, "b", 5), (4, "c", 1)]
    dropped = [tuple(r) for r in V.assign_ids(counts, 2).orderBy("word_id").collect()]
    assert dropped == [(1, "b", 5), (2, "c", 1)]


def test_big_vocabulary_join_gives_the_same_rows(spark, fixture, monkeypatch):
    words = fixture.words()
    small = V.lookup_words(words, fixture.vocab)
    monkeypatch.setattr(V, "BROADCAST_WORDS", 1)
    large = V.lookup_words(words, fixture.vocab).select(small.columns)
    assert "BroadcastExchange" not in large._jdf.queryExecution().sparkPlan().toString()
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()


def test_preprocess_rejects_unknown_ids(spark):
    vocab = spark.createDataFrame([(1, "a", 9)], "word_id int, word string, freq long")
    tokens = spark.createDataFrame([(1, 1, 7)], "doc_id long, pos int, word_id int")
    with pytest.raises(Exception, match="unknown word id 7"):
        V.preprocess(tokens, vocab).collect()


def test_subsample_keeps_all_without_threshold(spark):
    tokens = spark.createDataFrame([(1, 1, 5)], "doc_id long, pos int, freq long")
    assert V.subsample(tokens, 5).count() == 1


def tokens_of(spark, ids, doc=1):
    rows = [(doc, i + 1, w, 1) for i, w in enumerate(ids)]
    return C.chunked(spark.createDataFrame(rows, "doc_id long, pos int, word_id int, freq long"))


def test_window_pairs(spark):
    pairs = C.context_pairs(tokens_of(spark, [10, 20, 30]), 1)
    assert sorted((r.x, r.y) for r in pairs.collect()) == [(10, 20), (20, 10), (20, 30), (30, 20)]
    assert C.context_pairs(tokens_of(spark, [10]), 3).isEmpty()


def test_windows_run_over_kept_tokens_and_stop_at_chunks(spark):
    rows = [(1, p, p, 1) for p in (1, 5, 6)]
    kept = spark.createDataFrame(rows, "doc_id long, pos int, word_id int, freq long")
    ranked = C.renumber(kept, batch=5)
    assert sorted((r.chunk_id, r.pos, r.word_id) for r in ranked.collect()) == [(0, 1, 1), (0, 2, 5), (1, 1, 6)]
    assert sorted((r.x, r.y) for r in C.context_pairs(ranked, 4).collect()) == [(1, 5), (5, 1)]


def test_cut_needs_two(spark):
    with pytest.raises(ValueError):
        C.context_pairs(tokens_of(spark, [1, 2]), 1, cut=True)
    cut = C.contexts(tokens_of(spark, list(range(1, 60))), 4, cut=True).filter("pos between 5 and 55")
    sizes = {len(r.ctx) for r in cut.collect()}
    assert sizes <= {2, 4, 6} and len(sizes) > 1


def test_pair_plan_has_one_exchange_and_no_nested_loop(spark, fixture):
    plan = C.context_pairs(fixture.kept(), 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_scan_reads_two_columns(spark, fixture):
    plan = V.word_count(fixture.words())._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
