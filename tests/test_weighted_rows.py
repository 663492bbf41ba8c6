from pyspark.sql import functions as F

from sensevec.operators import wsi
from sensevec.sources import wsi as sources


def test_equal_labels_and_records_keep_their_contexts(spark, monkeypatch):
    """Two senses whose labels become equal, and two records of one word: each context is scored as it is."""
    context = lambda *words: [(0, ["bank", *words])]
    senses = [("b\u00e9t", 9, context("a")), ("b\u00fct", 9, context("b"))]
    schema = sources.NESTED_SCHEMA
    nested = spark.createDataFrame([("bank", "bank", 900, senses), ("bank", "bank", 900, [("bt", 9, context("c"))])], schema)
    vocab = spark.createDataFrame([(1, "bank", 900), (2, "a", 9), (3, "b", 9), (4, "c", 9)], "word_id int, word string, freq long")
    seen = []

    def scored(occurrences, model, decoder=None):
        seen.extend(sorted(r.ctx for r in occurrences.collect()))
        return occurrences.select("occ_id", F.array(F.lit(1.0), F.lit(0.0)).alias("z"))

    monkeypatch.setattr(wsi, "disambiguate", scored)
    monkeypatch.setattr(wsi, "ambiguous", lambda model: spark.createDataFrame([(1, "bank", 2)], "word_id int, word string, n_senses int"))
    model = type("Model", (), {"vocab": vocab})()
    cells = wsi.weighted_contingency(sources.flatten_weighted(nested), model).collect()
    assert sorted(x for ctx in seen for x in ctx if x != 1) == [2, 3, 4] and len(seen) == 3
    assert [tuple(r) for r in cells] == [("bank", "bt", 1, 3)]
