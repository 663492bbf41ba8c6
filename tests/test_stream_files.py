"""Contexts that a stream reads are written small: most of a context stands in the one before it, too."""

import random

from pyspark.sql import functions as F

from sensevec.operators import context as C
from sensevec.streaming import score as SS
from test_reading import words_of
from sensevec.operators import model as M
from sensevec.operators.score import disambiguate
from sensevec.session import materialize, work_dir


def test_contexts_are_written_small(spark, tmp_path):
    rng = random.Random(6)
    tokens, vocab = words_of(spark, [" ".join(f"w{int(rng.paretovariate(0.5)) % 900}" for _ in range(400)) for _ in range(40)])
    model = M.new_model(vocab, 4, 2, 0.1, 0.0)
    model = model.with_tables(tree=materialize(model.tree, "tree"))
    around = C.contexts(C.chunked(tokens), 4).select(F.struct("doc_id", "pos").alias("occ_id"), F.col("word_id").alias("x"), "ctx")
    occ = materialize(around.coalesce(1), "occ")
    size = lambda path: sum(p.stat().st_size for p in path.rglob("*.parquet"))
    occ.write.parquet(str(tmp_path / "plain"))
    before = {p.name for p in tmp_path.__class__(work_dir(spark)).iterdir()}
    found = SS.score_available(spark, occ, model)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, disambiguate(occ, model).collect()))
    (source,) = [p for p in tmp_path.__class__(work_dir(spark)).iterdir() if p.name.startswith("stream-in") and p.name not in before]
    assert size(source) < 0.75 * size(tmp_path / "plain")  # it was as large
