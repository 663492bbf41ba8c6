import __spark_entry__ as spark_entry
import corpus_pipeline
from sensevec.llm import langid, near_text, secrets


def test_stages_and_their_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, first = docs.columns, docs
    out = corpus_pipeline.run(spark, folder)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns, name
        if name == "near_copies":
            assert docs.count() == near_text.near_duplicates(before).select("class_id").distinct().count()
        if name == "clean_secrets":
            assert docs.count() == before.count()
            assert secrets.scan(docs).filter("size(secrets) > 0").isEmpty()
    assert out.count() == docs.count()
    assert out.select("doc_id").distinct().count() <= first.count()
    assert langid.accepted(first, langid.train(first)).count() >= 0.98 * first.count()


def test_all_eleven_are_registered():
    names = spark_entry.queries()
    assert "pipeline" in names
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
