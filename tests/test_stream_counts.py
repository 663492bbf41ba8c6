"""Running counts: a batch writes only what it saw."""

from collections import Counter

import pytest

from sensevec.streaming import counts as SC
from sensevec.streaming.counts import count_available


def test_batches_write_their_own_words(spark, tmp_path):
    texts = ["a b a", "b c", "", "d a", "c c c"]
    for k, text in enumerate(texts):
        df = spark.createDataFrame([(k, text)], "doc_id long, text string").coalesce(1)
        df.write.parquet(str(tmp_path / f"part{k}"))
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(tmp_path / f"{k}.parquet")
    (tmp_path / "in").mkdir()
    for k in range(len(texts)):
        (tmp_path / f"{k}.parquet").rename(tmp_path / "in" / f"{k}.parquet")
    docs = spark.readStream.schema(SC.DOCUMENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    target = str(tmp_path / "counts")
    SC.write_changes(docs, target, str(tmp_path / "progress")).awaitTermination()
    written = spark.read.schema(SC.CHANGE_SCHEMA).parquet(target).collect()
    by_batch = {}
    for r in written:
        by_batch.setdefault(r.version, {})[r.word] = r.freq
    wanted = Counter(w for t in texts for w in t.split())
    assert {r.word: r.freq for r in SC.counts_at(spark, target).collect()} == wanted
    assert sum(len(b) for b in by_batch.values()) == sum(len(set(t.split())) for t in texts)  # nothing else is rewritten
    first = sorted(by_batch)[0]
    assert {r.word: r.freq for r in SC.counts_at(spark, target, first).collect()} == by_batch[first]
    SC.compact(spark, target, str(tmp_path / "compact"))
    assert {r.word: r.freq for r in SC.counts_at(spark, str(tmp_path / "compact")).collect()} == wanted


@pytest.mark.parametrize("parts", [0, 1, 3])
def test_a_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path, parts):
    docs = spark.createDataFrame([(i, f"a b{i}") for i in range(6)], "doc_id bigint, text string")
    if parts:
        docs.repartition(parts).write.parquet(f"{tmp_path}/docs.parquet")
    else:
        docs.coalesce(1).write.parquet(f"{tmp_path}/one")
        next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "docs.parquet")
    docs.write.parquet(f"{tmp_path}/other.parquet")  # not named
    found = {r["word"]: r["freq"] for r in count_available(spark, str(tmp_path), "docs.parquet").collect()}
    assert found == {"a": 6} | {f"b{i}": 1 for i in range(6)}


def test_a_stream_without_rows_has_no_counts(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs.parquet")
    assert count_available(spark, str(tmp_path), "docs.parquet").collect() == []
