"""Running word counts over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.vocab import word_count
from ..session import scratch_path
from ..sources.corpus import scan_simple_tokens

DOCUMENT_SCHEMA = "doc_id bigint, text string"
CHANGE_SCHEMA = "word string, freq bigint, version bigint"


def running_counts(docs: DataFrame) -> DataFrame:
    """``(word, freq)`` of everything read so far; the state holds one row per distinct word."""
    return word_count(scan_simple_tokens(docs))


def write_changes(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts of a stream under ``target``: each batch writes the words that it saw, with their counts so far.

    The state of the stream holds the counts, so neither reading nor writing grows with the vocabulary; a replayed batch writes its
    own folder again.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={batch_id}")

    return (
        running_counts(docs)
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def counts_at(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """``(word, freq)`` after a batch, the last one by default: of each word what the latest batch that saw it wrote."""
    changes = spark.read.schema(CHANGE_SCHEMA).parquet(target)
    if version is not None:
        changes = changes.filter(F.col("version") <= version)
    return changes.groupBy("word").agg(F.max_by("freq", "version").alias("freq"))


def compact(spark: SparkSession, target: str, path: str) -> None:
    """The counts so far as one table in a new folder, where another stream of changes may follow."""
    counts_at(spark, target).write.parquet(f"{path}/version=-1")


def _folders(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return any(f.isDirectory() for f in found or [])


def count_available(spark: SparkSession, folder: str, glob: str, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """Read what in ``folder`` matches ``glob``, files or folders of files, as a stream and return the final counts."""
    target = scratch_path(spark, "stream-counts")
    # a stream without rows has no batch to write the table
    spark.createDataFrame([], "word string, freq bigint").write.parquet(f"{target}/version=-1")
    source = spark.readStream.schema(schema)
    named = f"{folder.rstrip('/')}/{glob}"
    # a table may be one file or a folder of files; the filter holds for names of files only
    docs = source.parquet(named) if _folders(spark, named) else source.option("pathGlobFilter", glob).parquet(folder)
    write_changes(docs, target, f"{target}-progress").awaitTermination()
    return counts_at(spark, target)
