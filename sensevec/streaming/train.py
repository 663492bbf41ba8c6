"""Incremental training: every micro-batch of documents is one round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import context as C
from ..operators import train as R
from ..operators.model import SenseModel
from ..operators.reading import followers, numbered
from ..operators.score import broadcast_decoder, collect_paths, fits_broadcast, meet_side, slice_occurrences
from ..operators.versions import remove
from ..operators.vocab import lookup_words
from ..plans.train import STATE_SCHEMA, TrainParams, model_of, next_state, occurrences, round_statistics, state_rows, state_side
from ..session import drop_path, materialize
from ..sources.corpus import scan_words


KEPT_VERSIONS = 3


class StreamTrainer:
    """Keeps one model version per batch id in ``folder``; a replayed batch rewrites its own version.

    A version counts once its number of words read is written, after its tables.  Versions that no replay can ask for are
    deleted, and a batch whose likelihood is not a number is refused before it counts.
    """

    def __init__(self, model: SenseModel, params: TrainParams, folder: str, total_words: float, keep: int = KEPT_VERSIONS):
        self.model, self.params, self.folder, self.total, self.keep = model, params, folder, total_words, max(2, keep)
        self.spark: SparkSession = model.vocab.sparkSession
        self.paths = collect_paths(model) if fits_broadcast(model) else None  # the tree stays the same
        self._write(state_rows(model), -1, 0)

    def _path(self, version: int) -> str:
        return f"{self.folder}/version-{version}"

    def _write(self, rows: DataFrame, version: int, read: int) -> None:
        rows.write.mode("overwrite").partitionBy("kind").parquet(self._path(version))
        round_statistics(self.state(version), f"batch {version}")
        words = self.spark.createDataFrame([(read,)], "words bigint")
        words.coalesce(1).write.mode("overwrite").parquet(f"{self._path(version)}-read")
        if version >= self.keep - 1:
            for path in (self._path(version - self.keep), f"{self._path(version - self.keep)}-read"):
                remove(self.spark, path)

    def state(self, version: int) -> DataFrame:
        return self.spark.read.schema(STATE_SCHEMA).parquet(self._path(version))

    def words_read(self, version: int) -> int:
        return self.spark.read.parquet(f"{self._path(version)}-read").first()["words"]

    def model_at(self, version: int) -> SenseModel:
        return model_of(self.state(version), self.model)

    def step(self, docs: DataFrame, batch_id: int) -> None:
        """Round ``batch_id`` starts from the version before it, never from a half-done one."""
        params = self.params
        state, read = self.state(batch_id - 1), self.words_read(batch_id - 1)
        kept = lookup_words(scan_words(docs), self.model.vocab).select("doc_id", "pos", "word_id", "freq")
        tokens = materialize(numbered(C.chunked(kept, params.batch)), "batch-tokens")
        occ = occurrences(tokens, params).select("occ_id", "x", "ctx", "at")
        occ = followers(occ, ["x"]).select("occ_id", "x", "ctx", "behind")
        lr = R.learning_rate_at(read, self.total, params.start_lr)
        current = self.model_at(batch_id - 1)
        decoder = broadcast_decoder(current, paths=self.paths)
        if decoder is None:
            sums = R.round_sums_joined(occ, current, lr, params.sense_threshold)
        else:
            rows = meet_side(slice_occurrences(occ), state_side(state, self.model), self.model)
            sums = R.round_sums(rows, decoder, self.model.dim, self.model.senses, lr, params.sense_threshold)
        self._write(next_state(state, sums, params, lr), batch_id, read + tokens.count())
        for path in {p.rsplit("/", 1)[0] for p in tokens.inputFiles()}:
            drop_path(self.spark, path)
        if decoder is not None:
            decoder.destroy()

    def start(self, docs: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            docs.writeStream.foreachBatch(self.step)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
