"""Held-out likelihood of text under a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context as C
from ..operators.model import SenseModel
from ..operators.score import likelihood, likelihood_by, merge_means
from ..operators.vocab import lookup_words
from ..sources.corpus import scan_words

LIKELIHOOD_BATCH = 16_777_216


def text_pairs(docs: DataFrame, model: SenseModel, window: int, batch: int = LIKELIHOOD_BATCH) -> DataFrame:
    words = scan_words(docs)
    tokens = lookup_words(words, model.vocab).select("doc_id", "pos", "word_id")
    sizes = words.agg(F.count("*").alias("freq"))  # of the text, which need not be the one that the vocabulary is from
    return C.context_pairs(C.dealt_for_pairs(C.chunked(tokens, batch), sizes), window)


def text_likelihood(docs: DataFrame, model: SenseModel, window: int = 5, min_prob: float = 0.005) -> DataFrame:
    """``(mean, n)`` over the whole text."""
    # counted where the windows are built; a pair may come once per chunk
    return likelihood(C.pair_counts(text_pairs(docs, model, window), "doc_id", "chunk_id"), model, min_prob)


def batch_likelihood(docs: DataFrame, model: SenseModel, window: int = 5, min_prob: float = 0.005) -> DataFrame:
    """``(doc_id, chunk_id, mean, n)``: the log of batch means."""
    pairs = C.pair_counts(text_pairs(docs, model, window), "doc_id", "chunk_id")
    return likelihood_by(pairs, model, "doc_id", "chunk_id", min_prob=min_prob)


def parallel_likelihood(
    docs: DataFrame, model: SenseModel, window: int = 5, min_prob: float = 0.005, log_path: str | None = None
) -> DataFrame:
    """The size-weighted mean of all batches; ``log_path`` keeps the means of the batches."""
    stats = batch_likelihood(docs, model, window, min_prob)
    if log_path is not None:
        stats.write.parquet(log_path)
        stats = docs.sparkSession.read.parquet(log_path)
    return merge_means(stats.filter(F.col("n") > 0))
