"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, chat, divergence, langid, mixing, near_text, neighbours, runs, secrets, sharding, simhash, topk, warc
from .common import table

VOCABULARY = "byte_bpe_50k.json"

SHARDS = 8


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op3_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(langid.fold() != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (langid.fold() == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.index(warc.read_archive(spark, path))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_examples(turns))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def all_oracles() -> dict[str, str]:
    return {"op11_topk": topk.oracle(), "op13_divergence": divergence.oracle()}
