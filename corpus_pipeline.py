"""From raw documents to tokens: language ID, near-duplicates, secrets, mixing and BPE, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensevec.llm import bpe, langid, mixing, near_text, secrets
from sensevec.llm.common import materialize, table
from sensevec.llm.queries import vocabulary_path


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents; those whose text is null, has no letter or fits no language go."""
    return langid.accepted(docs, langid.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_text.one_of_each(docs)


def clean_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark, and ``n_chars`` follows."""
    columns = docs.columns
    return secrets.redact(secrets.scan(docs)).select(*columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, better labelled ones first; the last of a source may be cut."""
    columns = docs.columns
    taken = mixing.mix(docs, labels=table(spark, sf_dir, "labels"))
    return mixing.mixed_documents(docs, taken).select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, token_ids``: ids of the whole text as little-endian unsigned 32-bit integers."""
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), vocabulary_path())
    count = (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens")
    return encoded.select("doc_id", "source", count, "token_ids")


STAGES = [
    ("languages", languages),
    ("near_copies", near_copies),
    ("clean_secrets", clean_secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

# Language models, sketches and BPE have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the work folder and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
