"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import materialize, running_total, whole_text

# The multiplier of the published generator.
MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key.

    A key jumps forward from shard to shard; the next jump depends on the generator only, and the last
    place below ``shards`` is the answer.  So one more shard takes keys from all others into itself and moves no other.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.uint64, copy=True)
    place = np.zeros(len(state), dtype=np.int64)
    open_keys = np.arange(len(state))
    while len(open_keys):
        state[open_keys] = state[open_keys] * MULTIPLIER + np.uint64(1)
        draw = (state[open_keys] >> np.uint64(33)).astype(np.float64) + 1.0
        leap = ((place[open_keys] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        inside = leap < shards
        open_keys = open_keys[inside]
        place[open_keys] = leap[inside]
    return place.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a ``bigint`` key that is not null."""

    @pandas_udf("int")
    def assigned(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return assigned(key)


def stable_key(id_col: str) -> Column:
    """The id mixed to 64 bits, so that any kind of id can be the key; a null id has a key of its own."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull())


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per row of ``docs``.

    ``size`` is the UTF-8 length plus 1, a null text has size 1 and the checksum of the empty text.  The law is
    ``key``: equal ids share a shard, whatever their texts.  ``slot`` numbers a shard from 0 without gaps; rows are ordered by a
    hash of id and text, and equal rows stand in any order among themselves.  ``grown_shard`` is the shard when
    one more is added.  Other columns are ignored, an empty table gives an empty one.
    """
    key = stable_key(id_col)
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, shards).alias("shard"),
        shard_of(key, shards + 1).alias("grown_shard"),
        F.xxhash64(F.col(id_col), text, F.lit(shards)).alias("__mix"),
    )
    rows = materialize(rows, "shards")
    spread = F.col("__mix").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    spread = F.least(spread, F.lit(1.0 - 2.0**-53))
    counts = rows.groupBy("shard").agg(F.count("*").alias("n_rows"))
    order = [F.col("__mix"), F.col("doc_id"), F.col("text_crc32")]
    out = running_total(rows, "shard", spread, order, F.lit(1), "slot", counts)
    return out.select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", files_per_shard: int = 8) -> None:
    """Write the rows, all columns kept, to one Parquet folder per shard (``shard=0`` and so on).

    A shard is written by several tasks, so the largest file does not grow into a whole shard.
    """
    placed = docs.withColumn("shard", shard_of(stable_key(id_col), shards))
    part = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns]), F.lit(files_per_shard))
    placed.repartition(shards * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)
