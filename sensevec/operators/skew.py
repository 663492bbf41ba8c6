"""Bounded groups: what belongs to one key is cut into slices of limited size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliced(df: DataFrame, key: str, spread: list[str], limit: int, count=None) -> DataFrame:
    """Add ``slice`` so that a ``(key, slice)`` group holds about ``limit`` rows, however hot the key is.

    ``spread`` names the columns that tell the rows of one key apart.  ``count`` is an expression for the
    rows per key when it is already at hand; otherwise they are counted first.
    """
    if count is None:
        hot = df.groupBy(key).agg(F.count("*").alias("rows_of_key")).filter(F.col("rows_of_key") > limit)
        df = df.join(hot, key, "left")
        count = F.coalesce(F.col("rows_of_key"), F.lit(1))
    slices = F.ceil(count / F.lit(limit)).cast("bigint")
    out = df.withColumn("slice", F.pmod(F.xxhash64(*spread), F.greatest(slices, F.lit(1))))
    return out.drop("rows_of_key")
