"""Frequent values of a column by a mergeable sketch of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = 4096  # that a task keeps
SHARE = 1 / 1024  # of all rows, from which on a value is frequent


def _summaries(counters: int):
    """Each task keeps the largest counts and lowers them all by the next one whenever they become too many.

    A value's true number of rows exceeds its counter by at most what was taken off in all, and that is at most ``rows / counters``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        off = rows = 0

        def lowered(most: int) -> int:
            nonlocal held
            if len(held) <= most:
                return 0
            by = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), len(held) - most - 1)[len(held) - most - 1])
            held = {k: n - by for k, n in held.items() if n > by}
            return by

        for batch in batches:
            found = pc.value_counts(pc.drop_null(batch.column(0)))
            for value, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                held[value] = held.get(value, 0) + n
                rows += n
            if len(held) > 2 * counters:
                off += lowered(counters)
        off += lowered(counters)
        values = [None, *held]  # the row without a value tells how much was read and taken off
        columns = [pa.array(values, pa.string()), pa.array([0, *held.values()], pa.int64())]
        columns += [pa.array([off] + [0] * len(held), pa.int64()), pa.array([rows] + [0] * len(held), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["value", "n", "off", "rows"])

    return run


def frequent(df: DataFrame, column: str, share: float = SHARE, counters: int = COUNTERS) -> DataFrame:
    """``(value)``: every text that makes up at least ``share`` of the rows, and fewer than ``1 / (share - 1 / counters)`` in all.

    One pass, in which each task sends at most ``counters`` rows; nothing is shuffled by the column itself.
    """
    sums = df.select(F.col(column).cast("string")).mapInArrow(_summaries(counters), "value string, n bigint, off bigint, rows bigint")
    merged = sums.groupBy("value").agg(F.sum("n").alias("n"), F.sum("off").alias("off"), F.sum("rows").alias("rows"))
    total = merged.filter("value is null").select(F.col("off").alias("all_off"), F.col("rows").alias("all_rows"))
    least = F.col("all_rows") * F.lit(share)
    return (
        merged.filter("value is not null")
        .join(F.broadcast(total), F.lit(True))  # one row
        .filter((F.col("n") + F.col("all_off") >= least) & (F.col("n") >= least * F.lit(1.0 - 1.0 / (share * counters))))
        .select("value")
    )
