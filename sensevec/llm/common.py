"""Helpers shared by the operators: table access, work tables, connected components and split running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import drop_path, materialize

# Groups are cut into so many slices per shuffle partition that a group of any share of the rows spreads evenly.
SLICES_PER_PARTITION = 8
# Bits of a broadcast filter for each of its keys, those of a part of it, and those it has at most (16 MB).
KEY_BITS, PART_BITS, MOST_BITS = 16, 1 << 15, 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def uniform(*parts: Column) -> Column:
    """A double in (0, 1) from the MD5 of the parts, the same in every run and on every engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def possible_keys(rows: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """Add ``name``: false only where the hash ``key`` (bigint, not null) is not among ``keys``, true for all that are and a few others.

    A bit stands for the keys that agree in their last digits; only the bits are sent to the rows.  A join with ``keys`` then has to move
    only rows whose bit is set.  ``keys`` is read twice and should be a written table.
    """
    bits = min(MOST_BITS, 1 << max(PART_BITS.bit_length() - 1, (KEY_BITS * keys.count()).bit_length()))
    place = F.pmod(F.col(key), F.lit(bits))
    part, at = F.floor(place / PART_BITS).alias("__part"), F.pmod(place, F.lit(PART_BITS))
    marks = keys.groupBy(part).agg(F.bitmap_construct_agg(at).alias("__bits"))
    met = rows.join(F.broadcast(marks.withColumnRenamed("__part", "__of")), part == F.col("__of"), "left")
    byte = F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")
    found = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.expr("cast(__at % 8 as int)")) == 1
    return met.withColumn("__at", at).select(*rows.columns, F.coalesce(found, F.lit(False)).alias(name))


def running_total(
    df: DataFrame, group: str, spread: Column, order: list[Column], value: Column, name: str, rows: DataFrame
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the row's group.

    ``order`` sorts a group, and ``spread`` is a double in [0, 1) that never falls along that order.  It cuts a group
    into slices; each slice is summed by itself and the totals of the slices before it are added, so no task holds a
    whole group.  ``rows`` has ``(group, n_rows)``; a group gets slices by its share of all rows, so that the number of
    slices follows the number of shuffle partitions and not the number of rows.  ``df`` is read twice and should be a
    written table; ``group`` must not be null.
    """
    spark = df.sparkSession
    wanted = float(SLICES_PER_PARTITION * shuffle_partitions(spark))
    total = rows.agg(F.sum("n_rows")).first()[0] or 1
    share = rows.select(F.col(group), (F.col("n_rows") / F.lit(total)).alias("__share"))
    cut = df.join(share, group).withColumn("__slice", F.floor(spread * F.ceil(F.col("__share") * F.lit(wanted))))
    cut = cut.drop("__share")
    totals = cut.groupBy(group, "__slice").agg(F.sum(value).alias("__total"))
    earlier = W.partitionBy(group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(group, "__slice", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    inside = W.partitionBy(group, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(before, [group, "__slice"])
    return joined.withColumn(name, F.col("__before") + F.col("__local")).drop("__slice", "__before", "__local")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``: root is the smallest node it is connected with.

    Alternating star contraction: every node points its larger, then its smaller neighbours at the smallest node
    known among them.  Both steps are an aggregation and a join, so a node with many neighbours is summed in the map
    tasks and joined under Spark's skew handling; nothing is gathered per node.  Edges are written after each round.
    """
    spark = edges.sparkSession
    edges = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    state, old = None, []
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").filter("b <> m").toDF("a", "b").union(low.toDF("a", "b"))
        found = materialize(small.distinct(), "edges")
        now = found.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        old.append(edges)
        edges = found
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    for done in old:
        discard(done)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def discard(df: DataFrame) -> None:
    """Delete a work table that nothing reads any more."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        drop_path(df.sparkSession, path)


__all__ = [
    "components",
    "discard",
    "materialize",
    "possible_keys",
    "running_total",
    "shuffle_partitions",
    "table",
    "uniform",
    "whole_text",
]
