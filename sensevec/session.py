"""Session helpers: where intermediate tables live and how they are cut off from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a ``local`` master, where every task
    shares one disk, may fall back to a temporary folder of this machine.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="sensevec-")
    spark.conf.set(CHECKPOINT_DIR, path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends at the files, so a lost executor costs a re-read, never a recomputation, and the
    planner sees the true size of the table when it chooses between a broadcast and a shuffle.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that this library wrote: a folder inside the work folder, with or without a scheme."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, root = hadoop(path), hadoop(work_dir(spark))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    target, root = system.makeQualified(target), system.makeQualified(root)
    if not target.toString().startswith(root.toString().rstrip("/") + "/"):
        raise ValueError(f"not an intermediate table: {path}")
    system.delete(target, True)


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows; reads no further than needed."""
    return df.limit(rows + 1).count() <= rows
