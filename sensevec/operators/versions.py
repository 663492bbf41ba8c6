"""Published versions of a set of tables: written to a new folder, named by a log entry that is written last."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

LOG = "log"
KEEP = 2  # versions that stay


def entries(spark: SparkSession, path: str) -> list[Row]:
    """Log entries from the newest to the oldest; none where nothing was published.  There are few: older ones are retired."""
    try:
        log = spark.read.parquet(f"{path}/{LOG}")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return []
        raise
    return log.orderBy(F.col("version").desc()).collect()


def publish(spark: SparkSession, path: str, write: Callable[[str], None], about: DataFrame, keep: int = KEEP) -> int:
    """Let ``write`` fill a new folder, then log it with the one row of ``about``; returns the number of the version.

    Readers see the old version until the log entry is there, and the new one from then on: whatever fails before leaves the old
    one whole.  The last ``keep`` versions stay, so a reader that has just looked up a folder can finish.
    """
    known = entries(spark, path)
    version = known[0]["version"] + 1 if known else 1
    folder = f"version-{version}-{uuid.uuid4().hex[:8]}"
    write(f"{path}/{folder}")
    entry = about.withColumn("version", F.lit(version)).withColumn("folder", F.lit(folder))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/{LOG}/of={version}")
    for old in known[keep - 1 :]:  # the log entry first: a folder without one is only waste
        remove(spark, f"{path}/{LOG}/of={old['version']}")
        remove(spark, f"{path}/{old['folder']}")
    return version


def latest(spark: SparkSession, path: str) -> Row:
    """The newest log entry, with ``folder`` as a full path under ``at``."""
    known = entries(spark, path)
    if not known:
        raise FileNotFoundError(f"no published version in {path}")
    return Row(**known[0].asDict(), at=f"{path}/{known[0]['folder']}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a retired version."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
