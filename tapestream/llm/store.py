"""Tables that cut lineage, written where the driver and every executor can read them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bounds of a batch between the JVM and Python: texts are long, and both sides hold a batch.  Set once, never raised.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 64_000_000}

_own: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; in local mode, where it may be unset (tests), a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tapestream-"))
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/tapestream"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def small_batches(spark: SparkSession) -> None:
    """Holds the session to BATCHES, or to what it has that is less."""
    for key, most in BATCHES.items():
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(key))[0]) <= most:
            spark.conf.set(key, str(most))


def keep(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    small_batches(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def forget(df: DataFrame) -> None:
    """Removes the table that ``keep`` wrote for df; nothing may read it later."""
    for file in df.inputFiles()[:1]:
        _remove(df.sparkSession, file.rpartition("/")[0])


def keep_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Keeps what ``make`` returns, and removes all tables that were kept on the way."""
    first = len(_made)
    out = keep(make(), name)
    for path in _made[first:-1]:
        _remove(out.sparkSession, path)
    del _made[first:-1]
    return out
