"""Where queries write files that they read again: a folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place under spark.checkpoint.dir; in local mode, where that may be unset, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tapestream-files-"))
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/files/{name}-{uuid.uuid4().hex[:12]}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once and read as often as they are passed over."""
    path = new_folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
