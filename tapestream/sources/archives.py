"""Zip archives of one headerless CSV each, as a Spark data source.

An archive is a partition.  Its vendor's checksum, the SHA-256 in a file of the same name
with ``.CHECKSUM`` after it, is compared before a row is read; then the member is inflated
block by block and handed on in batches, so neither the archive nor the member is held.
"""

from __future__ import annotations

import csv
import fnmatch
import hashlib
import io
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

SPOT_COLUMNS = ["trade_id", "price", "quantity", "quote_quantity", "time", "is_buyer_maker", "is_best_match"]
BATCH_ROWS, BLOCK = 20_000, 1 << 20


class Archive(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


def _opened(path: str):
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path)
    return files, inner


def found(path: str) -> list[str]:
    """The archives that a path names: a file, a folder's ``.zip`` files, or a pattern in the last part."""
    from pyarrow import fs

    files, inner = _opened(path.rpartition("/")[0] if "*" in path else path)
    prefix = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    pattern = path.rpartition("/")[2] if "*" in path else "*.zip"
    info = files.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    names = [x.path for x in files.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File]
    return [prefix + n for n in sorted(names) if fnmatch.fnmatch(posixpath.basename(n), pattern)]


def verify(path: str, required: bool) -> None:
    """Raises if the archive isn't what its checksum file says, or, if required, where there is none."""
    from pyarrow import fs

    files, inner = _opened(path)
    if files.get_file_info(f"{inner}.CHECKSUM").type != fs.FileType.File:
        if required:
            raise ValueError(f"{path}: no checksum")
        return
    with files.open_input_stream(f"{inner}.CHECKSUM") as f:
        words = f.read().decode().split()
    digest = hashlib.sha256()
    with files.open_input_stream(inner) as f:
        while block := f.read(BLOCK):
            digest.update(block)
    if not words or words[0].lower() != digest.hexdigest():
        raise ValueError(f"{path}: checksum mismatch: {digest.hexdigest()}, vendor {words[:1]}")


def batches(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """source, row (from 1) and the cells of the only member."""
    files, inner = _opened(path)
    names = ["source", "row", *columns]

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64() if n == "row" else pa.string()) for n, c in zip(names, zip(*rows))], names)

    with files.open_input_file(inner) as raw, zipfile.ZipFile(raw) as archive:
        members = [m for m in archive.namelist() if not m.endswith("/")]
        if len(members) != 1:
            raise ValueError(f"{path}: {len(members)} members, not one")
        rows: list[list] = []
        with archive.open(members[0]) as f:
            for i, cells in enumerate(csv.reader(io.TextIOWrapper(f, "utf-8", newline="")), 1):
                if len(cells) != len(columns):
                    raise ValueError(f"{path}: row {i} has {len(cells)} cells")
                rows.append([path, i, *cells])
                if len(rows) == BATCH_ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class SpotArchives(DataSource):
    """``spark.read.format("spot_archive").option("checksum", "required").load(path)``; checksum: required, present (the default: where there is one) or ignored."""

    @classmethod
    def name(cls) -> str:
        return "spot_archive"

    def schema(self) -> StructType:
        return StructType([StructField("source", StringType()), StructField("row", LongType()), *(StructField(c, StringType()) for c in SPOT_COLUMNS)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SpotReader(self.options["path"], self.options.get("checksum", "present"))


class SpotReader(DataSourceReader):
    def __init__(self, path: str, checksum: str) -> None:
        if checksum not in ("required", "present", "ignored"):
            raise ValueError(f"checksum: {checksum}")
        self.path, self.checksum = path, checksum

    def partitions(self) -> list[InputPartition]:
        paths = found(self.path)
        if not paths:
            raise ValueError(f"{self.path}: no archive")
        return [Archive(p) for p in paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if self.checksum != "ignored":
            verify(partition.path, self.checksum == "required")
        yield from batches(partition.path, SPOT_COLUMNS)
