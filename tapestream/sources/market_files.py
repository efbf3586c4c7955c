"""Readers and writers of market files."""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapestream.operators import digest
from tapestream.operators.ledger import runs
from tapestream.sources.archives import SpotArchives

L2_COLUMNS = ["exchange", "symbol", "timestamp", "local_timestamp", "is_snapshot", "side", "price", "amount"]
TRADE_COLUMNS = ["exchange", "symbol", "timestamp", "local_timestamp", "id", "side", "price", "amount"]
#: From this day on the spot feed writes microseconds, before it milliseconds.
MICROSECONDS_FROM = "2025-01-01"


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with header, every cell as text, missing cells null; gzip files are one task each."""
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(text_schema(columns)).csv(path)
    return rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in columns])


def micros(text: Column) -> Column:
    """Epoch microseconds of an ISO-8601 time with zone; null where it doesn't parse or has no zone."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.unix_micros(F.try_to_timestamp(text)))


def book_events(spark: SparkSession, path: str) -> DataFrame:
    """Bronze book updates: us (receive time, else event time), side, price, qty, update_type, sequence_id."""
    rows = read_text_csv(spark, path, ["source_row_number", "event_time", "receive_time", "side", "price", "quantity", "update_type", "sequence_id"])
    return rows.select(
        F.col("source_row_number").try_cast("long").alias("row"), F.coalesce(micros(F.col("receive_time")), micros(F.col("event_time"))).alias("us"),
        micros(F.col("event_time")).alias("event_us"), F.lower("side").alias("side"), F.col("price").try_cast("decimal(18,8)").alias("price"),
        F.col("quantity").try_cast("decimal(18,8)").alias("qty"), F.lower(F.coalesce("update_type", F.lit("set"))).alias("update_type"), F.col("sequence_id").try_cast("long").alias("sequence_id"),
    )


def trades(spark: SparkSession, path: str) -> DataFrame:
    rows = read_text_csv(spark, path, ["source_row_number", "event_time", "receive_time", "price", "quantity", "side", "trade_id"])
    return rows.select(
        F.col("source_row_number").try_cast("long").alias("row"), F.coalesce(micros(F.col("receive_time")), micros(F.col("event_time"))).alias("us"),
        F.col("price").try_cast("decimal(18,8)").alias("price"), F.col("quantity").try_cast("decimal(18,8)").alias("qty"), F.lower("side").alias("side"), "trade_id",
    )


def l2_feed(spark: SparkSession, path: str) -> DataFrame:
    """Incremental depth feed, as a replay takes it: snapshot rows start a book, amount 0 deletes a level, row is the order within a file."""
    rows = read_text_csv(spark, path, L2_COLUMNS).withColumn("row", F.monotonically_increasing_id())
    starts = F.coalesce(F.lower("is_snapshot") == "true", F.lit(False))
    return rows.select(
        "row", starts.alias("snapshot"), "symbol", F.col("timestamp").try_cast("long").alias("event_us"), F.col("local_timestamp").try_cast("long").alias("us"), F.lower("side").alias("side"),
        F.col("price").try_cast("decimal(18,8)").alias("price"), F.col("amount").try_cast("decimal(18,8)").alias("qty"),
        F.when(starts, "snapshot").otherwise("set").alias("update_type"), F.input_file_name().alias("source"),
    )


def trade_feed(spark: SparkSession, path: str) -> DataFrame:
    rows = read_text_csv(spark, path, TRADE_COLUMNS)
    return rows.select(
        "symbol", F.col("timestamp").try_cast("long").alias("event_us"), F.col("local_timestamp").try_cast("long").alias("us"), F.col("id").alias("trade_id"),
        F.lower("side").alias("side"), F.col("price").try_cast("decimal(18,8)").alias("price"), F.col("amount").try_cast("decimal(18,8)").alias("qty"),
    )


def zipped_spot_trades(spark: SparkSession, path: str, checksum: str = "present") -> DataFrame:
    """Archives of one headerless CSV each, read by as many tasks as there are archives.

    Rows: source, row, us, price, qty, side (the maker flag turned around), trade_id.  An
    archive of more members, a row of another width, or one that its checksum file doesn't
    fit (``checksum``: required, present or ignored) is an error.
    """
    spark.dataSource.register(SpotArchives)
    rows = spark.read.format("spot_archive").option("checksum", checksum).load(path)
    at = F.col("time").try_cast("long")
    cut = F.unix_micros(F.lit(f"{MICROSECONDS_FROM} 00:00:00+00:00").cast("timestamp"))
    return rows.select(
        "source", "row", F.when(at >= cut, at).otherwise(at * 1000).alias("us"), F.col("price").try_cast("decimal(18,8)").alias("price"), F.col("quantity").try_cast("decimal(18,8)").alias("qty"),
        F.when(F.lower("is_buyer_maker") == "true", "sell").otherwise("buy").alias("side"), "trade_id",
    )


def write_spot_archives(rows: DataFrame, uri: str, *keys: str) -> int:
    """Writes ``{uri}/<keys>.zip`` of rows (trade_id, price, qty, us, side) per key, each with its checksum file; how many there are."""
    names = [*keys, "trade_id", "price", "qty", "us", "side"]
    width = len(keys)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(uri)
        files.create_dir(base, recursive=True)
        at = archive = member = raw = None
        done = 0

        def close() -> None:
            member.close()
            archive.close()
            raw.close()
            digest = hashlib.sha256()
            name = "-".join(map(str, at)) + ".zip"
            aside = f"{base}/{name}.{attempt}"
            with files.open_input_stream(aside) as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            files.move(aside, f"{base}/{name}")
            with files.open_output_stream(f"{base}/{name}.CHECKSUM") as f:
                f.write(f"{digest.hexdigest()}  {name}\n".encode())

        attempt = TaskContext.get().taskAttemptId()
        for key, piece in runs(batches, width):
            if key != at:
                if at is not None:
                    close()
                at, done = key, done + 1
                name = "-".join(map(str, at))
                raw = files.open_output_stream(f"{base}/{name}.zip.{attempt}")
                archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                member = archive.open(f"{name}.csv", "w")
            for trade, price, qty, us, side in zip(*(piece.column(width + c).to_pylist() for c in range(5))):
                member.write(f"{trade},{price},{qty},,{us // 1000},{str(side == 'sell').lower()},true\n".encode())
        if at is not None:
            close()
        yield pa.record_batch([pa.array([done], pa.int64())], ["n"])

    dealt = rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, "us", "trade_id")
    return dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def book_frame(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """Stored book states with numeric levels up to ``depth``; rows without mid, bid or ask are left out."""
    levels = [f"{side}_{what}_{i}" for side in ("bid", "ask") for what in ("px", "sz") for i in range(1, depth + 1)]
    rows = spark.read.parquet(path).select("us", *[F.col(c).try_cast("double").alias(c) for c in ("mid", "bid", "ask", *levels)])
    return rows.dropna(subset=["mid", "bid", "ask"])


def ingest_csv(spark: SparkSession, source: str, target: str, columns: list[str], times: list[str], numbers: list[str]) -> dict[str, int | str]:
    """A CSV of text as typed, zstd-compressed Parquet: times become UTC, numbers decimals, other cells are trimmed.

    A cell that doesn't parse or a time without zone is an error, and so is a row lost on
    the way.  Returns how many rows were read and written, and the digest of what was written.
    """
    text = read_text_csv(spark, source, columns)
    typed = {c: F.timestamp_micros(micros(F.col(c))) for c in times} | {c: F.col(c).try_cast("decimal(38,18)") for c in numbers}
    bad = [F.count_if(F.col(c).isNotNull() & x.isNull()).alias(c) for c, x in typed.items()]
    counts = text.agg(F.count("*").alias("_n"), *bad).first().asDict()
    n = counts.pop("_n")
    if wrong := {c: k for c, k in counts.items() if k}:
        raise ValueError(f"{source}: cells that don't parse: {wrong}")
    text.select(*[typed.get(c, F.trim(c)).alias(c) for c in columns]).write.mode("overwrite").option("compression", "zstd").parquet(target)
    there = content(spark.read.parquet(target))
    if there["rows"] != n:
        raise ValueError(f"{source}: {n} rows read, {there['rows']} written")
    return {"read": n, "written": there["rows"], "digest": there["digest"]}


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header; doubles with 12 significant digits and no trailing zeros."""
    short = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.12g", c), r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
    rows.select(*[F.when(F.col(c).isNotNull(), short(F.col(c))).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def content(rows: DataFrame) -> dict[str, int | str]:
    """Number of rows and digest of a table; neither depends on their order."""
    found = digest.table_digest(rows).first()
    return {"rows": found["rows"], "digest": found["digest"]}


def write_partitioned(rows: DataFrame, path: str, *keys: str) -> dict[str, int | str]:
    """Typed, zstd-compressed Parquet in one folder per key, which later reads prune by; the content of what is there then."""
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*keys).parquet(path)
    return content(rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
