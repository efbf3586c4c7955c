"""Each source and sink over files that are written from the given tables and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestream.bridge import QUOTES, TICKS, quotes, ticks
from tapestream.operators import quality
from tapestream.plans.registry import query
from tapestream.sources import market_files
from tapestream.sources.scratch import new_folder

D = "CAST(round({0}, 4) AS DECIMAL(18,4))"


def _iso(us: str) -> Column:
    """UTC, whatever the session's zone."""
    day, rest = F.floor(F.col(us) / 86_400_000_000), F.col(us) % 86_400_000_000
    clock = F.format_string("T%02d:%02d:%02d.%06dZ", F.floor(rest / 3_600_000_000), F.floor(rest / 60_000_000) % 60, F.floor(rest / 1_000_000) % 60, rest % 1_000_000)
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), clock)


def _csv(rows: DataFrame, name: str, gzip: bool = False) -> str:
    path = new_folder(rows.sparkSession, name)
    rows.write.option("header", True).option("compression", "gzip" if gzip else "none").csv(path)
    return path


def _as_long(found: DataFrame, column: str) -> DataFrame:
    """A column of decimal sums as long, the SQL's type; if a sum passes 64 bits, where the SQL has no result, the decimals stay and are exact.

    The rows are computed once: ``found`` is an aggregate of a few groups.
    """
    made = found.localCheckpoint()
    beyond = made.where(~F.col(column).between(F.lit(-(2**63)).cast("decimal(30,0)"), F.lit(2**63 - 1).cast("decimal(30,0)")))
    return made.withColumn(column, F.col(column).cast("long")) if beyond.isEmpty() else made


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).withColumn("price", F.round("price", 4).cast("decimal(18,4)"))


@query("s01_text_csv", f"""WITH {TICKS} SELECT inst, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE "row" % 5 = 0) AS BIGINT) AS empty, CAST(sum(qty) AS BIGINT) AS qty, true AS same FROM ticks GROUP BY inst""")
def text_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV sink, the text source, and the comparison of what went in and came out."""
    rows = _ticks(spark, sf_dir).select("inst", "row", F.when(F.col("row") % 5 != 0, F.col("side")).alias("side"), "qty")
    path = new_folder(spark, "text")
    market_files.write_csv(rows, path)
    back = market_files.read_text_csv(spark, path, rows.columns)
    same = market_files.same_rows(back, rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]))
    return back.groupBy("inst").agg(F.count("*").alias("n"), F.count_if(F.col("side").isNull()).alias("empty"), F.sum(F.col("qty").try_cast("long")).alias("qty"), F.lit(same).alias("same"))


@query("s02_book_events", f"""WITH {QUOTES} SELECT CASE WHEN "row" % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, CASE WHEN "row" % 4 = 0 THEN 'set' ELSE 'snapshot' END AS update_type, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE "row" % 7 = 0 AND "row" % 3 = 0) AS BIGINT) AS no_time, CAST(sum(CASE WHEN "row" % 3 <> 0 THEN us + 5 WHEN "row" % 7 <> 0 THEN us END - 1700000000000000) AS BIGINT) AS us, CAST(sum(bid_sz) AS DOUBLE) AS qty,
  CAST(count(*) FILTER (WHERE "row" % 11 <> 0) AS BIGINT) AS sequenced FROM quotes GROUP BY 1, 2""")
def book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receive times fall back to event times; a time without zone is none."""
    r = F.col("row")
    rows = quotes(spark, sf_dir).withColumn("late", F.col("us") + 5).select(
        r.alias("source_row_number"), F.when(r % 7 == 0, F.regexp_replace(_iso("us"), "Z$", "")).otherwise(_iso("us")).alias("event_time"), F.when(r % 3 != 0, _iso("late")).alias("receive_time"), F.when(r % 2 == 0, "BID").otherwise("ask").alias("side"),
        F.lit("10.5").alias("price"), F.col("bid_sz").alias("quantity"), F.when(r % 4 != 0, "SNAPSHOT").alias("update_type"), F.when(r % 11 == 0, "x").otherwise(r.cast("string")).alias("sequence_id"),
    )
    back = market_files.book_events(spark, _csv(rows, "book"))
    found = back.groupBy("side", "update_type").agg(F.count("*").alias("n"), F.count_if(F.col("us").isNull()).alias("no_time"), F.sum((F.col("us") - 1_700_000_000_000_000).cast("decimal(20,0)")).alias("us"), F.sum("qty").cast("double").alias("qty"), F.count("sequence_id").alias("sequenced"))
    return _as_long(found, "us")


@query("s03_trades", f"""WITH {TICKS} SELECT side, CAST(count(*) AS BIGINT) AS n, CAST(sum(us - 1700000000000000) AS BIGINT) AS us, CAST(sum({D.format('price')} * qty) AS DOUBLE) AS notional FROM ticks GROUP BY side""")
def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ticks(spark, sf_dir).select(F.col("row").alias("source_row_number"), _iso("us").alias("event_time"), F.lit(None).cast("string").alias("receive_time"), "price", F.col("qty").alias("quantity"), F.upper("side").alias("side"), F.col("row").alias("trade_id"))
    back = market_files.trades(spark, _csv(rows, "trades"))
    found = back.groupBy("side").agg(F.count("*").alias("n"), F.sum((F.col("us") - 1_700_000_000_000_000).cast("decimal(20,0)")).alias("us"), F.sum(F.col("price") * F.col("qty")).cast("double").alias("notional"))
    return _as_long(found, "us")


@query("s04_spot_archive", f"""WITH {TICKS} SELECT inst || '.zip' AS archive, CASE WHEN side = 'sell' THEN 'sell' ELSE 'buy' END AS side, CAST(count(*) AS BIGINT) AS n, CAST(sum(us // 1000 - 1700000000000) AS BIGINT) AS ms, CAST(sum(qty) AS DOUBLE) AS qty, CAST(max({D.format('price')}) AS DOUBLE) AS high
  FROM ticks GROUP BY 1, 2""")
def spot_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive per instrument, whose checksum must be there and fit."""
    path = new_folder(spark, "spot")
    market_files.write_spot_archives(_ticks(spark, sf_dir).withColumn("trade_id", F.col("row")), path, "inst")
    back = market_files.zipped_spot_trades(spark, path, checksum="required")
    return back.groupBy(F.substring_index("source", "/", -1).alias("archive"), "side").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("us") / 1000) - 1_700_000_000_000).alias("ms"), F.sum("qty").cast("double").alias("qty"), F.max("price").cast("double").alias("high"))


@query("s06_depth_feed", f"""WITH {QUOTES} SELECT 'I' || inst AS symbol, CASE WHEN "row" % 10 = 0 THEN 'snapshot' ELSE 'set' END AS update_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(bid_sz) AS DOUBLE) AS qty FROM quotes GROUP BY 1, 2""")
def depth_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotes(spark, sf_dir).select(F.lit("x").alias("exchange"), F.concat(F.lit("I"), F.col("inst").cast("string")).alias("symbol"), F.col("us").alias("timestamp"), F.col("us").alias("local_timestamp"), (F.col("row") % 10 == 0).cast("string").alias("is_snapshot"), F.lit("BID").alias("side"), F.lit("9.5").alias("price"), F.col("bid_sz").alias("amount"))
    back = market_files.l2_feed(spark, _csv(rows, "depth", gzip=True))
    return back.groupBy("symbol", "update_type").agg(F.count("*").alias("n"), F.sum("qty").cast("double").alias("qty"))


@query("s07_trade_feed", f"""WITH {TICKS} SELECT inst AS symbol, side, CAST(count(DISTINCT "row") AS BIGINT) AS trades, CAST(sum({D.format('price')}) AS DOUBLE) AS prices FROM ticks GROUP BY 1, 2""")
def trade_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ticks(spark, sf_dir).select(F.lit("x").alias("exchange"), F.col("inst").alias("symbol"), F.col("us").alias("timestamp"), F.col("us").alias("local_timestamp"), F.col("row").alias("id"), F.upper("side").alias("side"), "price", F.col("qty").alias("amount"))
    back = market_files.trade_feed(spark, _csv(rows, "feed", gzip=True))
    return back.groupBy("symbol", "side").agg(F.count_distinct("trade_id").alias("trades"), F.sum("price").cast("double").alias("prices"))


@query("s08_ingest", f"""WITH {TICKS} SELECT CAST(count(*) AS BIGINT) AS written, CAST(sum({D.format('price')}) AS DOUBLE) AS prices, CAST(sum(us - 1700000000000000) AS BIGINT) AS us, true AS same_content FROM ticks""")
def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV of text as typed Parquet; two ingests of one file have one digest."""
    rows = _ticks(spark, sf_dir).select(_iso("us").alias("at"), "price", F.concat(F.lit(" "), "side", F.lit(" ")).alias("side"))
    source, folders = _csv(rows, "plain"), [new_folder(spark, "typed") for _ in range(2)]
    made = [market_files.ingest_csv(spark, source, f, ["at", "price", "side"], ["at"], ["price"]) for f in folders]
    typed = spark.read.parquet(folders[0]).where(F.col("side") == F.trim("side"))
    found = typed.agg(F.count("*").alias("written"), F.sum("price").cast("double").alias("prices"), F.sum((F.unix_micros("at") - 1_700_000_000_000_000).cast("decimal(20,0)")).alias("us"), F.lit(made[0] == made[1]).alias("same_content"))
    return _as_long(found, "us")


@query("s12_partitioned", f"""WITH {TICKS} SELECT inst, CAST(count(*) AS BIGINT) AS n, CAST(sum(qty) AS BIGINT) AS qty, (SELECT CAST(count(*) AS BIGINT) FROM ticks) AS all_rows FROM ticks WHERE inst IN ('click', 'view') GROUP BY inst""")
def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per instrument; a filter on it reads two of them."""
    path = new_folder(spark, "by-inst")
    made = market_files.write_partitioned(_ticks(spark, sf_dir), path, "inst")
    return spark.read.parquet(path).where(F.col("inst").isin("click", "view")).groupBy("inst").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.lit(made["rows"]).cast("long").alias("all_rows"))


@query("s14_book_frame", f"""WITH {QUOTES} SELECT inst, CAST(count(*) AS BIGINT) AS n, CAST(sum(bid_sz) AS DOUBLE) AS bid_sz, CAST(count(*) FILTER (WHERE "row" % 3 <> 0) AS BIGINT) AS second_level FROM quotes WHERE "row" % 4 <> 0 GROUP BY inst""")
def book_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored states with text levels; those without a mid are left out."""
    path = new_folder(spark, "states")
    r = F.col("row")
    levels = {"bid_px_1": F.col("bid"), "bid_sz_1": F.col("bid_sz"), "ask_px_1": F.col("ask"), "ask_sz_1": F.col("ask_sz")} | {f"{s}_{w}_2": F.when(r % 3 != 0, F.lit(1)) for s in ("bid", "ask") for w in ("px", "sz")}
    states = quotes(spark, sf_dir).select((F.col("us") * 8 + F.col("inst")).alias("us"), F.when(r % 4 != 0, F.col("mid")).cast("string").alias("mid"), F.col("bid").cast("string"), F.col("ask").cast("string"), *[v.cast("string").alias(k) for k, v in levels.items()])
    states.write.parquet(path)
    back = market_files.book_frame(spark, path, 2)
    return back.groupBy((F.col("us") % 8).alias("inst")).agg(F.count("*").alias("n"), F.sum("bid_sz_1").alias("bid_sz"), F.count("bid_px_2").alias("second_level"))


@query("p12_gate", f"""WITH {QUOTES} SELECT inst, count(*) FILTER (WHERE bid + bid_sz > ask + ask_sz) > 0 AS blocked FROM quotes GROUP BY inst""")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each instrument's errors block what follows; the gate itself is held against it over all of them."""
    found = quality.issues(quotes(spark, sf_dir), ["inst"], quality.book_rules(F.col("bid") + F.col("bid_sz"), F.col("ask") + F.col("ask_sz")))
    try:
        quality.check_gate(found)
        passed = True
    except ValueError:
        passed = False
    errors = found.where(F.col("severity") == quality.ERROR).select("inst").distinct().withColumn("blocked", F.lit(not passed))
    return quotes(spark, sf_dir).select("inst").distinct().join(errors, "inst", "left").select("inst", F.coalesce("blocked", F.lit(False)).alias("blocked"))
