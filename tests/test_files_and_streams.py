import gzip
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapestream.sources import market_files
from tapestream.streaming.windows import trade_bars


def test_spot_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "1,10.5,2,21,1704067200000,true,true\n2,10.6,1,10.6,1735689600000000,false,true\n")
    out = market_files.zipped_spot_trades(spark, str(tmp_path / "a.zip")).orderBy("row").collect()
    assert [(r.row, r.us, float(r.price), r.side) for r in out] == [(1, 1704067200000000, 10.5, "sell"), (2, 1735689600000000, 10.6, "buy")]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("a.csv", "1,2\n")
        z.writestr("b.csv", "1,2\n")
    with pytest.raises(Exception, match="2 members"):
        market_files.zipped_spot_trades(spark, str(tmp_path / "b.zip")).collect()


def test_depth_feed(spark, tmp_path):
    with gzip.open(tmp_path / "l2.csv.gz", "wt") as f:
        f.write("exchange,symbol,timestamp,local_timestamp,is_snapshot,side,price,amount\nx,BTC,100,105,true,BID,9.5,1\nx,BTC,110,,false,ask,10,0\n")
    out = market_files.l2_feed(spark, str(tmp_path / "l2.csv.gz")).collect()
    assert [(r.us, r.side, float(r.price), r.update_type) for r in out] == [(105, "bid", 9.5, "snapshot"), (None, "ask", 10.0, "set")]


def test_book_events_fall_back_to_event_time(spark, tmp_path):
    (tmp_path / "b.csv").write_text("source_row_number,event_time,receive_time,side,price,quantity,update_type,sequence_id\n1,2024-01-01T00:00:00.000001Z,,BID,1,2,,7\n2,2024-01-01T00:00:00,,ask,1,2,set,x\n")
    out = market_files.book_events(spark, str(tmp_path / "b.csv")).orderBy("row").collect()
    assert [(r.us, r.side, r.update_type, r.sequence_id) for r in out] == [(1704067200000001, "bid", "set", 7), (None, "ask", "set", None)]


def test_partitioned_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "i long, day string, x double")
    market_files.write_partitioned(t, str(tmp_path / "t"), "day")
    assert market_files.same_rows(spark.read.parquet(str(tmp_path / "t")).select(t.columns), t)
    assert not market_files.same_rows(t, t.union(t))


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    data = [("a", start + timedelta(minutes=i), 1.0, i, "buy" if i % 2 else "sell") for i in range(60)]
    trades = spark.createDataFrame(data, "inst string, ts timestamp, price double, qty long, side string")
    trades.write.parquet(str(tmp_path / "in"))
    stream = trade_bars(spark.readStream.schema(trades.schema).parquet(str(tmp_path / "in")), "15 minutes")
    q = stream.writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {(r.start, r.buy_volume, r.trade_count) for r in spark.table("bars").collect()}
    want = {(r.start, r.buy_volume, r.trade_count) for r in trade_bars(trades, "15 minutes").collect()}
    assert got and got <= want  # the last windows wait for the watermark
    assert trade_bars(trades, "15 minutes").agg(F.sum("trade_count")).first()[0] == 60


def test_archive_cells_are_csv_and_folders_no_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("folder/", "")
        z.writestr("folder/a.csv", '"1",10.5,"2",21,1704067200000,TRUE,"a,b"\n')
    (row,) = market_files.zipped_spot_trades(spark, str(tmp_path / "a.zip")).collect()
    assert (row.trade_id, float(row.price), row.side) == ("1", 10.5, "sell")


def test_depth_feed_can_be_replayed(spark, tmp_path):
    from tapestream.operators import book

    with gzip.open(tmp_path / "l2.csv.gz", "wt") as f:
        f.write("exchange,symbol,timestamp,local_timestamp,is_snapshot,side,price,amount\n")
        f.write("x,B,1,1,TRUE,bid,9,1\nx,B,1,1,True,ask,11,2\nx,B,2,2,false,bid,10,5\nx,B,2,2,false,bid,10,4\nx,B,3,3,false,ask,11,0\n")
    feed = market_files.l2_feed(spark, str(tmp_path / "l2.csv.gz")).withColumn("qty", F.col("qty").cast("double"))
    states = book.replay(feed, ["symbol"], "us", ["us", "row"], 1).orderBy("us").collect()
    assert [(r.us, r.bid_px_1, r.bid_sz_1, r.ask_px_1) for r in states] == [(1, 9.0, 1.0, 11.0), (2, 10.0, 4.0, 11.0), (3, 10.0, 4.0, None)]


def test_generic_ingest_and_csv_sink(spark, tmp_path):
    (tmp_path / "t.csv").write_text("at,price,note\n2024-01-01T00:00:00Z,1.50, a \n2024-01-01T00:00:01+00:00,,b\n")
    made = market_files.ingest_csv(spark, str(tmp_path / "t.csv"), str(tmp_path / "t"), ["at", "price", "note"], ["at"], ["price"])
    assert (made["read"], made["written"], len(made["digest"])) == (2, 2, 64)
    rows = spark.read.parquet(str(tmp_path / "t")).orderBy("at").collect()
    assert [(r.price and float(r.price), r.note) for r in rows] == [(1.5, "a"), (None, "b")]
    (tmp_path / "bad.csv").write_text("at,price,note\n2024-01-01T00:00:00,x,a\n")
    with pytest.raises(ValueError, match="at"):
        market_files.ingest_csv(spark, str(tmp_path / "bad.csv"), str(tmp_path / "u"), ["at", "price", "note"], ["at"], ["price"])
    numbers = [0.1, 1234.5, 1e-7, 100.0, None, 1 / 3, 2.5e20]
    market_files.write_csv(spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").coalesce(1), str(tmp_path / "c"))
    back = {r.i: r.x for r in spark.read.option("header", True).schema("i int, x string").csv(str(tmp_path / "c")).collect()}
    assert [back[i] and float(back[i]) for i in range(7)] == [pytest.approx(x, rel=1e-11) if x is not None else None for x in numbers]
    assert back[0] == "0.1" and back[1] == "1234.5" and back[3] == "100"


def test_book_frame_leaves_out_rows_without_a_side(spark, tmp_path):
    rows = [(1, "10", "9", "11", "1"), (2, "10", None, "11", "1"), (3, "x", "9", "11", "1")]
    columns = ["mid", "bid", "ask", "bid_px_1"]
    frame = spark.createDataFrame(rows, "us long, " + ", ".join(f"{c} string" for c in columns))
    frame.withColumns({c: F.lit("1") for c in ("bid_sz_1", "ask_px_1", "ask_sz_1")}).write.parquet(str(tmp_path / "b"))
    assert [r.us for r in market_files.book_frame(spark, str(tmp_path / "b"), 1).collect()] == [1]


def test_archives_are_held_against_their_checksums(spark, tmp_path):
    import hashlib

    rows = spark.createDataFrame([(k, i, 10.5 + i, i + 1, 1_704_067_200_000_000 + 1000 * i, "sell" if i % 2 else "buy") for k in ("a", "b") for i in range(50)], "k string, trade_id long, price double, qty long, us long, side string")
    assert market_files.write_spot_archives(rows, str(tmp_path / "z"), "k") == 2
    assert sorted(p.name for p in (tmp_path / "z").iterdir()) == ["a.zip", "a.zip.CHECKSUM", "b.zip", "b.zip.CHECKSUM"]
    back = market_files.zipped_spot_trades(spark, str(tmp_path / "z"), checksum="required")
    assert back.rdd.getNumPartitions() == 2 and back.count() == 100
    got = sorted((float(r.price), int(r.qty), r.us, r.side, r.trade_id) for r in back.where(F.col("source").endswith("b.zip")).collect())
    assert got == sorted((r.price, r.qty, r.us, r.side, str(r.trade_id)) for r in rows.where("k = 'b'").collect())
    one = market_files.zipped_spot_trades(spark, str(tmp_path / "z" / "a*.zip"))
    assert one.count() == 50 and one.agg(F.min("row"), F.max("row")).first() == (1, 50)
    (tmp_path / "z" / "a.zip.CHECKSUM").write_text(hashlib.sha256(b"other").hexdigest() + "  a.zip\n")
    for checksum in ("present", "required"):
        with pytest.raises(Exception, match="checksum mismatch"):
            market_files.zipped_spot_trades(spark, str(tmp_path / "z"), checksum=checksum).collect()
    assert market_files.zipped_spot_trades(spark, str(tmp_path / "z"), checksum="ignored").count() == 100
    (tmp_path / "z" / "a.zip.CHECKSUM").unlink()
    assert market_files.zipped_spot_trades(spark, str(tmp_path / "z")).count() == 100
    with pytest.raises(Exception, match="no checksum"):
        market_files.zipped_spot_trades(spark, str(tmp_path / "z"), checksum="required").collect()


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """Few events so far from the sources' epoch that their times sum to more than 64 bits."""
    import duckdb

    folder = tmp_path_factory.mktemp("far")
    duckdb.connect().execute(f"COPY (SELECT event_id, TIMESTAMP '9990-01-01 00:00:00' + to_seconds(event_id) AS ts, user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet') TO '{folder}/events.parquet'")
    return str(folder)


def offsets(folder, kept="true"):
    import duckdb

    return duckdb.connect().execute(f"SELECT sum(epoch_us(ts) - 1700000000000000 + CASE WHEN event_id % 3 <> 0 THEN 5 ELSE 0 END)::VARCHAR, sum(epoch_us(ts) - 1700000000000000)::VARCHAR FROM '{folder}/events.parquet' WHERE {kept}").fetchone()


def test_book_event_times_past_64_bits_are_summed_exactly(spark, far):
    from tapestream.plans import source_queries

    rows = source_queries.book_events(spark, far).collect()
    assert str(sum(int(r.us) for r in rows)) == offsets(far, "event_id % 3 <> 0 OR event_id % 7 <> 0")[0]
    assert max(int(r.us) for r in rows) > 2**63
    assert dict(source_queries.book_events(spark, "/root/testdata/sf0.001").dtypes)["us"] == "bigint"


def test_trade_times_past_64_bits_are_summed_exactly(spark, far):
    from tapestream.plans import source_queries

    rows = source_queries.trades(spark, far).collect()
    assert str(sum(int(r.us) for r in rows)) == offsets(far)[1] and max(int(r.us) for r in rows) > 2**63
    assert dict(source_queries.trades(spark, "/root/testdata/sf0.001").dtypes)["us"] == "bigint"


def test_ingested_times_past_64_bits_are_summed_exactly(spark, far):
    from tapestream.plans import source_queries

    (row,) = source_queries.ingest(spark, far).collect()
    assert (str(row.us), row.written, row.same_content) == (offsets(far)[1], 1000, True)
    assert dict(source_queries.ingest(spark, "/root/testdata/sf0.001").dtypes)["us"] == "bigint"
