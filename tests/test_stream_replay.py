"""A book replayed over a stream gives the rows of the batch replay."""

import random

import pytest
from pyspark.sql import functions as F

from tapestream.operators import book
from tapestream.streaming import replay

SCHEMA = "inst string, us long, row long, side string, price double, qty double, snapshot boolean"


def feed(seed=3, n=300):
    rng, us, out = random.Random(seed), 1_700_000_000_000_000, []
    for i in range(n):
        us += rng.choice([0, 0, 2000, 7000, 90_000])
        side = rng.choice(["bid", "ask"])
        price = float(rng.randint(90, 99) if side == "bid" else rng.randint(100, 109))
        out.append((rng.choice(["x", "y"]), us, i, side, price, float(rng.choice([0, 1, 2, 3])), rng.random() < 0.03))
    return out


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_batch_replay_in_sessions(spark):
    updates = spark.createDataFrame(feed(), SCHEMA).repartition(3)
    for need in (True, False):
        whole = rows_of(book.replay(updates, ["inst"], "us", ["us", "row"], 3, need))
        for session in (5_000, 1_000_000, 10**12):
            assert rows_of(book.replay(updates, ["inst"], "us", ["us", "row"], 3, need, session)) == whole
    assert book.replay(updates.limit(0), ["inst"], "us", ["us", "row"], 3).count() == 0


@pytest.mark.parametrize("need", [True, False])
def test_stream_equals_batch_over_cut_groups_and_a_restart(spark, tmp_path, need):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", replay.PROVIDER)
    try:
        rows = feed()
        end = rows[-1][1] + 10_000_000
        closing = [(inst, end, 10_000 + i, "bid", 1.0, 0.0, False) for i, inst in enumerate("xy")]
        cuts = [0, 1, 40, 41, 120, 230, len(rows)]  # within groups too

        def add(part, k):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def go():
            source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = replay.replay_stream(source, ["inst"], 3, need, "5 milliseconds")
            query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()

        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            add(random.Random(k).sample(rows[a:b], b - a), k)
            if k in (0, 2, 5):
                go()  # each start goes on from the checkpoint
        add(closing, 99)
        go()
        batch = book.replay(spark.createDataFrame(rows, SCHEMA), ["inst"], "us", ["us", "row"], 3, need)
        got = spark.read.parquet(str(tmp_path / "out")).where(F.col("us") < end)
        assert got.columns == batch.columns and rows_of(got) == rows_of(batch)
        assert batch.count() > 50
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
