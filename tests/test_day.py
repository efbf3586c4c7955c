import random

import pytest
from pyspark.sql import functions as F

from tapestream.plans import day

MS = 1000


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(9)
    updates, trades = [], []
    for i in range(200):
        base = 100 + (i // 20) % 3
        if i == 0:
            updates += [("x", 0, k, side, float(base + s * (k + 1)), 5.0, True) for side, s in (("bid", -1), ("ask", 1)) for k in range(5)]
        else:
            side = rng.choice(["bid", "ask"])
            updates.append(("x", i * 50 * MS, 100 + i, side, float(99 - rng.randint(0, 3) if side == "bid" else 101 + rng.randint(0, 3)), float(rng.randint(1, 9)), False))
        trades.append(("x", i * 50 * MS + 7, i, 100.0 + rng.choice([-1, 1]), rng.randint(1, 4), rng.choice(["buy", "sell"])))
    u = spark.createDataFrame(updates, "inst string, us long, row long, side string, price double, qty double, snapshot boolean")
    t = spark.createDataFrame(trades, "inst string, us long, row long, price double, qty long, side string")
    states = day.event_states(u, ["inst"], 5).cache()
    return states, t, day.fixed_clock(states, ["inst"]).cache()


def test_clock_features_and_labels(spark, market):
    states, trades, clock = market
    day.check_states(states)
    assert states.count() == 200 and clock.count() == 100 and clock.where("not is_available").count() == 0
    out = day.features(clock, states, trades, ["inst"], (5,))
    assert out.count() == 100
    at = 3000 * MS
    row = out.where(F.col("us") == at).first()
    volume = trades.where(f"us > {at - 1000 * MS} and us <= {at}").agg(F.sum("qty"), F.count("*")).first()
    assert (row.buy_volume_1s + row.sell_volume_1s, row.trade_count_1s) == tuple(volume)
    assert row.ofi_events_500ms == states.where(f"us > {at - 500 * MS} and us <= {at}").count()
    lab = day.labels(clock, ["inst"])
    pair = {r.us: r.mid for r in clock.collect()}
    got = lab.where(F.col("us") == at).first()
    assert got.target_1s == at + 1000 * MS and got.delay_ms_1s == 0
    import math

    assert got.ret_fwd_1s == pytest.approx(math.log(pair[at + 1000 * MS] / pair[at]))
    assert lab.where("us > 9800000 and ret_fwd_500ms is not null").count() == 0


def test_future_states_do_not_move_past_features(spark, market):
    states, trades, clock = market
    cut = 4000 * MS
    later = F.col("us") > cut
    columns = [c for c in day.features(clock, states, trades, ["inst"], (5,)).columns if c not in ("grid",)]
    one = day.features(clock, states, trades, ["inst"], (5,)).where(~later).select(columns)
    moved = trades.withColumn("qty", F.when(later, F.col("qty") * 9).otherwise(F.col("qty")))
    shifted = states.withColumns({c: F.when(later, F.col(c) * 2).otherwise(F.col(c)) for c in ("mid", "bid_sz", "ask_sz")})
    two = day.features(clock, shifted, moved, ["inst"], (5,)).where(~later).select(columns)
    assert one.exceptAll(two).isEmpty()


def test_scenarios_run_together(spark, market):
    states, trades, clock = market
    rows = [("x", 500 * MS * i, i, s) for i, s in enumerate([0, 1, 1, -1, 0, 1, 0, -1, 0, 0, 1, 0])]
    wanted = spark.createDataFrame(rows, "inst string, us long, row long, signal int")
    orders, fills = day.simulate(clock, wanted, trades, ["inst"], [0, 100 * MS], notional=500.0)
    got = {r.latency: r["count"] for r in orders.groupBy("latency").count().collect()}
    assert got[0] == got[100 * MS] == 9
    assert orders.where("arrival <> created + latency").count() == 0
    late = fills.join(orders.select("order_id", "arrival", "expiry"), "order_id").where("fill_time <= arrival or fill_time > expiry")
    assert late.count() == 0
    over = fills.groupBy("order_id").agg(F.sum("quantity").alias("f")).join(orders, "order_id").where("f > quantity + 1e-9")
    assert over.count() == 0
