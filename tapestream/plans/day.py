"""A market day from level updates and trades to features, labels and simulated executions, as one lineage.

All instruments and days run together: ``by`` holds the keys of a session, which nothing
crosses.  Times are epoch microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapestream.functions import market
from tapestream.operators import asof, book, execution, signals, trailing

MS = 1000
WINDOWS = {market.window_name(w * MS): w * MS for w in (100, 500, 1000, 5000, 30_000)}
VOLATILITY = {market.window_name(w * MS): w * MS for w in (1000, 5000, 30_000)}
MOMENTUM = {market.window_name(w * MS): w * MS for w in (100, 500, 1000, 5000)}
HORIZONS = WINDOWS


def event_states(updates: DataFrame, by: Sequence[str], depth: int = 10, need_snapshot: bool = True) -> DataFrame:
    """The book after each receive time, with bid, ask, sizes, mid and spread; row is its place in time."""
    states = book.replay(updates, by, "us", ["us", "row"], depth, need_snapshot)
    top = {"bid": "bid_px_1", "bid_sz": "bid_sz_1", "ask": "ask_px_1", "ask_sz": "ask_sz_1"}
    states = states.withColumns({k: F.col(v) for k, v in top.items()} | {"row": F.col("us")})
    return states.withColumns({"mid": market.mid(F.col("bid"), F.col("ask")), "spread": F.col("ask") - F.col("bid")})


def check_states(states: DataFrame) -> None:
    """Raises if a group left a book crossed or locked."""
    bad = states.where("status <> 'ok'").groupBy("status").count().collect()
    if bad:
        raise ValueError("book: " + ", ".join(f"{r['status']} x {r['count']}" for r in bad))


def fixed_clock(states: DataFrame, by: Sequence[str], step: int = 100 * MS, max_staleness: int = 1000 * MS) -> DataFrame:
    """States at every step from the first state's own time, with staleness; grid is the place."""
    span = states.groupBy(*by).agg(F.min("us").alias("a"), F.max("us").alias("b"))
    grid = span.select(*by, F.posexplode(F.sequence("a", "b", F.lit(step))).alias("grid", "us"))
    columns = [c for c in states.columns if c not in (*by, "us", "row", "status")]
    return asof.fixed_clock(grid, states, by, "us", columns, "row", max_staleness)


def _sums(side: str, depth: int) -> Column:
    return sum((F.coalesce(F.col(f"{side}_sz_{i}"), F.lit(0.0)) for i in range(1, depth + 1)), F.lit(0.0))


def features(clock: DataFrame, states: DataFrame, trades: DataFrame, by: Sequence[str], depths: Sequence[int] = (5, 10)) -> DataFrame:
    """clock with state features, and order flow, trades, volatility and momentum of trailing windows.

    Window features use every state and trade, not the sampled ones, and are there also
    where the clock's own state is stale.
    """
    b, bs, a, az = (F.col(c) for c in ("bid", "bid_sz", "ask", "ask_sz"))
    micro = market.microprice(b, bs, a, az)
    own = {"spread_bps": market.spread_bps(b, a), "qi_1": market.imbalance(bs, az), "microprice": micro, "microprice_bps": F.try_divide((micro - F.col("mid")) * 10_000, F.col("mid"))}
    have = [d for d in depths if f"bid_sz_{d}" in clock.columns]
    own |= {f"depth_imbalance_{d}": market.imbalance(_sums("bid", d), _sums("ask", d)) for d in have}
    out = clock.withColumns(own)
    flow = trailing.with_ofi(states, by, ["us", "row"], also={"_mid": "mid"})
    flow = flow.select(*by, "us", "row", "mid", F.col("ofi").cast("double").alias("ofi"), market.log_return(F.col("mid"), F.col("_mid")).alias("ret"))
    out = trailing.trailing(flow, by, "us", WINDOWS, {"ofi": F.sum("ofi"), "ofi_events": F.count("ofi")}, probes=out)
    out = trailing.trailing(flow, by, "us", VOLATILITY, {"r2": F.sum(F.col("ret") * F.col("ret")), "returns": F.count("ret")}, probes=out)
    out = trailing.trailing(trades.select(*by, "us", "price", "qty", "side"), by, "us", WINDOWS, trailing.trade_sums(), probes=out)
    made = {f"volatility_{w}": F.when(F.col(f"returns_{w}") > 0, F.sqrt(F.greatest(f"r2_{w}", F.lit(0.0)))) for w in VOLATILITY}
    made |= {f"trade_imbalance_{w}": market.imbalance(F.col(f"buy_volume_{w}"), F.col(f"sell_volume_{w}")) for w in WINDOWS}
    made |= {f"{n}_{w}": F.coalesce(f"{n}_{w}", F.lit(0)) for w in WINDOWS for n in trailing.trade_sums()}
    out = out.withColumns(made).drop(*[f"{n}_{w}" for w in VOLATILITY for n in ("r2", "returns")])
    now = asof.asof(out, states, by, "us", ["mid"], "row", prefix="_now_")
    for w, width in MOMENTUM.items():
        then = asof.asof(now.withColumn("_us", F.col("us")).withColumn("us", F.col("us") - width), states, by, "us", ["mid"], "row", prefix="_then_")
        now = then.withColumn("us", F.col("_us")).withColumn(f"momentum_{w}", market.log_return(F.col("_now_mid"), F.col("_then_mid"))).drop("_us", "_then_at", "_then_mid")
    return now.drop("_now_at", "_now_mid")


def labels(clock: DataFrame, by: Sequence[str], tolerance: int = 100 * MS, threshold_bps: float = 0.5, search: int = 30_000 * MS) -> DataFrame:
    """Forward returns, directions and delays at each horizon, and the next change of the mid.

    Only valid clock rows can be a label; a row that isn't valid itself has target times
    and nothing else.
    """
    valid = clock.where("is_available").select(*by, "us", F.col("us").alias("row"), "mid")
    out = clock.select(*by, "us", "grid", "is_available", "mid", "spread")
    for h, width in HORIZONS.items():
        ahead = asof.asof(out.withColumn("_us", F.col("us")).withColumn("us", F.col("us") + width), valid, by, "us", ["mid"], "row", direction="forward", tolerance=tolerance, prefix="_f_")
        ok = F.col("is_available") & F.col("_f_mid").isNotNull()
        ret = F.when(ok, market.log_return(F.col("_f_mid"), F.col("mid")))
        out = ahead.withColumns({
            f"target_{h}": F.col("us"), f"ret_fwd_{h}": ret, f"direction_{h}": market.direction(ret, threshold_bps), f"delay_ms_{h}": F.when(ok, market.elapsed_ms(F.col("us"), F.col("_f_at"))),
            f"move_bps_{h}": F.when(ok, F.try_divide((F.col("_f_mid") - F.col("mid")) * 10_000, F.col("mid"))),
            f"move_spreads_{h}": F.when(ok & (F.col("spread") > 0), F.try_divide(F.col("_f_mid") - F.col("mid"), F.col("spread"))),
        }).withColumn("us", F.col("_us")).drop("_us", "_f_at", "_f_mid")
    change = asof.next_change(valid, by, "us", "mid", "row", search).select(*by, "us", "change_at", "change_direction")
    return out.join(change, [*by, "us"], "left")


def simulate(clock: DataFrame, positions: DataFrame, trades: DataFrame, by: Sequence[str], latencies: Sequence[int], notional: float = 10_000.0, ttl: int = 1000 * MS, cancel_latency: int = 100 * MS, queue: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Passive orders and fills of position changes for every latency at once.

    positions: session keys, us, row and signal.  Scenarios are rows: a session key
    ``latency`` is added, and each step partitions by it.
    """
    keys = [*by, "latency"]
    grid = F.explode(F.array(*[F.lit(int(x)) for x in latencies]))
    moves = signals.transitions(positions, by, ["us", "row"], "us", "signal")
    decided = asof.asof(moves, clock.where("is_available").withColumn("row", F.col("us")), by, "us", ["bid", "ask", "bid_sz", "ask_sz"], "row", prefix="")
    decided = decided.where("bid is not null").withColumn("latency", grid)
    orders = execution.orders_from_transitions(decided.withColumn("us", F.col("us")), notional, 0, ttl, cancel_latency, keys)
    orders = orders.withColumns({"arrival": F.col("created") + F.col("latency"), "expiry": F.col("created") + F.col("latency") + ttl})
    touch = asof.asof(orders.withColumn("us", F.col("arrival")), clock.where("is_available").withColumn("row", F.col("us")), by, "us", ["bid", "ask", "bid_sz", "ask_sz"], "row", prefix="_a_")
    ahead = F.when((F.col("side") == "BUY") & (F.col("_a_bid") == F.col("limit_price")), F.col("_a_bid_sz")).when((F.col("side") == "SELL") & (F.col("_a_ask") == F.col("limit_price")), F.col("_a_ask_sz")).otherwise(0.0)
    orders = touch.withColumn("queue", ahead * queue).drop("us", "_a_at", "_a_bid", "_a_ask", "_a_bid_sz", "_a_ask_sz")
    prints = trades.withColumn("latency", grid)
    fills = execution.passive_fills(orders, prints, keys)
    return execution.order_status(orders, fills), fills
