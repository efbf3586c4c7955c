"""Simulated executions: depth consumption, queue-then-order allocation, market and limit orders, markouts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapestream.functions.market import short_id
from tapestream.operators import dominance
from tapestream.operators.asof import asof
from tapestream.operators.scans import SESSION


def consume_depth(levels: DataFrame, by: Sequence[str], order: Sequence[str], size: str, quantity: str) -> DataFrame:
    """levels with fill: how much of the quantity each level gives, best level first.

    The fill of a level is the quantity's share of the running size up to it, less that
    before it, so no loop over levels is needed.
    """
    upto = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    q = F.col(quantity)
    return levels.withColumn("_upto", upto).withColumn("fill", F.least(q, F.col("_upto")) - F.least(q, F.col("_upto") - F.col(size))).drop("_upto")


def queue_fill(trades: DataFrame, by: Sequence[str], order: Sequence[str], volume: str, queue: str, quantity: str) -> DataFrame:
    """trades with fill: volume first uses up the queue ahead, then fills the order."""
    upto = F.sum(volume).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

    def done(v: Column) -> Column:
        return F.least(F.col(quantity), F.greatest(v - F.col(queue), F.lit(0.0)))

    return trades.withColumn("_upto", upto).withColumn("fill", done(F.col("_upto")) - done(F.col("_upto") - F.col(volume))).drop("_upto")


def market_fills(orders: DataFrame, books: DataFrame, by: Sequence[str], depth: int) -> DataFrame:
    """Child fills of market orders (order_id, side, quantity, arrival) from the last book at or before arrival.

    books: us, row, and arrays bids and asks of (px, sz), best first.  Buys take asks.
    """
    found = asof(orders.withColumnRenamed("arrival", "us"), books, by, "us", ["bids", "asks"], "row")
    levels = found.withColumn("_levels", F.slice(F.when(F.col("side") == "BUY", F.col("asks")).otherwise(F.col("bids")), 1, depth))
    each = levels.select(*by, "order_id", "side", "quantity", F.col("us").alias("fill_time"), F.posexplode("_levels").alias("level", "l"))
    each = each.select(*by, "order_id", "side", "quantity", "fill_time", (F.col("level") + 1).alias("book_level"), F.col("l.px").alias("price"), F.col("l.sz").alias("size"))
    return consume_depth(each, [*by, "order_id"], ["book_level"], "size", "quantity").where("fill > 0").drop("size")


def passive_fills(orders: DataFrame, trades: DataFrame, by: Sequence[str], session: int = SESSION) -> DataFrame:
    """Child fills of resting orders by prints against them, strictly after arrival and up to the order's end.

    orders: order_id, side, limit_price, quantity, queue, arrival, expiry, cancel (null: none).
    trades: us, row, price, qty, side (the aggressor's).

    Time is cut into sessions of at least the longest order's life; an order is in the session
    of its arrival, a print in its own and, within that life of its start, in the one before.
    A session sums volumes over price and time at once (``dominance``), so no pair of an order
    and a print that doesn't fill it is made.
    """
    live = orders.withColumn("_end", F.least("expiry", F.coalesce("cancel", "expiry"))).where("_end > arrival")
    longest = live.agg(F.max(F.col("_end") - F.col("arrival"))).first()[0] or 0  # one number
    session = max(session, longest)
    own = F.floor(F.col("us") / session).cast("long")
    prints = trades.where((F.col("qty") > 0) & F.col("side").isin("buy", "sell") & F.col("price").isNotNull())
    prints = prints.select(*by, "us", "row", F.col("price").cast("double").alias("t_price"), F.col("qty").cast("double").alias("t_qty"), (F.col("side") == "sell").alias("hits_buys"), F.explode(F.sequence(F.floor((F.col("us") - longest) / session).cast("long"), own)).alias("_part"))
    prints = prints.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_part").orderBy("us", "row"))).drop("row")
    asked = live.select(*by, "order_id", "side", "limit_price", F.col("quantity").cast("double").alias("quantity"), F.col("queue").cast("double").alias("queue"), "arrival", "_end", F.floor(F.col("arrival") / session).cast("long").alias("_part"))
    names = [*by, "order_id", "side", "fill_time", "price", "quantity"]
    schema = "".join(f"`{c}` {asked.schema[c].dataType.simpleString()}, " for c in [*by, "order_id", "side"]) + f"fill_time long, price {asked.schema['limit_price'].dataType.simpleString()}, quantity double"

    def fill(key: tuple, own: pa.Table, seen: pa.Table) -> pa.Table:
        seen = seen.sort_by("_k")
        parts = []
        for side, hits, sign in (("BUY", True, 1.0), ("SELL", False, -1.0)):
            mine, against = own.filter(pc.equal(own["side"], side)), seen.filter(pc.equal(seen["hits_buys"], hits))
            us = against["us"].to_numpy()
            first, last = (np.searchsorted(us, mine[c].to_numpy(), side="right") for c in ("arrival", "_end"))
            limits = sign * mine["limit_price"].cast(pa.float64()).to_numpy()
            taken = dominance.consumed(sign * against["t_price"].to_numpy(), against["t_qty"].to_numpy(), limits, first, last, mine["queue"].to_numpy(), mine["quantity"].to_numpy())
            rows = mine.take(pa.array(taken[0]))
            parts.append(pa.table([*(rows[c] for c in [*by, "order_id", "side"]), pa.array(us[taken[1]]), rows["limit_price"], pa.array(taken[2])], names))
        return pa.concat_tables(parts)

    return asked.groupBy(*by, "_part").cogroup(prints.groupBy(*by, "_part")).applyInArrow(fill, schema)


def passive_summary(orders: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of orders (quantity, arrival, filled and first_us, null: no fill): count, shares filled at all and in full, and time to the first fill."""
    filled = F.coalesce("filled", F.lit(0.0))
    seconds = F.median(F.col("first_us") - F.col("arrival")) / 1_000_000
    return orders.groupBy(*by).agg(
        F.count("*").alias("orders"), F.round(F.avg((filled > 0).cast("double")), 6).alias("any_fill"), F.round(F.avg((filled >= F.col("quantity") - 1e-12).cast("double")), 6).alias("full_fill"),
        F.round(F.avg(F.try_divide(filled, F.col("quantity"))), 6).alias("filled_share"), F.round(seconds, 3).alias("median_seconds"),
    )


def order_status(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """orders with filled and status: FILLED, PARTIALLY_FILLED, CANCELLED or EXPIRED."""
    sums = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"))
    out = orders.join(sums, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0.0)))
    cancelled = F.col("cancel").isNotNull() & (F.col("cancel") < F.col("expiry"))
    status = F.when(F.col("filled") >= F.col("quantity") - 1e-12, "FILLED").when(F.col("filled") > 0, "PARTIALLY_FILLED").when(cancelled, "CANCELLED").otherwise("EXPIRED")
    return out.withColumn("status", status)


def orders_from_transitions(moves: DataFrame, notional: float, latency: int, ttl: int, cancel_latency: int, keys: Sequence[str]) -> DataFrame:
    """Orders of transitions (us, delta, next_at, bid, ask): side, size at the decision's mid, limit at the touch, and times."""
    buy = F.col("delta") > 0
    mid = (F.col("bid") + F.col("ask")) / 2
    arrival = F.col("us") + latency
    expiry = arrival + ttl
    cancel = F.when(F.col("next_at") < expiry, F.col("next_at") + cancel_latency)
    return moves.select(
        *keys,
        short_id(*[F.col(k).cast("string") for k in keys], F.col("us").cast("string")).alias("order_id"),
        F.when(buy, "BUY").otherwise("SELL").alias("side"), F.try_divide(F.abs("delta") * F.lit(float(notional)), mid).alias("quantity"),
        F.when(buy, F.col("bid")).otherwise(F.col("ask")).alias("limit_price"),
        F.col("us").alias("created"), arrival.alias("arrival"), expiry.alias("expiry"), cancel.alias("cancel"), mid.alias("decision_mid"),
    )


def markouts(fills: DataFrame, mids: DataFrame, by: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """fills (us) with the first mid at or after each horizon, or the day's last past its end."""
    last = mids.groupBy(*by).agg(F.max_by("mid", F.struct("us", "row")).alias("_last"))
    out = fills.join(last, list(by), "left")
    for h in horizons:
        shifted = out.withColumn("_t", F.col("us")).withColumn("us", F.col("us") + h)
        found = asof(shifted, mids, by, "us", ["mid"], "row", direction="forward", prefix="_m_")
        out = found.withColumn(f"mid_{h}", F.coalesce("_m_mid", "_last")).withColumn("us", F.col("_t")).drop("_t", "_m_at", "_m_mid")
    return out.drop("_last")


def vwap(price: Column, qty: Column) -> Column:
    return F.try_divide(F.sum(price * qty), F.nullif(F.sum(qty), F.lit(0.0)))


def orphans(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Fills of orders that don't exist."""
    return fills.join(orders.select("order_id"), "order_id", "left_anti")
