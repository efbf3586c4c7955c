"""Sums over the trailing window (T - W, T] of one stream, at its own or other times.

A window's sum is the running sum up to T less that up to T - W: both frames only grow, so
the work is one step a row and window however many events a window holds.  Time is cut into
sessions, so that one instrument is many tasks; the events within the longest window before
a session's start are in it as history, at most one copy each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapestream.operators import scans
from tapestream.operators.scans import SESSION

#: The end of a frame of rows that never holds any.
NOWHERE = -(2**31 - 1)


def trailing(events: DataFrame, by: Sequence[str], on: str, widths: Mapping[str, int], aggregates: Mapping[str, Column], probes: DataFrame | None = None, session: int = SESSION) -> DataFrame:
    """Each aggregate (a sum or a count) over each window, as ``{aggregate}_{window}``, at every event or, if given, every probe.

    Aggregates must ignore nulls, as probes carry null events; a window without events gives
    what the aggregate gives of no rows.  The result doesn't depend on ``session``.
    """
    longest = max(widths.values())
    session = max(session, longest)
    own = F.floor(F.col(on) / session).cast("long")
    parts = F.sequence(own, F.floor((F.col(on) + longest - 1) / session).cast("long"))
    rows = events.withColumns({"_event": F.lit(1), "_own": own, "_part": F.explode_outer(parts)})
    if probes is not None:
        rows = rows.withColumn("_probe", F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in probes.schema) + ">"))
        rows = rows.unionByName(probes.select(*by, on, own.alias("_own"), own.alias("_part"), F.struct(*probes.columns).alias("_probe")), allowMissingColumns=True)
    order = Window.partitionBy(*by, "_part").orderBy(on)
    start = Window.unboundedPreceding

    def over(agg: Column, width: int) -> Column:
        return agg.over(order.rangeBetween(start, 0)) - F.coalesce(agg.over(order.rangeBetween(start, -width)), F.lit(0))

    made = {}
    for w, width in widths.items():
        some = over(F.count("_event"), width) > 0
        for name, agg in aggregates.items():
            made[f"{name}_{w}"] = F.when(some, over(agg, width)).otherwise(agg.over(order.rowsBetween(start, NOWHERE)))
    out = rows.withColumns(made).where(F.col("_part").eqNullSafe(F.col("_own")))
    if probes is None:
        return out.drop("_event", "_own", "_part")
    return out.where(F.col("_probe").isNotNull()).select("_probe.*", *made)


def trade_sums(price: str = "price", qty: str = "qty", side: str = "side") -> dict[str, Column]:
    """Volumes, notionals, count and signed volume; an unknown side counts and subtracts, but has no volume."""
    p, q, s = F.col(price), F.col(qty), F.col(side)
    zero = F.lit(0)

    def of(name: str, value: Column) -> Column:
        return F.when(s == name, value).when(q.isNotNull(), zero)

    return {
        "buy_volume": F.sum(of("buy", q)),
        "sell_volume": F.sum(of("sell", q)),
        "buy_notional": F.sum(of("buy", p * q)),
        "sell_notional": F.sum(of("sell", p * q)),
        "trade_count": F.count(q),
        "signed_volume": F.sum(F.when(s == "buy", q).when(q.isNotNull(), -q)),
    }


def with_ofi(quotes: DataFrame, by: Sequence[str], order: Sequence[str], session: int = SESSION, also: Mapping[str, str] | None = None) -> DataFrame:
    """quotes (bid, bid_sz, ask, ask_sz) with ofi: order-flow imbalance against the quote before, 0 for the first.

    ``also``: further columns of the quote before (new name: column), from the same scan.
    """
    also = dict(also or {})
    seen = scans.previous(quotes, by, order, {f"_{c}": c for c in ("bid", "bid_sz", "ask", "ask_sz")} | also, session)
    bid, bid_sz, ask, ask_sz = (F.col(f"_{c}") for c in ("bid", "bid_sz", "ask", "ask_sz"))
    bought = F.when(F.col("bid") >= bid, F.col("bid_sz")).otherwise(0) - F.when(F.col("bid") <= bid, bid_sz).otherwise(0)
    sold = F.when(F.col("ask") <= ask, F.col("ask_sz")).otherwise(0) - F.when(F.col("ask") >= ask, ask_sz).otherwise(0)
    return seen.withColumn("ofi", F.when(bid.isNull(), 0).otherwise(bought - sold)).select(*quotes.columns, *also, "ofi")
