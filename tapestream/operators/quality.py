"""Validation of market data as issue rows: rule, severity and what it was found on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapestream.operators import scans
from tapestream.operators.scans import SESSION

ERROR, WARNING = "ERROR", "WARNING"


def issues(rows: DataFrame, keys: Sequence[str], rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """A row for each rule (name: severity, condition) that holds, in one pass over rows."""
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, (severity, c) in rules.items()])
    return rows.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_x")).select(*keys, "_x.rule", "_x.severity")


def price_size_rules(price: Column, qty: Column, largest: float = 1e6) -> dict[str, tuple[str, Column]]:
    p, q = price.try_cast("double"), qty.try_cast("double")
    return {
        "invalid_price": (ERROR, price.isNotNull() & (p.isNull() | F.isnan(p) | (p <= 0))),
        "invalid_size": (ERROR, qty.isNotNull() & (q.isNull() | F.isnan(q))),
        "negative_quantity": (ERROR, q < 0),
        "extreme_size": (WARNING, q > largest),
    }


def book_rules(bid: Column, ask: Column) -> dict[str, tuple[str, Column]]:
    return {"crossed_book": (ERROR, bid > ask), "locked_book": (WARNING, bid == ask)}


def previous(column: str, by: Sequence[str], order: Sequence[str]) -> Column:
    """The last value before this row that isn't null."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def sequence_rules(now: Column, before: Column) -> dict[str, tuple[str, Column]]:
    return {"repeated_sequence": (ERROR, now == before), "out_of_order_sequence": (ERROR, now < before), "sequence_gap": (ERROR, now > before + 1)}


def time_rules(now: Column, before: Column, longest_gap: int) -> dict[str, tuple[str, Column]]:
    return {"missing_timestamp": (ERROR, now.isNull()), "backward_timestamp": (ERROR, now < before), "update_gap": (WARNING, now - before > longest_gap)}


def timestamp_text_rules(text: Column, earliest: int, latest: int) -> dict[str, tuple[str, Column]]:
    """Of ISO-8601 texts: missing, not a time, without a zone, or outside [earliest, latest] (microseconds)."""
    at = F.unix_micros(F.try_to_timestamp(text))
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return {
        "missing_timestamp": (ERROR, text.isNull() | (F.trim(text) == "")), "unparseable_timestamp": (ERROR, text.isNotNull() & (F.trim(text) != "") & at.isNull()),
        "naive_timestamp": (ERROR, at.isNotNull() & ~zoned), "timestamp_out_of_range": (ERROR, zoned & ((at < earliest) | (at > latest))),
    }


def first_given(*columns: str) -> Column:
    """The first of alternative text columns that isn't empty, as a number."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns]).try_cast("double")


def observed_price(bid: Column, ask: Column, price: Column) -> Column:
    """The mid where both sides are there, else the price."""
    return F.when(bid.isNotNull() & ask.isNotNull(), (bid + ask) / 2).otherwise(price)


def causality(orders: DataFrame, latency: int) -> DataFrame:
    """Of orders (created, arrival, filled): how many don't arrive after exactly the latency, or fill before they arrive."""
    return orders.agg(F.count("*").alias("orders"), F.count_if(F.col("arrival") != F.col("created") + latency).alias("late_arrivals"), F.count_if(F.col("filled") < F.col("arrival")).alias("early_fills"))


def zero_filled(before: DataFrame, after: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """How many nulls there were, and how many of them are 0 now."""
    both = before.select(*keys, column).join(after.select(*keys, F.col(column).alias("_now")), list(keys)).where(F.col(column).isNull())
    return both.agg(F.count("*").alias("nulls"), F.count_if(F.col("_now") == 0).alias("zero_filled"))


def price_jump(now: Column, before: Column, most_bps: float = 1000.0) -> dict[str, tuple[str, Column]]:
    return {"price_discontinuity": (ERROR, F.abs(F.try_divide(now - before, before)) * 10_000 > most_bps)}


def duplicates(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Second and later copies of equal rows."""
    copy = F.row_number().over(Window.partitionBy(*columns).orderBy(*order))
    return rows.withColumn("copy", copy).where("copy > 1")


def stale(rows: DataFrame, by: Sequence[str], order: Sequence[str], on: str, columns: Sequence[str], longest: int, session: int = SESSION) -> DataFrame:
    """The first row of each run of equal columns at which the run has lasted longer than ``longest``; order[0] is ``on``.

    A run is named by its key and start: of runs that start at one time all but the last end then, and are never late.
    """
    seen = scans.previous(rows, by, order, {f"_{c}": c for c in columns} | {"_on": on}, session)
    changed = F.col("_on").isNull()
    for c in columns:
        changed |= ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    runs = scans.last_known(seen, by, order, "since", F.when(changed, F.col(on)), session=session).select(*rows.columns, "since")
    late = runs.where(F.col(on) - F.col("since") > longest)
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first")
    return late.groupBy(*by, "since").agg(first).select("_first.*", "since")


def check_gate(found: DataFrame) -> None:
    """Raises if any issue is an error."""
    errors = found.where(F.col("severity") == ERROR).groupBy("rule").count().orderBy("rule").collect()
    if errors:
        raise ValueError("data quality gate: " + ", ".join(f"{r['rule']} x {r['count']}" for r in errors))
