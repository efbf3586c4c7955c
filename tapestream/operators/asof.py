"""As-of and forward lookups by one sort of both sides.

Spark has no as-of join in SQL.  Both sides are united with a flag and ordered by time; the
last right row seen is the match (for forward lookups in descending order, as a frame that
grows is one step a row, while one that shrinks is computed anew for each).  Time is cut into
sessions, so that one instrument is many tasks: the last right row before each session, one
row per key and session, goes into it as its first.  No other row is replicated, whatever
the density of either side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapestream.operators import scans
from tapestream.operators.scans import SESSION

def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    columns: Sequence[str],
    tie: str | None = None,
    direction: str = "backward",
    strict: bool = False,
    tolerance: int | None = None,
    prefix: str = "",
    session: int = SESSION,
) -> DataFrame:
    """left with ``columns`` of the right row nearest in time, null where there is none.

    backward: the last right row at or before ``on``; forward: the first at or after it;
    ``strict`` leaves out equal times.  ``tie`` orders right rows of equal time (the last,
    or the first, of them counts).  Beyond ``tolerance`` the match, which stays the only
    candidate, is null.  ``session`` is how much time one task orders at once; the result
    doesn't depend on it.
    """
    back = direction == "backward"
    # at equal times right rows come first for a match that includes them, seen in the order of the scan
    left_flag, right_flag = (0, 1) if strict else (1, 0)
    names = left.columns
    rank = F.struct(F.col(tie).alias("t")) if tie else F.struct(F.lit(0).alias("t"))
    found = F.struct(F.col(on).alias("_at"), *[F.col(c).alias(c) for c in columns])
    part = F.floor(F.col(on) / session).cast("long").alias("_part")
    probes = left.select(*by, part, F.col(on).alias("_us"), F.struct(*names).alias("_left"), F.lit(left_flag).alias("_flag"))
    other = right.where(F.col(on).isNotNull()).select(*by, part, F.col(on).alias("_us"), found.alias("_found"), rank.alias("_tie"), F.lit(right_flag).alias("_flag"))

    ends = other.groupBy(*by, "_part").agg((F.max_by if back else F.min_by)("_found", F.struct("_us", "_tie")).alias("_end"))
    parts = ends.unionByName(probes.select(*by, "_part").distinct(), allowMissingColumns=True).groupBy(*by, "_part").agg(F.max("_end").alias("_end"))
    along = F.col("_part") if back else F.col("_part").desc()
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy(along).rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select(*by, "_part", before.alias("_found")).where("_found is not null").withColumn("_flag", F.lit(-1))

    both = probes.unionByName(other, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    at = [F.col(c) if back else F.col(c).desc() for c in ("_us", "_tie")]
    order = Window.partitionBy(*by, "_part").orderBy(F.col("_flag") >= 0, at[0], "_flag", at[1])
    match = F.last("_found", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_match", match).where(F.col("_left").isNotNull())
    if tolerance is not None:
        gap = F.col("_us") - F.col("_match._at") if back else F.col("_match._at") - F.col("_us")
        out = out.withColumn("_match", F.when(gap <= tolerance, F.col("_match")))
    return out.select(*[F.col(f"_left.{n}").alias(n) for n in names], F.col("_match._at").alias(f"{prefix}at"), *[F.col(f"_match.{c}").alias(f"{prefix}{c}") for c in columns])


def fixed_clock(grid: DataFrame, states: DataFrame, by: Sequence[str], on: str, columns: Sequence[str], tie: str, max_staleness: int) -> DataFrame:
    """grid with the last state's columns and is_available; a state older than max_staleness doesn't count."""
    found = asof(grid, states, by, on, columns, tie)
    age = F.col(on) - F.col("at")
    fresh = F.coalesce(age <= max_staleness, F.lit(False))
    reason = F.when(F.col("at").isNull(), "no_prior_state").when(~fresh, "stale_state")
    kept = [F.when(fresh, F.col(c)).alias(c) for c in columns]
    return found.select(*grid.columns, F.when(fresh, F.col("at")).alias("at"), *kept, fresh.alias("is_available"), reason.alias("unavailable_reason"))


def next_change(states: DataFrame, by: Sequence[str], on: str, value: str, tie: str, search: int, session: int = SESSION) -> DataFrame:
    """states with change_at, change_direction (1, -1) of the first different value after each row, within ``search``.

    The next row with another value starts the next run of equal values, so the
    nearest start among the later rows answers all rows of a run.
    """
    runs = scans.previous(states, by, [on, tie], {"_before": value}, session)
    start = F.coalesce(F.col(value) != F.col("_before"), F.lit(True))
    starts = F.when(start, F.struct(F.col(on).alias("us"), F.col(value).alias("v")))
    out = scans.last_known(runs, by, [on, tie], "_next", starts, inclusive=False, later=True, session=session)
    near = F.col("_next.us") - F.col(on) <= search
    sign = F.when(F.col("_next.v") > F.col(value), 1).otherwise(-1)
    return out.select(*states.columns, F.when(near, F.col("_next.us")).alias("change_at"), F.when(near, sign).alias("change_direction"))


def by_position(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left with ``columns`` of the right row at the same place in its group's order; rows without one are left out."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*left_order))
    other = F.row_number().over(Window.partitionBy(*by).orderBy(*right_order))
    return left.withColumn("_k", place).join(right.select(*by, other.alias("_k"), *columns), [*by, "_k"]).drop("_k")


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], start: str, end: str, on: str, bucket: int) -> DataFrame:
    """Pairs with start < on <= end: each interval is expanded to the time buckets it covers, an equi-join."""
    spans = left.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    points = right.withColumn("_b", F.floor(F.col(on) / bucket))
    joined = spans.join(points, [*by, "_b"])
    return joined.where((F.col(on) > F.col(start)) & (F.col(on) <= F.col(end))).drop("_b")
