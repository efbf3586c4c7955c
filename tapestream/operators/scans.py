"""Scans along time in two passes, so that one key is many tasks.

A window over a key alone is one task however long the key is.  Here time is cut into
sessions: what each session passes on (a sum, a maximum, its last row) is aggregated, which
combines before the shuffle; these few rows, one per key and session, are scanned; and each
session's rows are scanned from what came before it, which is put before them as a row of
its own.  The results don't depend on ``session``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a session.
SESSION = 86_400_000_000

Passed = tuple[Column, Callable[[Column], Column]]
"""What a session passes on, and how it is combined with what earlier ones passed on."""


def cut(rows: DataFrame, by: Sequence[str], order: Sequence[str], passed: Mapping[str, Passed], session: int, back: bool = False) -> DataFrame:
    """rows with _part, and for each session after the first a row (_carried) of what was passed on."""
    own = rows.withColumn("_part", F.floor(F.col(order[0]) / session).cast("long"))
    ends = own.groupBy(*by, "_part").agg(*[end.alias(name) for name, (end, _) in passed.items()])
    before = Window.partitionBy(*by).orderBy(F.col("_part").desc() if back else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_part", F.count("*").over(before).alias("_n"), *[combine(F.col(name)).over(before).alias(name) for name, (_, combine) in passed.items()])
    carried = carried.where("_n > 0").drop("_n").withColumn("_carried", F.lit(True))
    return own.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)


def _scanned(parts: DataFrame, by: Sequence[str], order: Sequence[str], made: Callable[[Window], Mapping[str, Column]], drop: Sequence[str], back: bool = False) -> DataFrame:
    along = [F.col(c).desc() if back else F.col(c) for c in order]
    window = Window.partitionBy(*by, "_part").orderBy(F.col("_carried").desc(), *along)
    return parts.withColumns(dict(made(window))).where(~F.col("_carried")).drop("_part", "_carried", *drop)


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None, session: int = SESSION) -> DataFrame:
    """rows with sums and maxima of all rows up to each, nulls passed over; order[0] is a number, the time."""
    kinds = {name: (F.sum, value) for name, value in (sums or {}).items()} | {name: (F.max, value) for name, value in (maxima or {}).items()}
    values = rows.withColumns({f"_v_{name}": value for name, (_, value) in kinds.items()})
    parts = cut(values, by, order, {f"_v_{name}": (f(f"_v_{name}"), f) for name, (f, _) in kinds.items()}, session)

    def made(window: Window) -> dict[str, Column]:
        upto = window.rowsBetween(Window.unboundedPreceding, 0)
        return {name: f(f"_v_{name}").over(upto) for name, (f, _) in kinds.items()}

    return _scanned(parts, by, order, made, [f"_v_{name}" for name in kinds])


def previous(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Mapping[str, str], session: int = SESSION) -> DataFrame:
    """rows with columns (new name: column) of the row before each, null for a key's first; nulls are values like others."""
    held = rows.withColumn("_scan_held", F.struct(*[F.col(c).alias(name) for name, c in columns.items()]))
    parts = cut(held, by, order, {"_scan_held": (F.max_by("_scan_held", F.struct(*order)), F.last)}, session)
    found = _scanned(parts, by, order, lambda w: {"_scan_prior": F.lag("_scan_held").over(w)}, ["_scan_held"])
    return found.withColumns({name: F.col(f"_scan_prior.{name}") for name in columns}).drop("_scan_prior")


def last_known(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str, value: Column, inclusive: bool = True, later: bool = False, session: int = SESSION) -> DataFrame:
    """rows with the nearest value that isn't null, of rows up to each (``inclusive``) or before it; ``later``: from or after it."""
    held = rows.withColumn("_scan_held", value)
    nearest = F.min_by if later else F.max_by
    end = nearest("_scan_held", F.when(F.col("_scan_held").isNotNull(), F.struct(*order)))
    parts = cut(held, by, order, {"_scan_held": (end, lambda c: F.last(c, ignorenulls=True))}, session, later)

    def made(window: Window) -> dict[str, Column]:
        return {name: F.last("_scan_held", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))}

    return _scanned(parts, by, order, made, ["_scan_held"], later)


def sums_at(probes: DataFrame, events: DataFrame, by: Sequence[str], on: str, at: str, sums: Mapping[str, Column], session: int = SESSION) -> DataFrame:
    """probes with sums over the events (time ``on``) at or before each probe's time ``at``; 0 where there is none."""
    values = events.select(*by, F.col(on).alias("_us"), F.lit(0).alias("_side"), *[v.alias(name) for name, v in sums.items()])
    asked = probes.select(*by, F.col(at).alias("_us"), F.lit(1).alias("_side"), F.struct(*probes.columns).alias("_probe"))
    both = values.unionByName(asked, allowMissingColumns=True)
    found = running(both, by, ["_us", "_side"], {name: F.col(name) for name in sums}, session=session).where("_side = 1")
    return found.select("_probe.*", *[F.coalesce(name, F.lit(0)).alias(name) for name in sums])


def interval_sums(left: DataFrame, right: DataFrame, by: Sequence[str], start: str, end: str, on: str, sums: Mapping[str, Column], session: int = SESSION) -> DataFrame:
    """left with sums over right rows with start < on <= end, as differences of two running sums.

    No pair of an interval and a row within it is made, so the work doesn't grow with how
    many rows an interval holds.  An interval that ends before it starts has 0.
    """
    first = {f"_a_{name}": value for name, value in sums.items()}
    last = {f"_b_{name}": value for name, value in sums.items()}
    out = sums_at(sums_at(left, right, by, on, start, first, session), right, by, on, end, last, session)
    some = F.col(end) > F.col(start)
    return out.select(*left.columns, *[F.when(some, F.col(f"_b_{name}") - F.col(f"_a_{name}")).otherwise(0).alias(name) for name in sums])
