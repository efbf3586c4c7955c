"""Exact quantiles by distributed selection.

The built-in exact percentile keeps all distinct values of a group in one task.  Here each
group's values are counted in ``RANGES`` equal ranges between its least and its largest
(of their logarithms, so that a few huge values don't leave all others in one range), which
combines before the shuffle; only the range that holds a wanted rank is cut again, and what
is left after ``ROUNDS`` cuts is ordered, a row for each distinct value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES, ROUNDS = 4096, 3


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out &= F.col(a).eqNullSafe(F.col(b))
    return out


def _scale(v: Column) -> Column:
    """Rises with v."""
    return F.signum(v) * F.log1p(F.abs(v))


def _range(v: Column, low: Column, high: Column) -> Column:
    share = F.try_divide(_scale(v) - _scale(low), _scale(high) - _scale(low))
    return F.coalesce(F.least(F.floor(share * RANGES), F.lit(RANGES - 1)), F.lit(0))


def _chosen(counted: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Of each key's counts (c, in order) the one that holds the place ``rank``, which becomes the place within it."""
    upto = F.sum("c").over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = counted.withColumn("_from", upto - F.col("c")).where((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_from") + F.col("c")))
    return rows.withColumn("rank", F.col("rank") - F.col("_from")).drop("_from")


def quantiles(rows: DataFrame, by: Sequence[str], values: Mapping[str, Column], wanted: Mapping[str, Sequence[float]], rounds: int = ROUNDS) -> DataFrame:
    """by, and for each name of ``values`` the quantiles ``wanted[name]``, interpolated, as an array.

    Nulls and NaN are left out; a group without a value has null.
    """
    keys = [*[f"_g{i}" for i in range(len(by))], "name"]
    others = [f"_o{i}" for i in range(len(keys))]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), v.cast("double").alias("v")) for name, v in values.items()]))
    flat = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], each.alias("_x")).select(*keys[:-1], "_x.name", F.col("_x.v").alias("v"))
    flat = flat.where(F.col("v").isNotNull() & ~F.isnan("v"))

    ends = flat.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    shares = F.lit(None).cast("array<double>")
    for name, ps in wanted.items():
        shares = F.when(F.col("name") == name, F.array(*[F.lit(float(p)) for p in ps])).otherwise(shares)
    at = F.col("q") * (F.col("n") - 1)
    asked = ends.select(*keys, "n", "low", "high", F.posexplode(shares).alias("k", "q")).withColumn("at", at - F.floor(at))
    asked = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(F.col("q") * (F.col("n") - 1)), F.ceil(F.col("q") * (F.col("n") - 1)))))).withColumn("_first", F.col("rank"))
    state = asked.select(*[F.col(a).alias(b) for a, b in zip(keys, others)], "k", "at", "_first", "rank", "low", "high")

    span = ends.select(*[F.col(a).alias(b) for a, b in zip(keys, others)], "low", "high")
    first = flat.join(span, _same(keys, others)).groupBy(*keys, _range(F.col("v"), F.col("low"), F.col("high")).alias("d"))
    first = first.agg(F.count("*").alias("c"), F.min("v").alias("_low"), F.max("v").alias("_high"))  # RANGES rows a group at most
    place = [*others, "k", "at", "_first"]
    counted = first.join(state.drop("low", "high"), _same(keys, others)).select(*place, "rank", "d", "c", "_low", "_high")
    state = _chosen(counted, place, "d").select(*place, "rank", F.col("_low").alias("low"), F.col("_high").alias("high"))
    for _ in range(rounds - 1):
        within = flat.join(state, _same(keys, others) & F.col("v").between(F.col("low"), F.col("high")))
        counted = within.groupBy(*place, "rank", _range(F.col("v"), F.col("low"), F.col("high")).alias("d")).agg(F.count("*").alias("c"), F.min("v").alias("_low"), F.max("v").alias("_high"))
        state = _chosen(counted, place, "d").select(*place, "rank", F.col("_low").alias("low"), F.col("_high").alias("high"))
    within = flat.join(state, _same(keys, others) & F.col("v").between(F.col("low"), F.col("high")))
    found = _chosen(within.groupBy(*place, "rank", "v").agg(F.count("*").alias("c")), place, "v")

    low, high = F.min_by("v", "_first"), F.max_by("v", "_first")
    found = found.groupBy(*others, "k", "at").agg((low + (high - low) * F.col("at")).alias("x"))
    lists = found.groupBy(*others).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s.x).alias("xs"))  # as many as are wanted
    wide = lists.groupBy(*others[:-1]).pivot(others[-1], list(values)).agg(F.first("xs"))
    return rows.select(*by).distinct().join(wide, _same(by, others[:-1]), "left").select(*by, *values)


def with_quantiles(aggregated: DataFrame, rows: DataFrame, by: Sequence[str], values: Mapping[str, Column], wanted: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """aggregated (a row per group) with the quantiles ``wanted[value][new name]``."""
    found = quantiles(rows, by, values, {v: list(ps.values()) for v, ps in wanted.items()})
    keys = [f"_k{i}" for i in range(len(by))]
    columns = [F.get(v, F.lit(i)).alias(name) for v, ps in wanted.items() for i, name in enumerate(ps)]
    found = found.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], *columns)
    return aggregated.join(found, _same(by, keys), "left").drop(*keys)
