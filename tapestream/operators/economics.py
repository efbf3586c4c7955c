"""Fees, stress and comparisons of scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_grid(rows: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Each row once for each value of a short list."""
    return rows.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def net_of_fee(gross: Column, turnover: Column, fee_bps: Column) -> Column:
    return gross - turnover * fee_bps / 10_000


def model_difference(rows: DataFrame, keys: Sequence[str], model: str, a: object, b: object, value: str) -> DataFrame:
    """a's value less b's for each key that has both."""
    wide = rows.groupBy(*keys).pivot(model, [a, b]).agg(F.first(value))
    return wide.select(*keys, (F.col(str(a)) - F.col(str(b))).alias("delta")).where("delta is not null")


def against_baseline(rows: DataFrame, by: Sequence[str], knob: str, base: object, value: str) -> DataFrame:
    """rows with the value at knob == base, and the difference to it."""
    baseline = F.max(F.when(F.col(knob) == F.lit(base), F.col(value))).over(Window.partitionBy(*by))
    return rows.withColumn("baseline", baseline).withColumn("delta", F.col(value) - F.col("baseline"))


def rank_wins(rows: DataFrame, context: Sequence[str], who: str, value: str) -> DataFrame:
    """How often each is best; ties share a win."""
    best = F.max(value).over(Window.partitionBy(*context))
    winners = rows.withColumn("_best", best).where(F.col(value) == F.col("_best"))
    part = 1 / F.count("*").over(Window.partitionBy(*context))
    return winners.withColumn("_part", part).groupBy(who).agg(F.sum("_part").alias("wins"))


def survival(rows: DataFrame, keys: Sequence[str], fee: str, levels: Sequence[float], net: str) -> DataFrame:
    """Whether net is positive at each fee level, as columns ``fee_0_25`` and so on."""
    picks = [F.max(F.when(F.col(fee) == float(x), (F.col(net) > 0).cast("int"))).alias("fee_" + f"{x:.2f}".replace(".", "_")) for x in levels]
    return rows.groupBy(*keys).agg(*picks)


def role_turnover(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Turnover and fees of makers and takers; unknown counts rows of any other role."""
    n = F.abs(F.col("signed") * F.col("price"))
    role = F.lower("role")
    sums = [F.sum(F.when(role == r, v).otherwise(0.0)).alias(f"{r}_{name}") for r in ("maker", "taker") for name, v in (("turnover", n), ("fees", F.col("fee")))]
    return rows.groupBy(*by).agg(*sums, F.count_if(F.coalesce(~role.isin("maker", "taker"), F.lit(True))).alias("unknown"))


def interpolated_breakeven(rows: DataFrame, by: Sequence[str], fee: str, net: str) -> DataFrame:
    """The fee where net is zero: a level of the grid, or where it crosses between two."""
    w = Window.partitionBy(*by).orderBy(fee)
    nxt, nxt_fee = F.lead(net).over(w), F.lead(fee).over(w)
    cross = F.when(F.col(net) == 0, F.col(fee)).when((F.col(net) > 0) & (nxt < 0), F.col(fee) + F.col(net) / (F.col(net) - nxt) * (nxt_fee - F.col(fee)))
    return rows.withColumn("_x", cross).groupBy(*by).agg(F.min("_x").alias("breakeven"))


def long_report(rows: DataFrame, keys: Sequence[str], reports: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """A row (keys, report, metric, value) for each metric of each report."""
    cells = [F.struct(F.lit(r).alias("report"), F.lit(m).alias("metric"), v.cast("double").alias("value")) for r, metrics in reports.items() for m, v in metrics.items()]
    return rows.select(*keys, F.inline(F.array(*cells)))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, absolute: float = 1e-8, relative: float = 1e-11) -> DataFrame:
    """How many keys both sides have, and for how many the values are further apart than the tolerance."""
    both = left.join(right.withColumnRenamed(value, "_other"), list(keys))
    apart = F.abs(F.col(value) - F.col("_other")) > F.greatest(F.lit(absolute), F.abs("_other") * relative)
    return both.agg(F.count("*").alias("pairs"), F.count_if(apart).alias("apart"))


def terminal_stress(rows: DataFrame, shocks_bps: Sequence[float]) -> DataFrame:
    """rows (position, mid, net) with stressed net for each shock of the final mark."""
    return with_grid(rows, "shock_bps", shocks_bps).withColumn("stressed", F.col("net") + F.col("position") * F.col("mid") * F.col("shock_bps") / 10_000)
