"""From predictions to positions: thresholds, risk rules, transitions and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapestream.functions.market import raw_signal
from tapestream.operators import selection


def thresholds(train: DataFrame, by: Sequence[str], pred: str) -> DataFrame:
    """q05, q10, q90 and q95 of the training predictions."""
    found = selection.quantiles(train, by, {"_q": F.col(pred)}, {"_q": (0.05, 0.1, 0.9, 0.95)})
    return found.select(*by, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("q05", "q10", "q90", "q95"))])


def final_signal(signal: Column, valid: Column, stale: Column, session: Sequence[str], order: Sequence[str]) -> Column:
    """0 for rows that are invalid or stale and at both ends of a session, in that order of priority."""
    ahead, behind = Window.partitionBy(*session).orderBy(*order), Window.partitionBy(*session).orderBy(*[F.col(c).desc() for c in order])
    ends = (F.row_number().over(ahead) == 1) | (F.row_number().over(behind) == 1)
    return F.when(~valid | stale, 0).when(ends, 0).otherwise(signal)


def transitions(rows: DataFrame, by: Sequence[str], order: Sequence[str], on: str, signal: str) -> DataFrame:
    """Rows where the signal differs from the one before (0 at first), with delta and the next transition's time."""
    w = Window.partitionBy(*by).orderBy(*order)
    moved = rows.withColumn("previous", F.lag(signal, 1, 0).over(w)).where(F.col(signal) != F.col("previous"))
    return moved.withColumns({"delta": F.col(signal) - F.col("previous"), "next_at": F.lead(on).over(w)})


def transition_counts(rows: DataFrame, by: Sequence[str], order: Sequence[str], signal: str) -> DataFrame:
    """How often each of the six changes of position happens, and their rate per step."""
    before = F.lag(signal).over(Window.partitionBy(*by).orderBy(*order))
    steps = rows.withColumn("_b", before)
    names = {-1: "short", 0: "flat", 1: "long"}
    counts = [F.count_if((F.col("_b") == a) & (F.col(signal) == b)).alias(f"{names[a]}_to_{names[b]}") for a in names for b in names if a != b]
    changed = F.count_if(F.col("_b") != F.col(signal))
    return steps.groupBy(*by).agg(*counts, F.try_divide(changed, F.nullif(F.count("_b"), F.lit(0))).alias("rate"))


def runs(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """A row per run of equal values: value and length."""
    w = Window.partitionBy(*by).orderBy(*order)
    start = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    islands = rows.withColumn("_s", start).withColumn("_run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_run").agg(F.first(value).alias(value), F.count("*").alias("length")).drop("_run")


def run_summary(lengths: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    x = F.col("length")
    return lengths.groupBy(*by, value).agg(F.count("*").alias("runs"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.percentile(x, F.lit(0.95)).alias("p95"), F.max(x).alias("longest"))


def with_signal(rows: DataFrame, bounds: DataFrame, by: Sequence[str], pred: str, low: str = "q10", high: str = "q90") -> DataFrame:
    return rows.join(bounds, list(by)).withColumn("signal", raw_signal(F.col(pred), F.col(low), F.col(high)))
