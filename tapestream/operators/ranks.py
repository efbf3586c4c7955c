"""Rank statistics: buckets, correlations of ranks, summaries of daily values, false discovery."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairwise_valid(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are all finite."""
    for c in columns:
        x = F.col(c).cast("double")
        rows = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows


def every_nth(rows: DataFrame, by: Sequence[str], order: Sequence[str], stride: int, offset: int = 0) -> DataFrame:
    """Rows at places offset, offset + stride, ... counted over all rows, nulls included."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("_place", place).where(F.col("_place") % stride == offset).drop("_place")


def average_rank(value: str, by: Sequence[str]) -> Column:
    """Ranks from 1; equal values share the mean of theirs."""
    order = Window.partitionBy(*by).orderBy(value)
    upto = F.count("*").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # with its equals; one sort for both
    return (F.rank().over(order) + upto) / 2


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def pearson(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return pairwise_valid(rows, x, y).groupBy(*by).agg(F.count("*").alias("n"), correlation(F.col(x), F.col(y)).alias("ic"))


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str, tasks: int | None = None) -> DataFrame:
    """n and ic, the correlation of average ranks, of each group; groups are dealt to ``tasks``, if given."""
    valid = pairwise_valid(rows, x, y).select(*by, x, y)
    ranked = (valid.repartition(tasks, *by) if tasks else valid).withColumns({"_x": average_rank(x, by), "_y": average_rank(y, by)})
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation(F.col("_x"), F.col("_y")).alias("ic"))


def rank_residual(rows: DataFrame, by: Sequence[str], x: str, base: str) -> DataFrame:
    """rows with residual: x's rank less its regression on the base's rank."""
    ranked = pairwise_valid(rows, x, base).withColumns({"_x": average_rank(x, by), "_b": average_rank(base, by)})
    fit = ranked.groupBy(*by).agg(F.regr_slope("_x", "_b").alias("_slope"), F.regr_intercept("_x", "_b").alias("_level"))
    return ranked.join(fit, list(by)).withColumn("residual", F.col("_x") - F.col("_level") - F.col("_slope") * F.col("_b")).drop("_x", "_b", "_slope", "_level")


def equal_count_bucket(value: str, tie: str, by: Sequence[str], k: int = 10) -> Column:
    """1 to k by first rank: floor((rank - 1) * k / n) + 1, whose sizes differ from ntile's."""
    order = Window.partitionBy(*by).orderBy(value, tie)
    n = F.count("*").over(Window.partitionBy(*by))
    return (F.floor((F.row_number().over(order) - 1) * k / n) + 1).cast("long")


def bucket_means(rows: DataFrame, by: Sequence[str], x: str, y: str, tie: str, k: int = 10) -> DataFrame:
    """Count, mean and median of y for each of the k buckets of x, empty ones too."""
    bucketed = pairwise_valid(rows, x, y).withColumn("bucket", equal_count_bucket(x, tie, by, k))
    found = bucketed.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.median(y).alias("median"))
    every = found.select(*by).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))))
    return every.join(found, [*by, "bucket"], "left").fillna({"n": 0})


def top_minus_bottom(buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of the last less that of the first bucket that has rows."""
    some = buckets.where("n > 0").groupBy(*by)
    return some.agg((F.max_by("mean", "bucket") - F.min_by("mean", "bucket")).alias("effect"))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def daily_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, std (sample), min, max, t, and how many values are positive and negative."""
    v = F.col(value)
    out = rows.where(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"),
    )
    return out.withColumn("t", F.try_divide(F.col("mean"), F.nullif(F.col("std"), F.lit(0.0)) / F.sqrt("n")))


def benjamini_hochberg(rows: DataFrame, by: Sequence[str], p: str, tie: str) -> DataFrame:
    """rows with q: the running minimum from the largest p of p * m / rank, 1 at most; null p stay null."""
    valid = F.col(p).isNotNull() & ~F.isnan(p)
    ranked = rows.withColumn("_v", valid)
    order = Window.partitionBy(*by, "_v").orderBy(p, tie)
    m = F.count("*").over(Window.partitionBy(*by, "_v"))
    ranked = ranked.withColumn("_r", F.row_number().over(order)).withColumn("_s", F.col(p) * m / F.col("_r"))
    back = Window.partitionBy(*by, "_v").orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q", F.when(F.col("_v"), F.least(F.lit(1.0), F.min("_s").over(back)))).drop("_v", "_r", "_s")


def regression_metrics(rows: DataFrame, by: Sequence[str], y: str, pred: str) -> DataFrame:
    """n, mae, rmse, r2, sign accuracy on non-zero outcomes, and the correlation."""
    t, p = F.col(y), F.col(pred)
    return pairwise_valid(rows, y, pred).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(t - p)).alias("mae"), F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        (1 - F.try_divide(F.sum((t - p) * (t - p)), F.nullif(F.var_pop(t) * F.count("*"), F.lit(0.0)))).alias("r2"),
        F.avg(F.when(t != 0, (F.signum(t) == F.signum(p)).cast("double"))).alias("sign_accuracy"), correlation(t, p).alias("corr"),
    )


def in_parts(rows: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """rows with _part, which rises with the value; about as many rows in each, equal values in one."""
    shares = [F.lit(k / parts) for k in range(1, parts)]
    cuts = rows.agg(F.percentile_approx(value, F.array(*shares), F.lit(10_000)).alias("c")).first()["c"] or []  # parts - 1 numbers
    return rows.withColumn("_part", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c < F.col(value))))


def running_in_parts(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: str) -> DataFrame:
    """rows (with _part) with before: the sum of n over the group's rows that come earlier, parts first."""
    sums = rows.groupBy(*by, "_part").agg(F.sum(n).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"))  # a row per group and part
    within = F.sum(n).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    return rows.join(sums, [*by, "_part"]).withColumn("before", F.col("_ahead") + within).drop("_ahead", "_part")


def with_whole_bucket(rows: DataFrame, value: str, tie: str, k: int = 10) -> DataFrame:
    """rows with bucket, as ``equal_count_bucket`` over the whole table, which many tasks order."""
    placed = running_in_parts(in_parts(rows, value).withColumn("_one", F.lit(1)), [], [value, tie], "_one")
    n = rows.count()
    return placed.withColumn("bucket", (F.floor(F.col("before") * k / max(n, 1)) + 1).cast("long")).drop("_one", "before")


def auc(rows: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve from average ranks; null where a label is missing.

    Rows are counted for each score first; ranks are sums over scores, ordered in parts.
    """
    hit = F.count_if(F.col(label) == 1)
    scores = pairwise_valid(rows, label, score).groupBy(*by, score).agg(F.count("*").alias("_c"), hit.alias("_n1"), F.count_if(F.col(label) == 0).alias("_n0"))
    ranked = running_in_parts(in_parts(scores, score), by, [score], "_c")
    n1, n0 = F.sum("_n1"), F.sum("_n0")
    hits = F.sum(F.col("_n1") * (F.col("before") + (F.col("_c") + 1) / 2)) - n1 * (n1 + 1) / 2
    return ranked.groupBy(*by).agg(F.sum("_c").alias("n"), F.try_divide(hits, F.nullif(n1 * n0, F.lit(0)).cast("double")).alias("auc"))


def classification_losses(rows: DataFrame, by: Sequence[str], label: str, prob: str) -> DataFrame:
    p = F.greatest(F.least(F.col(prob), F.lit(1 - 1e-15)), F.lit(1e-15))
    y = F.col(label)
    return rows.groupBy(*by).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((y - F.col(prob)) * (y - F.col(prob))).alias("brier"), F.avg(y).alias("base_rate"))


def t_p(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) for whole degrees of freedom, by Student's finite series; all in the plan."""
    th = F.atan(F.try_divide(F.abs(t), F.sqrt(dof)))
    step = F.pow(F.cos(th), F.lit(2))
    odd = (dof % 2) == 1
    n = F.when(odd, F.floor((dof - 1) / 2)).otherwise(F.floor(dof / 2)).cast("int")

    def term(acc: Column, j: Column) -> Column:
        ratio = F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
        last = acc["last"] * ratio * step
        return F.struct(last.alias("last"), (acc["sum"] + last).alias("sum"))

    one = F.struct(F.lit(1.0).alias("last"), F.lit(1.0).alias("sum"))
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(steps, one, term)["sum"]
    inside = F.when(dof == 1, 2 / F.pi() * th).when(odd, 2 / F.pi() * (th + F.sin(th) * F.cos(th) * series)).otherwise(F.sin(th) * series)
    return F.when(dof >= 1, F.greatest(1 - inside, F.lit(0.0)))


def sign_p(positive: Column, negative: Column) -> Column:
    """Exact two-sided binomial p of the signs; null without any. Sums up to the smaller count, in the plan."""
    n, k = (positive + negative).cast("double"), F.least(positive, negative).cast("int")

    def term(acc: Column, i: Column) -> Column:
        last = acc["last"] * (n - i + 1) / i
        return F.struct(last.alias("last"), (acc["sum"] + last).alias("sum"))

    first = F.pow(F.lit(0.5), n)
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.struct(first.alias("last"), first.alias("sum")), term)["sum"]
    return F.when(n > 0, F.least(F.lit(1.0), 2 * total))


def delta_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, std, t (infinite or 0 where all are equal) and sign_p of each group's differences."""
    out = daily_summary(rows, by, value)
    t = F.when(F.col("std") > 0, F.col("t")).when(F.col("mean") > 0, float("inf")).when(F.col("mean") < 0, float("-inf")).otherwise(0.0)
    return out.select(*by, "n", "mean", "std", t.alias("t"), sign_p(F.col("positive"), F.col("negative")).alias("sign_p"))


def primary_tests(daily: DataFrame, by: Sequence[str], value: str = "ic") -> DataFrame:
    """A row per test of daily values (n, value): days, pairs, mean, std, t, p, and q over all tests."""
    pairs = daily.groupBy(*by).agg(F.sum("n").alias("pairs"))
    out = daily_summary(daily, by, value).withColumnRenamed("n", "days").join(pairs, list(by))
    tested = out.withColumn("p", t_p(F.col("t"), F.col("days") - 1)).withColumn("_family", F.lit(1))  # a row per test
    tested = tested.withColumn("_tie", F.struct(*by))
    return benjamini_hochberg(tested, ["_family"], "p", "_tie").drop("_family", "_tie")


def absolute_differences(rows: DataFrame, a: str, b: str) -> DataFrame:
    d = F.abs(F.col(a) - F.col(b))
    some = rows.where(d.isNotNull())
    return some.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.percentile(d, F.lit(0.95)).alias("p95"), F.max(d).alias("most"))


def evenly_spaced(rows: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The rows at places round(i * (n - 1) / (k - 1)) of each group, each once."""
    n = F.count("*").over(Window.partitionBy(*by))
    placed = rows.withColumns({"_i": F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1, "_n": n})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / F.lit(float(max(k - 1, 1))) + 0.5))
    return placed.where(F.array_contains(wanted, F.col("_i").cast("long"))).drop("_i", "_n")


def t_two_sided(t: float, dof: int) -> float:
    """P(|T| >= |t|) by the continued fraction of the incomplete beta function."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # modified Lentz
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + n * d
            c = 1 + n / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def sign_test(positive: int, negative: int) -> float:
    """Exact two-sided binomial p of the signs."""
    n, k = positive + negative, min(positive, negative)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else float("nan")
