"""Queries of statistics, models and signals over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestream.bridge import PREDS, preds, table
from tapestream.functions import market
from tapestream.operators import models, ranks, selection, signals
from tapestream.plans.registry import query

DAY = ["day"]


def _round(rows: DataFrame, keys: list[str], places: int = 6) -> DataFrame:
    """Doubles rounded, counts as long."""
    return rows.select(*keys, *[F.round(c, places).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in rows.dtypes if c not in keys])


VALID = "valid AS (SELECT * FROM preds WHERE x IS NOT NULL AND y IS NOT NULL)"
RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY x) + (count(*) OVER (PARTITION BY day, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY day ORDER BY y) + (count(*) OVER (PARTITION BY day, y) - 1) / 2.0 AS ry FROM valid)"""
CORR = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"
DAILY = f"{VALID}, {RANKED}, daily AS (SELECT day, count(*) AS n, {CORR.format('CAST(rx AS DOUBLE)', 'CAST(ry AS DOUBLE)')} AS ic FROM ranked GROUP BY day)"


@query("a09_spearman", f"WITH {PREDS}, {DAILY} SELECT day, CAST(n AS BIGINT) AS n, round(ic, 6) AS ic FROM daily")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ranks.spearman(preds(spark, sf_dir), DAY, "x", "y"), DAY)


@query("a10_pearson", f"WITH {PREDS}, {VALID} SELECT day, CAST(count(*) AS BIGINT) AS n, round({CORR.format('x', 'y')}, 6) AS ic FROM valid GROUP BY day")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ranks.pearson(preds(spark, sf_dir), DAY, "x", "y"), DAY)


@query("a12_nonoverlap", f"""WITH {PREDS.replace('preds AS', 'every AS')}, preds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY us, "row") - 1 AS k FROM every) WHERE k % 5 = 0),
  {DAILY} SELECT day, CAST(n AS BIGINT) AS n, round(ic, 6) AS ic FROM daily""")
def nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ranks.every_nth(preds(spark, sf_dir), DAY, ["us", "row"], 5)
    return _round(ranks.spearman(kept, DAY, "x", "y"), DAY)


@query("a44_lag_control", f"""WITH {PREDS.replace('preds AS', 'every AS')}, preds AS (SELECT * REPLACE (lag(x, 20) OVER (PARTITION BY day ORDER BY us, "row") AS x) FROM every),
  {DAILY} SELECT day, CAST(n AS BIGINT) AS n, round(ic, 6) AS ic FROM daily""")
def lag_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    late = preds(spark, sf_dir).withColumn("x", F.lag("x", 20).over(Window.partitionBy("day").orderBy("us", "row")))
    return _round(ranks.spearman(late, DAY, "x", "y"), DAY)


@query("a39_residual", f"""WITH {PREDS}, {VALID}, {RANKED}, f AS (SELECT day, regr_slope(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) AS s, regr_intercept(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) AS i FROM ranked GROUP BY day)
  SELECT "row", round(rx - i - s * ry, 5) AS residual FROM ranked JOIN f USING (day)""")
def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.rank_residual(preds(spark, sf_dir), DAY, "x", "y").select("row", F.round("residual", 5).alias("residual"))


@query("a08_daily_summary", f"""WITH {PREDS}, {DAILY} SELECT 'ic' AS metric, CAST(count(*) AS BIGINT) AS n, round(avg(ic), 6) AS mean, round(median(ic), 6) AS median, round(stddev_samp(ic), 6) AS std,
  round(min(ic), 6) AS low, round(max(ic), 6) AS high, CAST(count(*) FILTER (WHERE ic > 0) AS BIGINT) AS positive, CAST(count(*) FILTER (WHERE ic < 0) AS BIGINT) AS negative,
  round(avg(ic) / (nullif(stddev_samp(ic), 0) / sqrt(count(*))), 6) AS t FROM daily WHERE ic IS NOT NULL""")
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = ranks.spearman(preds(spark, sf_dir), DAY, "x", "y").withColumn("metric", F.lit("ic"))
    return _round(ranks.daily_summary(daily, ["metric"], "ic"), ["metric"])


@query("w11_benjamini_hochberg", f"""WITH {PREDS}, p AS (SELECT day, CAST((day * 37 % 101) AS DOUBLE) / 500 AS p FROM (SELECT DISTINCT day FROM preds)),
  r AS (SELECT *, row_number() OVER (ORDER BY p, day) AS k, count(*) OVER () AS m FROM p)
  SELECT day, p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC)), 8) AS q FROM r""")
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preds(spark, sf_dir).select("day").distinct().select("day", ((F.col("day") * 37 % 101).cast("double") / 500).alias("p"), F.lit(1).alias("family"))
    return ranks.benjamini_hochberg(p, ["family"], "p", "day").select("day", "p", F.round("q", 8).alias("q"))


BUCKETED = f"""{VALID}, b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY day ORDER BY x, "row") - 1) * 10 / count(*) OVER (PARTITION BY day)) AS BIGINT) + 1 AS bucket FROM valid)"""


@query("a02_bucket_means", f"""WITH {PREDS}, {BUCKETED}, k AS (SELECT day, unnest(range(1, 11)) AS bucket FROM (SELECT DISTINCT day FROM b))
  SELECT k.day, k.bucket, CAST(count(y) AS BIGINT) AS n, round(avg(y), 6) AS mean, round(median(y), 6) AS median FROM k LEFT JOIN b ON b.day = k.day AND b.bucket = k.bucket GROUP BY k.day, k.bucket""")
def bucket_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ranks.bucket_means(preds(spark, sf_dir), DAY, "x", "y", "row"), ["day", "bucket"])


@query("a03_top_bottom", f"""WITH {PREDS}, {BUCKETED}, m AS (SELECT day, bucket, avg(y) AS mean FROM b GROUP BY day, bucket)
  SELECT day, round(max_by(mean, bucket) - min_by(mean, bucket), 6) AS effect FROM m GROUP BY day""")
def top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ranks.bucket_means(preds(spark, sf_dir), DAY, "x", "y", "row")
    return _round(ranks.top_minus_bottom(means, DAY), DAY)


@query("a05_next_move", f"""WITH {PREDS}, {BUCKETED} SELECT bucket, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN y > x THEN 1.0 ELSE 0.0 END), 6) AS p_up, round(avg(CASE WHEN y < x THEN 1.0 ELSE 0.0 END), 6) AS p_down,
  round(avg(CASE WHEN y > x THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN y < x THEN 1.0 ELSE 0.0 END), 6) AS difference FROM b GROUP BY bucket""")
def next_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.pairwise_valid(preds(spark, sf_dir), "x", "y").withColumn("bucket", ranks.equal_count_bucket("x", "row", DAY))
    up, down = ranks.share(F.col("y") > F.col("x")), ranks.share(F.col("y") < F.col("x"))
    return _round(rows.groupBy("bucket").agg(F.count("*").alias("n"), up.alias("p_up"), down.alias("p_down"), (up - down).alias("difference")), ["bucket"])


@query("a06_direction", f"""WITH {PREDS}, {BUCKETED}, d AS (SELECT bucket, CASE WHEN r > 0.3 THEN 'UP' WHEN r < -0.3 THEN 'DOWN' WHEN r IS NOT NULL THEN 'FLAT' END AS dir FROM (SELECT bucket, CASE WHEN x > 0 AND y > 0 THEN ln(y / x) END AS r FROM b))
  SELECT bucket, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN dir = 'UP' THEN 1.0 ELSE 0.0 END), 6) AS up, round(avg(CASE WHEN dir = 'FLAT' THEN 1.0 ELSE 0.0 END), 6) AS flat,
  round(avg(CASE WHEN dir = 'DOWN' THEN 1.0 ELSE 0.0 END), 6) AS down FROM d GROUP BY bucket""")
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.pairwise_valid(preds(spark, sf_dir), "x", "y").withColumn("bucket", ranks.equal_count_bucket("x", "row", DAY))
    rows = rows.withColumn("d", market.direction(market.log_return(F.col("y"), F.col("x")), 3000))
    return _round(rows.groupBy("bucket").agg(F.count("*").alias("n"), *[ranks.share(F.coalesce(F.col("d") == k.upper(), F.lit(False))).alias(k) for k in ("up", "flat", "down")]), ["bucket"])


@query("a07_equal_day", f"""WITH {PREDS}, {BUCKETED}, m AS (SELECT day, bucket, count(*) AS n, avg(y) AS mean FROM b GROUP BY day, bucket)
  SELECT bucket, round(avg(mean), 6) AS equal_day, round(sum(mean * n) / sum(n), 6) AS weighted FROM m GROUP BY bucket""")
def equal_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ranks.bucket_means(preds(spark, sf_dir), DAY, "x", "y", "row").where("n > 0")
    return _round(means.groupBy("bucket").agg(F.avg("mean").alias("equal_day"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("weighted")), ["bucket"])


@query("a15_regression", f"""WITH {PREDS}, {VALID} SELECT day, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse,
  round(1 - sum((y - x) * (y - x)) / nullif(var_pop(y) * count(*), 0), 6) AS r2, round(avg(CASE WHEN y <> 0 THEN CASE WHEN sign(y) = sign(x) THEN 1.0 ELSE 0.0 END END), 6) AS sign_accuracy,
  round({CORR.format('x', 'y')}, 6) AS corr FROM valid GROUP BY day""")
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ranks.regression_metrics(preds(spark, sf_dir), DAY, "y", "x"), DAY)


@query("m03_ols", f"""WITH {PREDS}, {VALID} SELECT day, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, CAST(count(*) AS BIGINT) AS n FROM valid GROUP BY day""")
def ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(models.ols_one(ranks.pairwise_valid(preds(spark, sf_dir), "x", "y"), DAY, "x", "y"), DAY)


@query("m04_ridge", f"""WITH {PREDS}, {VALID}, w AS (SELECT covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1000000) AS w, avg(x) AS ax, avg(y) AS ay FROM valid)
  SELECT "row", round(w * x + ay - w * ax, 6) AS prediction FROM preds, w WHERE x IS NOT NULL""")
def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preds(spark, sf_dir)
    w, b = models.ridge(rows, ["x"], "y", 1_000_000.0)
    return rows.where("x is not null").select("row", F.round(models.linear_prediction(["x"], w, b), 6).alias("prediction"))


SCORED = "scored AS (SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS score, CAST(l.quality AS BIGINT) AS label, 1.0 / (1.0 + exp(-(d.n_chars - 1500) / 1000.0)) AS prob, d.source FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), table(spark, sf_dir, "labels")
    prob = 1.0 / (1.0 + F.exp(-(F.col("n_chars") - 1500) / 1000.0))
    return docs.join(labels, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), F.col("quality").cast("long").alias("label"), prob.alias("prob"), F.lit("all").alias("part"))


@query("a16_auc", f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored)
  SELECT 'all' AS part, CAST(count(*) AS BIGINT) AS n, round((CAST(sum(CASE WHEN label = 1 THEN r END) AS DOUBLE) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ranks.auc(_scored(spark, sf_dir), ["part"], "label", "score"), ["part"])


@query("a16_losses", f"""WITH {SCORED} SELECT 'all' AS part, round(avg(-(label * ln(greatest(least(prob, 1 - 1e-15), 1e-15)) + (1 - label) * ln(1 - greatest(least(prob, 1 - 1e-15), 1e-15)))), 6) AS log_loss,
  round(avg((label - prob) * (label - prob)), 6) AS brier, round(avg(label), 6) AS base_rate FROM scored""")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ranks.classification_losses(_scored(spark, sf_dir), ["part"], "label", "prob"), ["part"])


@query("a40_calibration", f"""WITH {SCORED}, b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY prob, doc_id) - 1) * 10 / count(*) OVER ()) AS BIGINT) + 1 AS bucket FROM scored)
  SELECT bucket, CAST(count(*) AS BIGINT) AS n, round(avg(prob), 6) AS predicted, round(avg(label), 6) AS observed FROM b GROUP BY bucket""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.with_whole_bucket(_scored(spark, sf_dir), "prob", "doc_id")
    return _round(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("prob").alias("predicted"), F.avg("label").alias("observed")), ["bucket"])


@query("a36_profile", """SELECT event_type AS inst, CAST(count(value) AS BIGINT) AS n, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, round(min(value), 6) AS low,
  round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "inst")
    sums = rows.groupBy("inst").agg(
        F.count("value").alias("n"), ranks.share(F.col("value").isNull()).alias("missing"), F.min("value").alias("low"),
        F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    )
    return _round(selection.with_quantiles(sums, rows, ["inst"], {"value": F.col("value")}, {"value": levels}), ["inst"])


# --- signals

BOUNDS = """q AS (SELECT quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.1) AS q10, quantile_cont(x, 0.9) AS q90, quantile_cont(x, 0.95) AS q95 FROM preds)"""
SIGNAL = f"""{BOUNDS}, sig AS (SELECT p.*, CASE WHEN x >= q90 THEN 1 WHEN x <= q10 THEN -1 ELSE 0 END AS signal FROM preds p, q)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preds(spark, sf_dir).withColumn("fold", F.lit(1))
    return signals.with_signal(rows, signals.thresholds(rows, ["fold"], "x"), ["fold"], "x")


@query("w20_thresholds", f"WITH {PREDS}, {BOUNDS} SELECT round(q05, 6) AS q05, round(q10, 6) AS q10, round(q90, 6) AS q90, round(q95, 6) AS q95 FROM q")
def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(signals.thresholds(preds(spark, sf_dir).withColumn("fold", F.lit(1)), ["fold"], "x").drop("fold"), [])


@query("h19_signal", f'WITH {PREDS}, {SIGNAL} SELECT "row", CAST(signal AS BIGINT) AS signal FROM sig')
def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("row", F.col("signal").cast("long").alias("signal"))


@query("h20_risk_rules", f"""WITH {PREDS}, {SIGNAL}, e AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY us, "row") AS a, row_number() OVER (PARTITION BY day ORDER BY us DESC, "row" DESC) AS z FROM sig)
  SELECT "row", CAST(CASE WHEN y IS NULL OR x > 400 THEN 0 WHEN a = 1 OR z = 1 THEN 0 ELSE signal END AS BIGINT) AS final_signal FROM e""")
def risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = signals.final_signal(F.col("signal"), F.col("y").isNotNull(), F.col("x") > 400, DAY, ["us", "row"])
    return _signals(spark, sf_dir).select("row", final.cast("long").alias("final_signal"))


@query("w08_transitions", f"""WITH {PREDS}, {SIGNAL}, t AS (SELECT * FROM (SELECT *, lag(signal, 1, 0) OVER (PARTITION BY day ORDER BY us, "row") AS p FROM sig) WHERE signal <> p)
  SELECT "row", CAST(signal - p AS BIGINT) AS delta, lead(us) OVER (PARTITION BY day ORDER BY us, "row") AS next_at FROM t""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.transitions(_signals(spark, sf_dir), DAY, ["us", "row"], "us", "signal").select("row", F.col("delta").cast("long").alias("delta"), "next_at")


@query("w09_transition_counts", f"""WITH {PREDS}, {SIGNAL}, b AS (SELECT *, lag(signal) OVER (PARTITION BY day ORDER BY us, "row") AS p FROM sig)
  SELECT day, CAST(count(*) FILTER (WHERE p = 0 AND signal = 1) AS BIGINT) AS flat_to_long, CAST(count(*) FILTER (WHERE p = 1 AND signal = -1) AS BIGINT) AS long_to_short,
  round(CAST(count(*) FILTER (WHERE p <> signal) AS DOUBLE) / nullif(count(p), 0), 6) AS rate FROM b GROUP BY day""")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(signals.transition_counts(_signals(spark, sf_dir), DAY, ["us", "row"], "signal").select("day", "flat_to_long", "long_to_short", "rate"), DAY)


@query("w10_runs", f"""WITH {PREDS}, {SIGNAL}, c AS (SELECT *, CASE WHEN lag(signal) OVER (PARTITION BY day ORDER BY us, "row") = signal THEN 0 ELSE 1 END AS s FROM sig),
  g AS (SELECT *, sum(s) OVER (PARTITION BY day ORDER BY us, "row") AS run FROM c), r AS (SELECT day, run, any_value(signal) AS signal, count(*) AS length FROM g GROUP BY day, run)
  SELECT day, CAST(signal AS BIGINT) AS signal, CAST(count(*) AS BIGINT) AS runs, round(avg(length), 6) AS mean, round(median(length), 6) AS median, round(quantile_cont(length, 0.95), 6) AS p95, CAST(max(length) AS BIGINT) AS longest
  FROM r GROUP BY day, signal""")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = signals.runs(_signals(spark, sf_dir), DAY, ["us", "row"], "signal")
    return _round(signals.run_summary(lengths, DAY, "signal").withColumn("signal", F.col("signal").cast("long")), ["day", "signal"])


@query("a21_returns_by_signal", f"""WITH {PREDS}, {SIGNAL}, g AS (SELECT CAST(signal AS VARCHAR) AS signal, count(y) AS n, avg(y - x) AS mean FROM sig GROUP BY signal)
  SELECT signal, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean FROM g UNION ALL
  SELECT 'long_minus_short', CAST(sum(n) AS BIGINT), round(sum(CASE WHEN signal = '1' THEN mean ELSE -mean END), 6) FROM g WHERE signal IN ('1', '-1')""")
def returns_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _signals(spark, sf_dir).groupBy(F.col("signal").cast("string").alias("signal")).agg(F.count("y").alias("n"), F.avg(F.col("y") - F.col("x")).alias("mean"))
    ends = by.where("signal in ('1', '-1')")
    both = ends.agg(F.lit("long_minus_short").alias("signal"), F.sum("n").alias("n"), F.sum(F.when(F.col("signal") == "1", F.col("mean")).otherwise(-F.col("mean"))).alias("mean"))
    return _round(by.unionByName(both), ["signal"])


@query("a22_disagreement", f"""WITH {PREDS}, {SIGNAL}, b AS (SELECT s.*, CASE WHEN x >= q95 THEN 1 WHEN x <= q05 THEN -1 ELSE 0 END AS other FROM sig s, q)
  SELECT CAST(signal AS BIGINT) AS a, CAST(other AS BIGINT) AS b, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1, 2""")
def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir).withColumn("other", market.raw_signal(F.col("x"), F.col("q05"), F.col("q95")))
    return rows.groupBy(F.col("signal").cast("long").alias("a"), F.col("other").cast("long").alias("b")).agg(F.count("*").alias("n"))


# --- keyed permutations and samples

# x dealt anew within the day by a keyed hash, as a table preds of its own
DEALT = """raw AS (SELECT * FROM all_preds WHERE y IS NOT NULL), a_{0} AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY us, "row") AS k FROM raw),
  b_{0} AS (SELECT day, {1} AS v, row_number() OVER (PARTITION BY day ORDER BY sha256(concat_ws('|', '{0}', us, "row")), us, "row") AS k FROM raw)"""
ALL_PREDS = PREDS.replace("preds AS", "all_preds AS", 1)


@query("t10_permutation", f"""WITH {ALL_PREDS}, {DEALT.format('control', 'x')}, preds AS (SELECT a.day, a."row", a.us, a.user_id, b.v AS x, a.y FROM a_control a JOIN b_control b ON a.day = b.day AND a.k = b.k), {DAILY} SELECT day, CAST(n AS BIGINT) AS n, round(ic, 6) AS ic FROM daily""")
def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rank correlations of values dealt anew within the day; near 0."""
    dealt = models.permuted(preds(spark, sf_dir).where("y is not null"), DAY, "control", ["us", "row"], "x")
    return _round(ranks.spearman(dealt, DAY, "x", "y"), DAY)


@query("t09_sample", f"""WITH {PREDS} SELECT "row", x FROM preds ORDER BY sha256(concat_ws('|', 'sample', "row")), "row" LIMIT 200""")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed sample without replacement."""
    return models.keyed_sample(preds(spark, sf_dir), "sample", ["row"], 200).select("row", "x")


# --- without a twin


@query("m05_boosted_trees")
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of trees fitted on the first 20 days, for the days after."""
    rows = preds(spark, sf_dir).withColumn("hour", (F.col("us") / 3_600_000_000 % 24).cast("double")).dropna(subset=["x", "y"])
    days = [r.day for r in rows.select("day").distinct().orderBy("day").collect()]
    train, later = rows.where(F.col("day") < days[min(20, len(days) - 1)]), rows.where(F.col("day") >= days[min(20, len(days) - 1)])
    assembler, model = models.boosted_trees(train, ["x", "hour"], "y")
    return model.transform(assembler.transform(later)).select("row", "prediction")
