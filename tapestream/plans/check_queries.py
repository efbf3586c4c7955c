"""Checks, features, selections and models beyond the daily statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapestream.bridge import BOOK, FILLS, GRID, HOUR, PREDS, QUOTES, TICKS, book_updates, dealt, fills, grid, preds, quotes, table, tasks, ticks
from tapestream.functions import market
from tapestream.operators import asof, book, models, quality, ranks
from tapestream.plans.registry import query
from tapestream.plans.research_queries import ALL_PREDS, BOUNDS, CORR, DAILY, DAY, DEALT, SIGNAL, VALID, _round, _signals
from tapestream.plans.time_queries import BOOK_KEYS, FINAL, LABELS, _labels
from tapestream.sources.scratch import new_folder

EARLIEST, LATEST = 1_704_200_000_000_000, 1_706_000_000_000_000


@query("p08_timestamp_rules", f"""WITH {TICKS}, s AS (SELECT "row", us, CASE WHEN "row" % 11 = 0 THEN NULL WHEN "row" % 13 = 0 THEN 'soon' WHEN "row" % 17 = 0 THEN 'naive' ELSE 'zoned' END AS k FROM ticks)
  SELECT rule, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN k IS NULL THEN 'missing_timestamp' WHEN k = 'soon' THEN 'unparseable_timestamp' WHEN k = 'naive' THEN 'naive_timestamp'
  WHEN us // 1000000 * 1000000 < {EARLIEST} OR us // 1000000 * 1000000 > {LATEST} THEN 'timestamp_out_of_range' END AS rule FROM s) WHERE rule IS NOT NULL GROUP BY rule""")
def timestamp_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_format(F.timestamp_seconds(F.floor(F.col("us") / 1_000_000)), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("row") % 11 == 0, None).when(F.col("row") % 13 == 0, "soon").when(F.col("row") % 17 == 0, at).otherwise(F.concat(at, F.lit("Z")))
    rules = quality.timestamp_text_rules(F.col("text"), EARLIEST, LATEST)
    return quality.issues(ticks(spark, sf_dir).withColumn("text", text), ["row"], rules).groupBy("rule").agg(F.count("*").alias("n"))


@query("p11_bbo_alias", f"""WITH {QUOTES}, a AS (SELECT "row", CASE WHEN "row" % 3 = 0 THEN '' ELSE CAST(bid_sz AS VARCHAR) END AS best_bid, CASE WHEN "row" % 2 = 0 THEN CAST(bid_sz + 1 AS VARCHAR) END AS bid_px_1, CAST(ask_sz AS VARCHAR) AS bid_price,
  CASE WHEN "row" % 5 = 0 THEN '' ELSE CAST(ask_sz + 9 AS VARCHAR) END AS best_ask, '7' AS price FROM quotes), b AS (SELECT "row", CAST(coalesce(nullif(best_bid, ''), nullif(bid_px_1, ''), nullif(bid_price, '')) AS DOUBLE) AS bid, CAST(nullif(best_ask, '') AS DOUBLE) AS ask, CAST(price AS DOUBLE) AS price FROM a)
  SELECT "row", bid, ask, CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN (bid + ask) / 2 ELSE price END AS observed FROM b""")
def bbo_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("bid_sz")
    rows = quotes(spark, sf_dir).select(
        "row", F.when(F.col("row") % 3 == 0, "").otherwise(size.cast("string")).alias("best_bid"), F.when(F.col("row") % 2 == 0, (size + 1).cast("string")).alias("bid_px_1"), F.col("ask_sz").cast("string").alias("bid_price"),
        F.when(F.col("row") % 5 == 0, "").otherwise((F.col("ask_sz") + 9).cast("string")).alias("best_ask"), F.lit("7").alias("price"),
    )
    bid, ask = quality.first_given("best_bid", "bid_px_1", "bid_price"), quality.first_given("best_ask")
    return rows.select("row", bid.alias("bid"), ask.alias("ask"), quality.observed_price(bid, ask, quality.first_given("price")).alias("observed"))


@query("p18_latency_causality", f"""WITH {TICKS}, o AS (SELECT "row", us AS created, us + 5000 + CASE WHEN "row" % 19 = 0 THEN 1 ELSE 0 END AS arrival, us + CASE WHEN "row" % 23 = 0 THEN 4000 ELSE 9000 END AS filled FROM ticks)
  SELECT CAST(count(*) AS BIGINT) AS orders, CAST(count(*) FILTER (WHERE arrival <> created + 5000) AS BIGINT) AS late_arrivals, CAST(count(*) FILTER (WHERE filled < arrival) AS BIGINT) AS early_fills FROM o""")
def latency_causality(spark: SparkSession, sf_dir: str) -> DataFrame:
    us, row = F.col("us"), F.col("row")
    orders = ticks(spark, sf_dir).select(us.alias("created"), (us + 5000 + F.when(row % 19 == 0, 1).otherwise(0)).alias("arrival"), (us + F.when(row % 23 == 0, 4000).otherwise(9000)).alias("filled"))
    return quality.causality(orders, 5000)


@query("p19_no_zero_fill", f"""WITH {PREDS} SELECT CAST(count(*) FILTER (WHERE y IS NULL) AS BIGINT) AS nulls, CAST(count(*) FILTER (WHERE y IS NULL AND user_id % 2 = 0) AS BIGINT) AS zero_filled FROM preds""")
def no_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = preds(spark, sf_dir).select("row", "user_id", "y")
    after = before.select("row", F.coalesce("y", F.when(F.col("user_id") % 2 == 0, 0.0)).alias("y"))
    return quality.zero_filled(before, after, ["row"], "y")


@query("p21_class_frame", f"""WITH {TICKS}, {LABELS}, d AS (SELECT "row", future IS NOT NULL AS ok, CASE WHEN future > price THEN 1 WHEN future < price THEN -1 ELSE 0 END AS s FROM lab)
  SELECT "row", CAST((s + 1) / 2 AS BIGINT) AS target FROM d WHERE ok AND s <> 0""")
def class_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).withColumns({"ok": F.col("future").isNotNull(), "s": F.signum(F.col("future") - F.col("now")).cast("int")})
    return models.class_frame(rows, "ok", "s").select("row", F.col("target").cast("long").alias("target"))


# --- joins


@query("j10_positional_join", f"""WITH {TICKS}, {LABELS}, f AS (SELECT inst, us, "row", row_number() OVER (PARTITION BY inst ORDER BY us, "row") AS k FROM ticks),
  l AS (SELECT t.inst, lab.us, future, row_number() OVER (PARTITION BY t.inst ORDER BY lab.us, lab."row") AS k FROM lab JOIN ticks t ON t."row" = lab."row")
  SELECT f.inst, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE f.us <> l.us) AS BIGINT) AS apart, CAST(count(future) AS BIGINT) AS labelled FROM f JOIN l ON f.inst = l.inst AND f.k = l.k GROUP BY f.inst""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = ticks(spark, sf_dir).select("inst", "us", "row", "price")
    labelled = _labels(spark, sf_dir).select("row", F.col("us").alias("label_us"), "future").join(features.select("row", "inst"), "row")
    both = asof.by_position(features, labelled, ["inst"], ["us", "row"], ["label_us", "row"], ["label_us", "future"])
    return both.groupBy("inst").agg(F.count("*").alias("n"), F.count_if(F.col("us") != F.col("label_us")).alias("apart"), F.count("future").alias("labelled"))


@query("j11_signal_pairs", f"""WITH {PREDS}, {SIGNAL}, o AS (SELECT "row", CASE WHEN x >= q95 THEN 1 WHEN x <= q05 THEN -1 ELSE 0 END AS other FROM preds, q)
  SELECT "row", CAST(signal AS BIGINT) AS a, CAST(other AS BIGINT) AS b FROM sig JOIN o USING ("row") WHERE signal <> other""")
def signal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir)
    a = rows.select("row", F.col("signal").cast("long").alias("a"))
    b = rows.select("row", market.raw_signal(F.col("x"), F.col("q05"), F.col("q95")).cast("long").alias("b"))
    return a.join(b, "row").where("a <> b")


@query("j02_latest_trade", f"""WITH {TICKS}, {GRID}, c AS (SELECT g.inst, g.us, coalesce(g.us - t.us <= {2 * HOUR}, false) AS ok FROM grid g ASOF LEFT JOIN ticks t ON g.inst = t.inst AND g.us >= t.us)
  SELECT c.inst, c.us, CASE WHEN ok THEN p.us END AS trade_at, CASE WHEN ok THEN p.price END AS trade_price FROM c ASOF LEFT JOIN (SELECT * FROM ticks WHERE qty > 3) p ON c.inst = p.inst AND c.us >= p.us""")
def latest_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last large trade at each step of the clock, only where the clock's own state is fresh."""
    rows = ticks(spark, sf_dir)
    clock = asof.fixed_clock(grid(spark, sf_dir), rows, ["inst"], "us", ["price"], "row", 2 * HOUR).select("inst", "us", "is_available")
    found = asof.asof(clock, rows.where("qty > 3"), ["inst"], "us", ["price"], "row", prefix="trade_")
    return found.select("inst", "us", *[F.when(F.col("is_available"), F.col(c)).alias(c) for c in ("trade_at", "trade_price")])


# --- statistics

TESTS = f"""long AS (SELECT p.day, f.feature, h.horizon, CASE WHEN f.feature = 'level' THEN x WHEN f.feature = 'size' THEN CAST(1 + user_id % 7 AS DOUBLE) ELSE CAST("row" % 10 AS DOUBLE) END AS x, CASE WHEN h.horizon = 1 THEN y ELSE y2 END AS y
    FROM (SELECT *, lead(x, 2) OVER (PARTITION BY user_id ORDER BY us, "row") AS y2 FROM preds) p, (VALUES ('level'), ('size'), ('digit')) f(feature), (VALUES (1), (2)) h(horizon)),
  ok AS (SELECT * FROM long WHERE x IS NOT NULL AND y IS NOT NULL),
  rk AS (SELECT *, rank() OVER (PARTITION BY feature, horizon, day ORDER BY x) + (count(*) OVER (PARTITION BY feature, horizon, day, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature, horizon, day ORDER BY y) + (count(*) OVER (PARTITION BY feature, horizon, day, y) - 1) / 2.0 AS ry FROM ok),
  ics AS (SELECT feature, horizon, day, count(*) AS n, {CORR.format('CAST(rx AS DOUBLE)', 'CAST(ry AS DOUBLE)')} AS ic FROM rk GROUP BY feature, horizon, day),
  tests AS (SELECT feature, horizon, count(ic) AS days, sum(n) AS pairs, avg(ic) AS mean, stddev_samp(ic) AS std, count(*) FILTER (WHERE ic > 0) AS up, count(*) FILTER (WHERE ic < 0) AS down FROM ics GROUP BY feature, horizon)"""
#: Student's t in closed form for whole degrees of freedom; v: degrees, th: atan(t / sqrt(v)).
SQL_P = """1 - CASE WHEN v = 1 THEN 2 / pi() * th WHEN v % 2 = 1 THEN 2 / pi() * (th + sin(th) * cos(th) * list_sum(list_transform(range(0, (v - 1) // 2), lambda i: list_product([1.0::DOUBLE] || list_transform(range(1, i + 1), lambda j: 2.0::DOUBLE * j / (2 * j + 1) * cos(th) * cos(th))))))
  ELSE sin(th) * list_sum(list_transform(range(0, v // 2), lambda i: list_product([1.0::DOUBLE] || list_transform(range(1, i + 1), lambda j: (2.0::DOUBLE * j - 1) / (2 * j) * cos(th) * cos(th))))) END"""


def _spread(spark: SparkSession, sf_dir: str, times: int) -> int | None:
    """Tasks for the events' rows, ``times`` over, if they are more than run at once."""
    n = tasks(spark, sf_dir, "events", times)
    return n if n > spark.sparkContext.defaultParallelism else None


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.lead("x", 2).over(Window.partitionBy("user_id").orderBy("us", "row"))
    rows = preds(spark, sf_dir).withColumns({"level": F.col("x"), "size": (1 + F.col("user_id") % 7).cast("double"), "digit": (F.col("row") % 10).cast("double"), "1": F.col("y"), "2": later})
    features = rows.unpivot(["day", "row", "1", "2"], ["level", "size", "digit"], "feature", "f")
    every = features.unpivot(["day", "feature", "f"], ["1", "2"], "horizon", "outcome").withColumn("horizon", F.col("horizon").cast("long"))
    return ranks.spearman(every, ["feature", "horizon", "day"], "f", "outcome", _spread(spark, sf_dir, 6))


@query("a13_primary_tests", f"""WITH {PREDS}, {TESTS}, t AS (SELECT *, CAST(days - 1 AS BIGINT) AS v, abs(mean / (std / sqrt(days))) AS t FROM tests), a AS (SELECT *, atan(t / sqrt(v)) AS th FROM t), p AS (SELECT *, {SQL_P} AS p FROM a),
  r AS (SELECT *, row_number() OVER (ORDER BY p, feature, horizon) AS k, count(*) OVER () AS m FROM p)
  SELECT feature, CAST(horizon AS BIGINT) AS horizon, CAST(days AS BIGINT) AS days, CAST(pairs AS BIGINT) AS pairs, round(mean, 6) AS mean, round(p, 6) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC)), 6) AS q FROM r""")
def primary_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranks.primary_tests(_tests(spark, sf_dir), ["feature", "horizon"])
    return _round(out.select("feature", "horizon", "days", "pairs", "mean", "p", "q"), ["feature", "horizon"])


@query("a18_fold_deltas", f"""WITH {PREDS}, {TESTS}, d AS (SELECT horizon, day, max(ic) FILTER (WHERE feature = 'level') - max(ic) FILTER (WHERE feature = 'size') AS d FROM ics GROUP BY horizon, day),
  s AS (SELECT horizon, count(d) AS n, avg(d) AS mean, stddev_samp(d) AS std, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down FROM d WHERE d IS NOT NULL GROUP BY horizon)
  SELECT CAST(horizon AS BIGINT) AS horizon, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(CASE WHEN std > 0 THEN mean / (std / sqrt(n)) WHEN mean > 0 THEN 'infinity'::DOUBLE WHEN mean < 0 THEN '-infinity'::DOUBLE ELSE 0 END, 5) AS t,
  round(least(1.0, 2 * list_sum(list_transform(range(0, least(up, down) + 1), lambda i: exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2))))), 6) AS sign_p FROM s""")
def fold_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _tests(spark, sf_dir).groupBy("horizon", "day").pivot("feature", ["level", "size"]).agg(F.first("ic"))
    out = ranks.delta_summary(wide.withColumn("d", F.col("level") - F.col("size")), ["horizon"], "d")
    return out.select("horizon", "n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"), F.round("sign_p", 6).alias("sign_p"))


@query("a38_spread_diagnostics", f"""WITH {QUOTES}, s AS (SELECT inst, CAST(bid_sz % 4 AS DOUBLE) AS spread, min(bid_sz % 4) OVER (PARTITION BY inst) AS m FROM quotes)
  SELECT inst, round(median(spread), 6) AS median, round(quantile_cont(spread, 0.95), 6) AS p95, round(avg(CASE WHEN spread = m THEN 1.0 ELSE 0.0 END), 6) AS at_min, CAST(count(DISTINCT spread) AS BIGINT) AS levels FROM s GROUP BY inst""")
def spread_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotes(spark, sf_dir).select("inst", (F.col("bid_sz") % 4).cast("double").alias("s")).withColumn("m", F.min("s").over(Window.partitionBy("inst")))
    return _round(rows.groupBy("inst").agg(F.median("s").alias("median"), F.percentile("s", F.lit(0.95)).alias("p95"), ranks.share(F.col("s") == F.col("m")).alias("at_min"), F.count_distinct("s").alias("levels")), ["inst"])


@query("a46_difference_diagnostics", f"""WITH {PREDS}, {DAILY}, one AS (SELECT day, {CORR.format('x', 'y')} AS other FROM valid GROUP BY day), d AS (SELECT abs(ic - other) AS d FROM daily JOIN one USING (day) WHERE ic IS NOT NULL AND other IS NOT NULL)
  SELECT CAST(count(*) AS BIGINT) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS most FROM d""")
def difference_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preds(spark, sf_dir)
    both = ranks.spearman(rows, DAY, "x", "y").join(ranks.pearson(rows, DAY, "x", "y").select("day", F.col("ic").alias("other")), "day")
    return _round(ranks.absolute_differences(both, "ic", "other"), [])


@query("a47_prediction_shape", f"""WITH {PREDS}, {VALID}, b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY day ORDER BY x, "row") - 1) * 20 / count(*) OVER (PARTITION BY day)) AS BIGINT) + 1 AS bin FROM valid)
  SELECT bin, CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS feature, round(avg(y), 6) AS prediction FROM b GROUP BY bin""")
def prediction_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.pairwise_valid(preds(spark, sf_dir), "x", "y").withColumn("bin", ranks.equal_count_bucket("x", "row", DAY, 20))
    return _round(rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("x").alias("feature"), F.avg("y").alias("prediction")), ["bin"])


@query("a54_ablation", f"""WITH {PREDS}, {TESTS}, b AS (SELECT horizon, day, ic AS base FROM ics WHERE feature = 'size'), l AS (SELECT i.feature, i.horizon, i.ic, i.ic - base AS lift FROM ics i JOIN b USING (horizon, day) WHERE i.feature <> 'size')
  SELECT feature, CAST(horizon AS BIGINT) AS horizon, CAST(count(lift) AS BIGINT) AS n, round(avg(ic), 6) AS mean_ic, round(avg(lift), 6) AS mean_lift, CAST(count(*) FILTER (WHERE lift > 0) AS BIGINT) AS better FROM l GROUP BY feature, horizon""")
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _tests(spark, sf_dir)
    base = daily.where("feature = 'size'").select("horizon", "day", F.col("ic").alias("base"))
    lifts = daily.where("feature <> 'size'").join(base, ["horizon", "day"]).withColumn("lift", F.col("ic") - F.col("base"))
    return _round(lifts.groupBy("feature", "horizon").agg(F.count("lift").alias("n"), F.avg("ic").alias("mean_ic"), F.avg("lift").alias("mean_lift"), F.count_if(F.col("lift") > 0).alias("better")), ["feature", "horizon"])


def _fold_importance_sql(feature: str, x: str) -> str:
    """Importances of one feature by day, as a CTE imp_<feature>; rows v (day, us, row, x, hour, y)."""
    return f"""s_{feature} AS (SELECT day, count(*) AS n, sum({x}) AS sx, sum(y) AS sy, sum({x} * {x}) AS sxx, sum({x} * y) AS sxy FROM v GROUP BY day),
  e_{feature} AS (SELECT day, row_number() OVER (ORDER BY day) AS k, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM s_{feature} WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  c_{feature} AS (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope FROM e_{feature} WHERE k > 5), f_{feature} AS (SELECT day, slope, (sy - slope * sx) / n AS intercept FROM c_{feature}),
  p_{feature} AS (SELECT a.day, a.y, b.x FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY us, "row") AS k FROM v) a
    JOIN (SELECT day, {x} AS x, row_number() OVER (PARTITION BY day ORDER BY sha256(concat_ws('|', '{feature}', us, "row")), us, "row") AS k FROM v) b ON a.day = b.day AND a.k = b.k),
  imp_{feature} AS (SELECT '{feature}' AS feature, o.day, p.e - o.e AS importance FROM (SELECT v.day, avg(abs(y - intercept - slope * {x})) AS e FROM v JOIN f_{feature} f ON v.day = f.day GROUP BY v.day) o
    JOIN (SELECT p.day, avg(abs(y - intercept - slope * x)) AS e FROM p_{feature} p JOIN f_{feature} f ON p.day = f.day GROUP BY p.day) p ON o.day = p.day)"""


@query("a56_importance_stability", f"""WITH {PREDS}, v AS (SELECT *, CAST(us // 3600000000 % 24 AS DOUBLE) AS hour FROM preds WHERE x IS NOT NULL AND y IS NOT NULL), {_fold_importance_sql("value", "x")}, {_fold_importance_sql("hour", "hour")}
  SELECT feature, CAST(count(importance) AS BIGINT) AS folds, round(avg(importance), 6) AS mean, round(stddev_samp(importance), 6) AS std FROM (SELECT * FROM imp_value UNION ALL SELECT * FROM imp_hour) GROUP BY feature""")
def importance_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each feature the permutation importances over days, each day's by the model of the days before."""
    rows = preds(spark, sf_dir).withColumn("hour", (F.floor(F.col("us") / HOUR) % 24).cast("double")).dropna(subset=["x", "y"])
    every = None
    for feature, x in (("value", "x"), ("hour", "hour")):
        part = models.fold_importance(rows, "day", x, "y", ["us", "row"], 5, feature).withColumn("feature", F.lit(feature))
        every = part if every is None else every.unionByName(part)
    return _round(every.groupBy("feature").agg(F.count("importance").alias("folds"), F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std")), ["feature"])


# --- selections and scalars


@query("t08_even_sample", f"""WITH {PREDS}, k AS (SELECT day, "row", row_number() OVER (PARTITION BY day ORDER BY us, "row") - 1 AS i, count(*) OVER (PARTITION BY day) AS n FROM preds), w AS (SELECT DISTINCT day, CAST(floor(j * (n - 1) / 6.0 + 0.5) AS BIGINT) AS i FROM (SELECT DISTINCT day, n FROM k), range(7) r(j))
  SELECT k.day, k."row" FROM k JOIN w ON w.day = k.day AND w.i = k.i""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.evenly_spaced(preds(spark, sf_dir), DAY, ["us", "row"], 7).select("day", "row")


@query("t11_first_rows_on_ingest", f"""WITH {TICKS} SELECT "row" FROM ticks ORDER BY us, "row" LIMIT 50""")
def first_rows_on_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).orderBy("us", "row").limit(50).select("row")


@query("h03_depth_imbalance", f"""WITH {BOOK}, {FINAL}, l AS (SELECT *, row_number() OVER (PARTITION BY inst, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS k FROM final),
  d AS (SELECT inst, sum(CASE WHEN side = 'bid' AND k <= 5 THEN qty ELSE 0 END) AS b5, sum(CASE WHEN side = 'ask' AND k <= 5 THEN qty ELSE 0 END) AS a5, sum(CASE WHEN side = 'bid' AND k <= 10 THEN qty ELSE 0 END) AS b10, sum(CASE WHEN side = 'ask' AND k <= 10 THEN qty ELSE 0 END) AS a10 FROM l GROUP BY inst)
  SELECT inst, round((b5 - a5) / nullif(b5 + a5, 0), 6) AS top_5, round((b10 - a10) / nullif(b10 + a10, 0), 6) AS top_10 FROM d""")
def depth_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = book.top_levels(book.final_levels(book_updates(spark, sf_dir), ["inst"], BOOK_KEYS), ["inst"], 10)

    def depth(side: str, n: int) -> Column:
        return F.sum(F.when((F.col("side") == side) & (F.col("level") <= n), F.col("qty")).otherwise(0.0))

    return levels.groupBy("inst").agg(*[F.round(market.imbalance(depth("bid", n), depth("ask", n)), 6).alias(f"top_{n}") for n in (5, 10)])


@query("h04_microprice_deviation", f"""WITH {QUOTES}, m AS (SELECT "row", mid, (ask * bid_sz + bid * ask_sz) / CAST(bid_sz + ask_sz AS DOUBLE) AS micro FROM quotes) SELECT "row", round((micro - mid) / nullif(mid, 0), 8) AS ratio, round((micro - mid) / nullif(mid, 0) * 10000, 5) AS bps FROM m""")
def microprice_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = market.microprice_deviation(*[F.col(c) for c in ("bid", "bid_sz", "ask", "ask_sz")])
    return quotes(spark, sf_dir).select("row", F.round(off, 8).alias("ratio"), F.round(off * 10_000, 5).alias("bps"))


@query("h11_epoch_units", f"""WITH {TICKS} SELECT "row", CASE WHEN "row" % 2 = 0 THEN us // 1000 * 1000 ELSE us END AS at FROM ticks""")
def epoch_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that some rows give in milliseconds and others in microseconds."""
    feed = ticks(spark, sf_dir).select("row", F.when(F.col("row") % 2 == 0, F.floor(F.col("us") / 1000)).otherwise(F.col("us")).alias("time"))
    return feed.select("row", market.epoch_micros(F.col("time")).alias("at"))


@query("h12_decimal_text", """SELECT c_custkey, regexp_replace(regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(18, 4)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS text FROM customer""")
def decimal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", market.decimal_text(F.col("c_acctbal").cast("decimal(18,4)")).alias("text"))


@query("h13_safe_names", """SELECT n_nationkey, regexp_replace(lower(trim(concat('  ', n_name, '/', n_regionkey, ' '))), '[^a-z0-9_.-]', '_', 'g') AS name FROM nation""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", market.safe_name(F.concat(F.lit("  "), "n_name", F.lit("/"), F.col("n_regionkey").cast("string"), F.lit(" "))).alias("name"))


@query("h15_limit_orders", f"""WITH {QUOTES}, o AS (SELECT inst, bid, ask, CASE WHEN "row" % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN "row" % 10 = 0 THEN -1 ELSE bid + "row" % 3 * 0.5 END AS lim FROM quotes)
  SELECT inst, CAST(count(*) FILTER (WHERE lim > 0) AS BIGINT) AS admissible, CAST(count(*) FILTER (WHERE lim > 0 AND CASE WHEN side = 'BUY' THEN lim >= ask ELSE lim <= bid END) AS BIGINT) AS marketable FROM o GROUP BY inst""")
def limit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.col("row")
    o = quotes(spark, sf_dir).withColumns({"side": F.when(row % 2 == 0, "BUY").otherwise("SELL"), "lim": F.when(row % 10 == 0, -1.0).otherwise(F.col("bid") + row % 3 * 0.5)})
    good = market.admissible(F.col("lim"))
    return o.groupBy("inst").agg(F.count_if(good).alias("admissible"), F.count_if(good & market.marketable(F.col("side"), F.col("lim"), F.col("bid"), F.col("ask"))).alias("marketable"))


@query("h21_secondary_rules", f"""WITH {PREDS}, {BOUNDS}, s AS (SELECT "row", CASE WHEN x >= q95 THEN 1 WHEN x <= q05 THEN -1 ELSE 0 END AS tails, sign(x - 100) AS direction, 1 / (1 + exp(-(x - 100) / 50)) AS p FROM preds, q)
  SELECT "row", CAST(tails AS BIGINT) AS tails, CAST(direction AS BIGINT) AS direction, CAST(CASE WHEN p >= 0.55 THEN 1 WHEN p <= 0.45 THEN -1 ELSE 0 END AS BIGINT) AS probability FROM s""")
def secondary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = 1 / (1 + F.exp(-(F.col("x") - 100) / 50))
    rules = {"tails": market.raw_signal(F.col("x"), F.col("q05"), F.col("q95")), "direction": market.sign_signal(F.col("x") - 100), "probability": market.raw_signal(p, F.lit(0.45), F.lit(0.55))}
    return _signals(spark, sf_dir).select("row", *[c.cast("long").alias(n) for n, c in rules.items()])


@query("h25_stable_seed", """SELECT n_nationkey, CAST(('0x' || substring(sha256('seed|' || n_name), 1, 8)) AS BIGINT) AS seed FROM nation""")
def stable_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", market.stable_seed(F.lit("seed"), F.col("n_name")).alias("seed"))


@query("h28_level_quantity", f"""WITH {BOOK}, {FINAL}, g AS (SELECT DISTINCT inst FROM book), p AS (SELECT unnest(range(97, 104)) AS price)
  SELECT g.inst, CAST(p.price AS BIGINT) AS price, coalesce((SELECT sum(qty) FROM final f WHERE f.inst = g.inst AND f.price = p.price AND f.side = 'bid'), 0) AS quantity FROM g, p""")
def level_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = book_updates(spark, sf_dir)
    bids = book.final_levels(updates, ["inst"], BOOK_KEYS).where("side = 'bid'")
    levels = updates.select("inst").distinct().join(bids.groupBy("inst").agg(F.collect_list(F.struct(F.col("price").alias("px"), F.col("qty").alias("sz"))).alias("levels")), "inst", "left")  # a book's levels
    asked = levels.withColumn("price", F.explode(F.sequence(F.lit(97).cast("long"), F.lit(103).cast("long"))))
    return asked.select("inst", "price", book.level_quantity(F.col("levels"), F.col("price")).alias("quantity"))


@query("h30_json_numbers", f"""WITH {FILLS}, s AS (SELECT scenario, sum(fee) AS fee, CASE WHEN scenario % 3 = 0 THEN NULL ELSE round(sum(signed), 4) END AS v FROM fills GROUP BY scenario)
  SELECT concat('fee_', replace(printf('%.2f', scenario * 0.25), '.', '_')) AS name, v AS value FROM s""")
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fills(spark, sf_dir).groupBy("scenario").agg(F.sum("signed").alias("v"))
    odd = F.when(F.col("scenario") % 3 == 0, F.lit(float("nan"))).otherwise(F.round("v", 4))
    return s.select(market.fee_name(F.col("scenario") * 0.25).alias("name"), market.finite(odd).alias("value"))


# --- models


@query("m08_folds", f"""WITH {PREDS}, d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM preds))
  SELECT 'expanding' AS kind, day, CAST(i AS BIGINT) AS n_train, (SELECT min(day) FROM d) AS first_train FROM d WHERE i >= 12
  UNION ALL SELECT 'rolling', a.day, CAST(6 AS BIGINT), b.day FROM d a JOIN d b ON b.i = a.i - 6 WHERE a.i >= 12""")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which days each validation day is trained on; no later day is ever among them."""
    days = [r.day for r in preds(spark, sf_dir).select("day").distinct().collect()]  # a row per day
    kinds = {"expanding": models.expanding_folds(days, 12), "rolling": models.rolling_folds(days, 6, 12)}
    rows = [(kind, day, len(train), train[0]) for kind, made in kinds.items() for train, day in made]
    return spark.createDataFrame(rows, "kind string, day long, n_train long, first_train long")


@query("m02_null_model", f"""WITH {PREDS}, {VALID}, m AS (SELECT avg(y) AS m FROM valid WHERE day < 19740) SELECT day, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - m)), 6) AS mae, round(sqrt(avg((y - m) * (y - m))), 6) AS rmse FROM valid, m WHERE day >= 19740 GROUP BY day""")
def null_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.pairwise_valid(preds(spark, sf_dir), "x", "y")
    predicted = rows.where("day >= 19740").withColumn("p", F.lit(models.mean_model(rows.where("day < 19740"), "y")))
    return _round(ranks.regression_metrics(predicted, DAY, "y", "p").select("day", "n", "mae", "rmse"), DAY)


NEWTON_ROUNDS = 10


def _newton_sql(rows: str) -> str:
    """w0 to w<NEWTON_ROUNDS> (w, b): Newton's rounds for one feature x and label y of a table, with an L2 penalty of 1 on w."""
    out = "w0 AS (SELECT CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b)"
    for i in range(NEWTON_ROUNDS):
        out += f""", m{i} AS (SELECT any_value(w) AS w, any_value(b) AS b, sum((p - y) * x) + any_value(w) AS gw, sum(p - y) AS gb, sum(p * (1 - p) * x * x) + 1 AS ww, sum(p * (1 - p) * x) AS wb, sum(p * (1 - p)) AS bb
    FROM (SELECT x, y, w, b, 1 / (1 + exp(-(w * x + b))) AS p FROM {rows}, w{i})), w{i + 1} AS (SELECT w - (gw * bb - gb * wb) / (ww * bb - wb * wb) AS w, b - (gb * ww - gw * wb) / (ww * bb - wb * wb) AS b FROM m{i})"""
    return out


@query("m06_logistic", f"""WITH r AS (SELECT d.doc_id, ln(1 + CAST(n_chars AS DOUBLE)) - 7 AS x, CAST(quality AS DOUBLE) AS y FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL), train AS (SELECT * FROM r WHERE doc_id % 2 = 0), {_newton_sql("train")},
  t AS (SELECT y, 1 / (1 + exp(-(w * x + b))) AS p, w, b FROM r, w{NEWTON_ROUNDS} WHERE doc_id % 2 = 1)
  SELECT CAST(count(*) AS BIGINT) AS n, round(any_value(w), 6) AS weight, round(any_value(b), 6) AS intercept, round(avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))), 6) AS log_loss, round(avg((y - p) * (y - p)), 6) AS brier FROM t""")
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic regression of documents' quality on their length by Newton's method, fitted on even ids and judged on odd ones."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").where("quality is not null")
    rows = docs.join(labels, "doc_id").select("doc_id", (F.log1p(F.col("n_chars").cast("double")) - 7).alias("length"), F.col("quality").cast("double").alias("label"))
    fitted = models.logistic(rows.where("doc_id % 2 = 0"), ["length"], "label")
    scored = models.logistic_probability(rows.where("doc_id % 2 = 1"), ["length"], fitted).withColumn("part", F.lit("odd"))
    losses = ranks.classification_losses(scored, ["part"], "label", "prob").join(scored.groupBy("part").agg(F.count("*").alias("n")), "part")
    return losses.select("n", F.round(F.lit(fitted[0][0]), 6).alias("weight"), F.round(F.lit(fitted[1]), 6).alias("intercept"), F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


@query("m06_boosted_classes")
def boosted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and share of right classes of boosted trees for documents' quality, fitted on even ids and judged on odd ones."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), table(spark, sf_dir, "labels").where("quality is not null")
    rows = docs.join(labels, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("length"), (F.col("lang") == "en").cast("double").alias("english"), F.col("quality").cast("double").alias("label"))
    assembler, model = models.boosted_trees(rows.where("doc_id % 2 = 0"), ["length", "english"], "label", trees=20, classify=True)
    scored = model.transform(assembler.transform(rows.where("doc_id % 2 = 1").dropna())).select("label", "prediction", _probability_of_one(F.col("probability")).alias("prob"), F.lit("odd").alias("part"))
    right = scored.groupBy("part").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("right"))
    return ranks.auc(scored, ["part"], "label", "prob").join(right, "part").select("n", "auc", "right")


def _probability_of_one(vector: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.get(vector_to_array(vector), F.lit(1))


@query("m07_importances")
def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of boosted trees on the first 20 days: each feature's gain, and how much worse predictions get with it permuted."""
    rows = preds(spark, sf_dir).withColumn("hour", (F.col("us") / 3_600_000_000 % 24).cast("double")).dropna(subset=["x", "y"])
    return models.importances(rows, ["x", "hour"], "y", ["us", "row"])


KINDS_SQL = ", ".join([
    """real AS (SELECT 'real' AS kind, day, x, y FROM raw), lagged AS (SELECT 'lagged' AS kind, day, lag(x, 20) OVER (PARTITION BY day ORDER BY us, "row") AS x, y FROM raw)""",
    """permuted_feature AS (SELECT 'permuted_feature' AS kind, a.day, b.v AS x, a.y FROM a_feature a JOIN b_feature b ON a.day = b.day AND a.k = b.k)""",
    """permuted_target AS (SELECT 'permuted_target' AS kind, a.day, a.x, b.v AS y FROM a_feature a JOIN b_target b ON a.day = b.day AND a.k = b.k)""",
    """every AS (SELECT * FROM real UNION ALL SELECT * FROM lagged UNION ALL SELECT * FROM permuted_feature UNION ALL SELECT * FROM permuted_target)""",
    """ok AS (SELECT * FROM every WHERE x IS NOT NULL AND y IS NOT NULL)""",
    """rk AS (SELECT kind, day, rank() OVER (PARTITION BY kind, day ORDER BY x) + (count(*) OVER (PARTITION BY kind, day, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY kind, day ORDER BY y) + (count(*) OVER (PARTITION BY kind, day, y) - 1) / 2.0 AS ry FROM ok)""",
    f"""ic AS (SELECT kind, day, {CORR.format('CAST(rx AS DOUBLE)', 'CAST(ry AS DOUBLE)')} AS ic FROM rk GROUP BY kind, day)""",
])


@query("m10_negative_controls", f"""WITH {ALL_PREDS}, {DEALT.format('feature', 'x')}, b_target AS (SELECT day, y AS v, row_number() OVER (PARTITION BY day ORDER BY sha256(concat_ws('|', 'target', us, "row")), us, "row") AS k FROM raw), {KINDS_SQL}
  SELECT kind, CAST(count(ic) AS BIGINT) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std FROM ic GROUP BY kind""")
def negative_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean daily rank correlation of the feature, of a permuted feature, a permuted target and a lagged feature."""
    rows = dealt(preds(spark, sf_dir).where("y is not null").select("day", "us", "row", "x", "y"), tasks(spark, sf_dir, "events"), "day")
    kinds = {
        "real": rows, "permuted_feature": models.permuted(rows, DAY, "feature", ["us", "row"], "x"), "permuted_target": models.permuted(rows, DAY, "target", ["us", "row"], "y"),
        "lagged": rows.withColumn("x", F.lag("x", 20).over(Window.partitionBy("day").orderBy("us", "row"))),
    }
    every = None
    for kind, some in kinds.items():
        part = some.select(F.lit(kind).alias("kind"), "day", "x", "y")
        every = part if every is None else every.union(part)
    return _round(ranks.daily_summary(ranks.spearman(every, ["kind", "day"], "x", "y", _spread(spark, sf_dir, 4)), ["kind"], "ic").select("kind", "n", "mean", "std"), ["kind"])


@query("m11_prediction_reconciliation", f"""WITH {PREDS}, {VALID}, half AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM valid WHERE "row" % 2 = 0), whole AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM valid),
  p AS (SELECT "row", round(half.s * x + half.i, 6) AS a, round(whole.s * x + whole.i, 6) AS b FROM valid, half, whole) SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (WHERE abs(a - b) > greatest(1e-8, abs(b) * 0.002)) AS BIGINT) AS apart FROM p""")
def prediction_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions of two fits, one by moments over half the rows and one by the closed form over all: how many are more than 0.2% apart."""
    from tapestream.operators import economics

    rows = ranks.pairwise_valid(preds(spark, sf_dir), "x", "y")
    w, b = models.ridge(rows.where(F.col("row") % 2 == 0), ["x"], "y", 0.0)
    fit = models.ols_one(rows.withColumn("all", F.lit(1)), ["all"], "x", "y").select("slope", "intercept").first()
    folder = new_folder(spark, "predictions")
    rows.select("row", F.round(models.linear_prediction(["x"], w, b), 6).alias("p")).write.parquet(f"{folder}/half")
    rows.select("row", F.round(F.lit(fit["slope"]) * F.col("x") + F.lit(fit["intercept"]), 6).alias("p")).write.parquet(f"{folder}/whole")
    return economics.reconcile(spark.read.parquet(f"{folder}/half"), spark.read.parquet(f"{folder}/whole"), ["row"], "p", relative=0.002)


@query("m12_prediction_correlations", f"""WITH {PREDS.replace('preds AS', 'raw AS')}, preds AS (SELECT day, "row", us, user_id, x, avg(x) OVER (PARTITION BY user_id ORDER BY us, "row" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS y FROM raw), {DAILY}, one AS (SELECT day, {CORR.format('x', 'y')} AS pearson FROM valid GROUP BY day)
  SELECT day, round(ic, 6) AS spearman, round(pearson, 6) AS pearson FROM daily JOIN one USING (day)""")
def prediction_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two models' predictions: the last value, and the mean of the five before."""
    mean = F.avg("x").over(Window.partitionBy("user_id").orderBy("us", "row").rowsBetween(-5, -1))
    rows = preds(spark, sf_dir).withColumn("y", mean)
    both = ranks.spearman(rows, DAY, "x", "y").select("day", F.col("ic").alias("spearman")).join(ranks.pearson(rows, DAY, "x", "y").select("day", F.col("ic").alias("pearson")), "day")
    return _round(both, DAY)
