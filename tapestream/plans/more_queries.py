"""Further queries: masks, selections, summaries of folds and scenarios, and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapestream.bridge import BOOK, BOOK_ORDER, FILLS, HOUR, PREDS, QUOTES, TICKS, book_updates, fills, kept_fills, preds, quotes, table, ticks
from tapestream.functions import market
from tapestream.operators import asof, book, execution, ledger, models, quality, ranks, scans, selection, signals
from tapestream.plans.registry import query
from tapestream.plans.research_queries import BOUNDS, BUCKETED, DAILY, DAY, SIGNAL, VALID, _round, _signals
from tapestream.plans.trading_queries import BY, ORDER, SQL_ORDER, SUMS
from tapestream.sources.scratch import stored


@query("p04_coverage", f"""WITH {PREDS} SELECT day, CAST(count(*) AS BIGINT) AS candidates, CAST(count(x) AS BIGINT) AS features, CAST(count(y) AS BIGINT) AS labels, CAST(count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS BIGINT) AS paired FROM preds GROUP BY day""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return preds(spark, sf_dir).groupBy("day").agg(F.count("*").alias("candidates"), F.count("x").alias("features"), F.count("y").alias("labels"), F.count_if(both).alias("paired"))


@query("p05_nonoverlap_rows", f"""WITH {PREDS} SELECT "row" FROM (SELECT "row", row_number() OVER (PARTITION BY day ORDER BY us, "row") - 1 AS k FROM preds) WHERE k % 10 = 3""")
def nonoverlap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.every_nth(preds(spark, sf_dir), DAY, ["us", "row"], 10, 3).select("row")


@query("p07_schema_counts", """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE l_extendedprice <= 0) AS BIGINT) AS bad_price, CAST(count(*) FILTER (WHERE l_quantity < 0) AS BIGINT) AS bad_quantity, CAST(count(*) FILTER (WHERE l_shipdate IS NULL) AS BIGINT) AS bad_time FROM lineitem""")
def schema_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.count_if(c("l_extendedprice") <= 0).alias("bad_price"), F.count_if(c("l_quantity") < 0).alias("bad_quantity"), F.count_if(c("l_shipdate").isNull()).alias("bad_time"))


@query("p15_bbo_changed", f"""WITH {QUOTES}, s AS (SELECT "row", inst, us, CAST(floor(mid / 40) AS BIGINT) AS b, bid_sz % 3 AS z FROM quotes)
  SELECT "row" FROM (SELECT *, lag(b) OVER w AS pb, lag(z) OVER w AS pz FROM s WINDOW w AS (PARTITION BY inst ORDER BY us, "row")) WHERE pb IS NOT NULL AND (b <> pb OR z <> pz)""")
def bbo_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotes(spark, sf_dir).select("row", "inst", "us", F.floor(F.col("mid") / 40).cast("long").alias("b"), (F.col("bid_sz") % 3).alias("z"))
    rows = scans.previous(rows, ["inst"], ["us", "row"], {"pb": "b", "pz": "z"})
    return rows.where("pb is not null and (b <> pb or z <> pz)").select("row")


@query("p16_min_spread", f"""WITH {QUOTES}, s AS (SELECT inst, bid_sz % 4 AS spread, min(bid_sz % 4) OVER (PARTITION BY inst) AS m FROM quotes) SELECT inst, CAST(count(*) FILTER (WHERE spread = m) AS BIGINT) AS tight, CAST(count(*) FILTER (WHERE spread > m) AS BIGINT) AS wide FROM s GROUP BY inst""")
def min_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotes(spark, sf_dir).select("inst", (F.col("bid_sz") % 4).alias("s")).withColumn("m", F.min("s").over(Window.partitionBy("inst")))
    return rows.groupBy("inst").agg(F.count_if(F.col("s") == F.col("m")).alias("tight"), F.count_if(F.col("s") > F.col("m")).alias("wide"))


@query("p17_order_violations", """SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT epoch_us(l_shipdate) AS t, lag(epoch_us(l_shipdate)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS p FROM lineitem) WHERE t < p""")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("p", F.lag("l_shipdate").over(w)).where("l_shipdate < p").agg(F.count("*").alias("n"))


@query("j06_snapshot_at_order", f"""WITH {TICKS}, o AS (SELECT event_type AS inst, epoch_us(ts) + 1 AS us, event_id AS id FROM events) SELECT o.id, t."row" AS snapshot FROM o ASOF LEFT JOIN ticks t ON o.inst = t.inst AND o.us >= t.us""")
def snapshot_at_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    orders = rows.select("inst", (F.col("us") + 1).alias("us"), F.col("row").alias("id"))
    return asof.asof(orders, rows.withColumn("snapshot", F.col("row")), ["inst"], "us", ["snapshot"], "row").select("id", "snapshot")


@query("j08_desired_vs_actual", f"""WITH {PREDS}, {SIGNAL}, {TICKS}, d AS (SELECT us, signal FROM sig) SELECT t."row", CAST(coalesce(d.signal, 0) AS BIGINT) AS desired FROM ticks t ASOF LEFT JOIN d ON t.us >= d.us""")
def desired_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _signals(spark, sf_dir).select(F.lit(1).alias("book"), "us", "row", "signal")
    marks = ticks(spark, sf_dir).select(F.lit(1).alias("book"), "us", "row")
    return asof.asof(marks, wanted, ["book"], "us", ["signal"], "row").select("row", F.coalesce("signal", F.lit(0)).cast("long").alias("desired"))


@query("j12_left_to_target", f"""WITH {PREDS}, {SIGNAL} SELECT s."row", CAST(s.signal AS BIGINT) AS signal, round(p.y, 6) AS target FROM sig s LEFT JOIN (SELECT * FROM preds WHERE y > 100) p ON p."row" = s."row" WHERE s.signal <> 0""")
def left_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = preds(spark, sf_dir).where("y > 100").select("row", F.round("y", 6).alias("target"))
    return _signals(spark, sf_dir).where("signal <> 0").select("row", F.col("signal").cast("long").alias("signal")).join(target, "row", "left")


@query("j19_upsert", """SELECT c_custkey, round(CAST(coalesce(n.total, c_acctbal) AS DOUBLE), 2) AS balance FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders GROUP BY o_custkey) n ON o_custkey = c_custkey""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("total"))
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return old.join(new, "c_custkey", "left").select("c_custkey", F.round(F.coalesce("total", "c_acctbal").cast("double"), 2).alias("balance"))


MEANS = f"{BUCKETED}, m AS (SELECT day, bucket, count(*) AS n, avg(y) AS mean FROM b GROUP BY day, bucket)"
RANKS_OF_MEANS = "q AS (SELECT *, CAST(bucket AS DOUBLE) AS bx, rank() OVER (PARTITION BY day ORDER BY mean) + (count(*) OVER (PARTITION BY day, mean) - 1) / 2.0 AS rm FROM m)"


@query("a04_monotonicity", f"""WITH {PREDS}, {MEANS}, {RANKS_OF_MEANS} SELECT day, CAST(count(*) AS BIGINT) AS n, round(covar_pop(bx, CAST(rm AS DOUBLE)) / nullif(stddev_pop(bx) * stddev_pop(CAST(rm AS DOUBLE)), 0), 6) AS ic FROM q GROUP BY day""")
def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ranks.bucket_means(preds(spark, sf_dir), DAY, "x", "y", "row").where("n > 0")
    return _round(ranks.spearman(means, DAY, "bucket", "mean"), DAY)


@query("a14_half_stability", f"""WITH {PREDS}, {DAILY} SELECT round(avg(ic) FILTER (WHERE day % 2 = 0), 6) AS even, round(avg(ic) FILTER (WHERE day % 2 = 1), 6) AS odd, sign(avg(ic) FILTER (WHERE day % 2 = 0)) = sign(avg(ic) FILTER (WHERE day % 2 = 1)) AS same_sign FROM daily""")
def half_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = ranks.spearman(preds(spark, sf_dir), DAY, "x", "y")
    even, odd = (F.avg(F.when(F.col("day") % 2 == k, F.col("ic"))) for k in (0, 1))
    return daily.agg(F.round(even, 6).alias("even"), F.round(odd, 6).alias("odd"), (F.signum(even) == F.signum(odd)).alias("same_sign"))


@query("a17_lift", f"""WITH {PREDS}, {DAILY}, e AS (SELECT day, avg(y - x) AS other FROM valid GROUP BY day) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(ic - other), 6) AS mean, round(median(ic - other), 6) AS median, CAST(count(*) FILTER (WHERE ic > other) AS BIGINT) AS better FROM daily JOIN e USING (day)""")
def lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preds(spark, sf_dir)
    other = ranks.pairwise_valid(rows, "x", "y").groupBy("day").agg(F.avg(F.col("y") - F.col("x")).alias("other"))
    d = ranks.spearman(rows, DAY, "x", "y").join(other, "day").withColumn("d", F.col("ic") - F.col("other"))
    return _round(d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.count_if(F.col("d") > 0).alias("better")), [])


@query("a19_periods", f"""WITH {PREDS}, {DAILY}, p AS (SELECT CASE WHEN day < 19732 THEN 'early' WHEN day < 19742 THEN 'middle' ELSE 'late' END AS period, ic FROM daily) SELECT period, CAST(count(*) AS BIGINT) AS n, round(avg(ic), 6) AS mean FROM p GROUP BY period""")
def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = F.when(F.col("day") < 19732, "early").when(F.col("day") < 19742, "middle").otherwise("late").alias("period")
    return _round(ranks.spearman(preds(spark, sf_dir), DAY, "x", "y").groupBy(period).agg(F.count("*").alias("n"), F.avg("ic").alias("mean")), ["period"])


@query("a20_signal_coverage", f"""WITH {PREDS}, {SIGNAL}, r AS (SELECT day, 'q10_q90' AS rule, signal FROM sig UNION ALL SELECT day, 'q05_q95', CASE WHEN x >= q95 THEN 1 WHEN x <= q05 THEN -1 ELSE 0 END FROM preds, q)
  SELECT day, rule, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE signal > 0) AS BIGINT) AS long, CAST(count(*) FILTER (WHERE signal < 0) AS BIGINT) AS short FROM r GROUP BY day, rule""")
def signal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _signals(spark, sf_dir).select("day", F.col("signal").alias("q10_q90"), market.raw_signal(F.col("x"), F.col("q05"), F.col("q95")).alias("q05_q95"))
    rules = wide.unpivot(["day"], ["q10_q90", "q05_q95"], "rule", "signal")
    return rules.groupBy("day", "rule").agg(F.count("*").alias("n"), F.count_if(F.col("signal") > 0).alias("long"), F.count_if(F.col("signal") < 0).alias("short"))


@query("a24_execution_summary", f"""WITH {FILLS}, o AS (SELECT scenario, order_id, sum(qty) AS q, sum(price * qty) / sum(qty) AS px, max(price) AS worst FROM fills GROUP BY scenario, order_id)
  SELECT scenario, CAST(count(*) AS BIGINT) AS orders, round(avg(q), 4) AS mean_filled, round(median(worst - px), 4) AS median_slip, round(quantile_cont(worst - px, 0.95), 4) AS p95_slip FROM o GROUP BY scenario""")
def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fills(spark, sf_dir).groupBy("scenario", "order_id").agg(F.sum("qty").alias("q"), execution.vwap(F.col("price"), F.col("qty")).alias("px"), F.max("price").alias("worst"))
    o = stored(o.select("scenario", "q", (F.col("worst") - F.col("px")).alias("slip")), "slips")
    sums = o.groupBy("scenario").agg(F.count("*").alias("orders"), F.avg("q").alias("mean_filled"))
    return _round(selection.with_quantiles(sums, o, BY, {"slip": F.col("slip")}, {"slip": {"median_slip": 0.5, "p95_slip": 0.95}}), BY, 4)


@query("a26_depth_histogram", """WITH d AS (SELECT l_orderkey, count(*) AS levels FROM lineitem GROUP BY l_orderkey) SELECT CAST(levels AS BIGINT) AS levels, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY levels""")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("levels")).groupBy("levels").agg(F.count("*").alias("n"))


@query("a32_conservation", f"""WITH {FILLS} SELECT scenario, round(abs(sum(signed) - sum(CASE WHEN signed > 0 THEN qty ELSE -qty END)), 6) AS quantity_gap, round(abs(sum(fee) - sum(CASE WHEN role = 'maker' THEN fee END) - sum(CASE WHEN role = 'taker' THEN fee END)), 6) AS fee_gap FROM fills GROUP BY scenario""")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.sum("signed") - F.sum(F.when(F.col("signed") > 0, F.col("qty")).otherwise(-F.col("qty")))
    fee = F.sum("fee") - F.sum(F.when(F.col("role") == "maker", F.col("fee"))) - F.sum(F.when(F.col("role") == "taker", F.col("fee")))
    return fills(spark, sf_dir).groupBy("scenario").agg(F.round(F.abs(q), 6).alias("quantity_gap"), F.round(F.abs(fee), 6).alias("fee_gap"))


@query("a37_discreteness", f"""WITH {QUOTES}, r AS (SELECT inst, CAST(floor(mid / 100) AS BIGINT) - lag(CAST(floor(mid / 100) AS BIGINT)) OVER (PARTITION BY inst ORDER BY us, "row") AS d FROM quotes)
  SELECT inst, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero, CAST(count(DISTINCT d) AS BIGINT) AS distinct_moves, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS up FROM r WHERE d IS NOT NULL GROUP BY inst""")
def discreteness(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.floor(F.col("mid") / 100)
    r = scans.previous(quotes(spark, sf_dir).withColumn("l", level), ["inst"], ["us", "row"], {"p": "l"}).withColumn("d", F.col("l") - F.col("p")).where("d is not null")
    return _round(r.groupBy("inst").agg(ranks.share(F.col("d") == 0).alias("zero"), F.count_distinct("d").alias("distinct_moves"), ranks.share(F.col("d") > 0).alias("up")), ["inst"])


@query("a42_replay_counters", f"""WITH {BOOK}, a AS (SELECT *, coalesce(lag(qty) OVER (PARTITION BY side, price, inst ORDER BY {BOOK_ORDER}), 0) AS p FROM book)
  SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (WHERE qty = 0 AND p = 0) AS BIGINT) AS noops, CAST(count(*) FILTER (WHERE snapshot) AS BIGINT) AS snapshot_rows FROM a""")
def replay_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    acted = book.actions(book_updates(spark, sf_dir), ["inst"], ["us", "row"])
    return acted.agg(F.count("*").alias("events"), F.count_if(F.col("action") == "noop").alias("noops"), F.count_if("snapshot").alias("snapshot_rows"))


@query("a45_changed_state_ic", f"""WITH {PREDS.replace('preds AS', 'every AS')}, preds AS (SELECT * FROM (SELECT *, lag(floor(x / 30)) OVER (PARTITION BY day ORDER BY us, "row") AS p FROM every) WHERE p IS NOT NULL AND floor(x / 30) <> p), {DAILY} SELECT day, CAST(n AS BIGINT) AS n, round(ic, 6) AS ic FROM daily""")
def changed_state_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.floor(F.col("x") / 30)
    rows = preds(spark, sf_dir).withColumn("b", b).withColumn("p", F.lag("b").over(Window.partitionBy("day").orderBy("us", "row"))).where("p is not null and b <> p")
    return _round(ranks.spearman(rows, DAY, "x", "y"), DAY)


@query("a48_histogram", """SELECT CAST(floor(value / 50) AS BIGINT) AS bin, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS "view" FROM events GROUP BY 1""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "events").groupBy(F.floor(F.col("value") / 50).cast("long").alias("bin")).pivot("event_type", ["click", "view"]).count()
    every = table(spark, sf_dir, "events").select(F.floor(F.col("value") / 50).cast("long").alias("bin")).distinct()
    return every.join(bins, "bin", "left").fillna(0)


@query("w12_expanding_mean", f"""WITH {PREDS}, {DAILY} SELECT day, round(avg(ic) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS so_far FROM daily""")
def expanding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = ranks.spearman(preds(spark, sf_dir), DAY, "x", "y").withColumn("k", F.lit(1))  # a row per day
    return daily.select("day", F.round(F.avg("ic").over(Window.partitionBy("k").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), 6).alias("so_far"))


@query("w14_child_index", f"""WITH {FILLS} SELECT order_id, CAST(k - 1 AS BIGINT) AS child, CAST(count(*) AS BIGINT) AS n FROM (SELECT order_id, row_number() OVER (PARTITION BY order_id ORDER BY {SQL_ORDER}) AS k FROM fills) GROUP BY order_id, k""")
def child_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.row_number().over(Window.partitionBy("order_id").orderBy(*ORDER)) - 1).cast("long")
    return fills(spark, sf_dir).select("order_id", k.alias("child")).groupBy("order_id", "child").agg(F.count("*").alias("n"))


@query("w23_terminal_mark", f"""WITH {QUOTES} SELECT inst, max_by(mid, us) AS mark FROM quotes WHERE mid IS NOT NULL GROUP BY inst""")
def terminal_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes(spark, sf_dir).where("mid is not null").groupBy("inst").agg(F.max_by("mid", F.struct("us", "row")).alias("mark"))


@query("t04_top_days", f"""WITH {PREDS}, {DAILY} SELECT day, round(ic, 6) AS ic FROM daily ORDER BY ic DESC NULLS LAST, day LIMIT 5""")
def top_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ranks.spearman(preds(spark, sf_dir), DAY, "x", "y").select("day", "ic").orderBy(F.col("ic").desc_nulls_last(), "day").limit(5), DAY)


@query("t05_first_rows", f"""WITH {PREDS}, {SIGNAL} SELECT CAST(signal AS BIGINT) AS signal, "row" FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY us, "row") AS k FROM sig) WHERE k <= 4""")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("signal").orderBy("us", "row"))
    return _signals(spark, sf_dir).withColumn("k", k).where("k <= 4").select(F.col("signal").cast("long").alias("signal"), "row")


@query("t06_nearest_to_quantile", f"""WITH {PREDS}, {BOUNDS}, n AS (SELECT unnest(['q05', 'q10', 'q90', 'q95']) AS q, unnest([q05, q10, q90, q95]) AS v FROM q)
  SELECT q, "row" FROM (SELECT n.q, p."row", row_number() OVER (PARTITION BY n.q ORDER BY abs(p.x - n.v), p."row") AS k FROM n, preds p) WHERE k = 1""")
def nearest_to_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preds(spark, sf_dir).withColumn("fold", F.lit(1))
    names = ["q05", "q10", "q90", "q95"]
    near = rows.join(signals.thresholds(rows, ["fold"], "x"), "fold").agg(*[F.min_by("row", F.struct(F.abs(F.col("x") - F.col(q)), "row")).alias(q) for q in names])
    return near.unpivot([], names, "q", "row")


@query("u04_first_per_key", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1""")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("u05_missing_ids", """SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders""")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("h07_moves", f"""WITH {QUOTES}, m AS (SELECT "row", mid, ask_sz - 1 AS spread, lead(mid) OVER (PARTITION BY inst ORDER BY us, "row") AS nxt FROM quotes) SELECT "row", round((nxt - mid) / nullif(mid, 0) * 10000, 4) AS bps, CASE WHEN spread > 0 THEN round((nxt - mid) / spread, 6) END AS spreads FROM m""")
def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.last_known(quotes(spark, sf_dir), ["inst"], ["us", "row"], "n", F.col("mid"), inclusive=False, later=True).select("row", "mid", (F.col("ask_sz") - 1).alias("s"), "n")
    d = F.col("n") - F.col("mid")
    return rows.select("row", F.round(F.try_divide(d, F.col("mid")) * 10_000, 4).alias("bps"), F.when(F.col("s") > 0, F.round(F.try_divide(d, F.col("s").cast("double")), 6)).alias("spreads"))


@query("h14_costs", f"""WITH {FILLS}, r AS (SELECT *, avg(price) OVER (PARTITION BY scenario) AS ref FROM fills) SELECT scenario, round(avg(CASE WHEN signed > 0 THEN (price - ref) / ref ELSE -(price - ref) / ref END), 6) AS shortfall, round(sum(abs(price * qty) * 2.5 / 10000), 2) AS fee FROM r GROUP BY scenario""")
def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fills(spark, sf_dir).withColumn("ref", F.avg("price").over(Window.partitionBy("scenario"))).withColumn("side", F.when(F.col("signed") > 0, "buy").otherwise("sell"))
    s, fee = market.shortfall(F.col("side"), F.col("price"), F.col("ref")), market.fee_quote(F.col("price"), F.col("qty"), F.lit(2.5))
    return rows.groupBy("scenario").agg(F.round(F.avg(s), 6).alias("shortfall"), F.round(F.sum(fee), 2).alias("fee"))


@query("h17_unrealized", f"""WITH {FILLS}, {SUMS} SELECT scenario, us, order_id, round(CASE WHEN position = 0 THEN 0 ELSE position * (1000 - 900) END, 2) AS unrealized FROM run""")
def unrealized(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = ledger.running(kept_fills(spark, sf_dir), BY, ORDER)
    return run.select("scenario", "us", "order_id", F.round(market.unrealized(F.col("position"), F.lit(900.0), F.lit(1000.0)), 2).alias("unrealized"))


@query("r05_window_rescan", f"""WITH {TICKS} SELECT a."row", CAST(count(*) AS BIGINT) AS n, CAST(sum(b.qty) AS BIGINT) AS volume FROM ticks a JOIN ticks b ON a.inst = b.inst AND b.us > a.us - {HOUR} AND b.us <= a.us GROUP BY a."row" """)
def window_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trailing window's twin by intervals: sums over each are differences of two running sums, so no pair is made however many trades an hour holds."""
    rows = ticks(spark, sf_dir)
    probes = rows.select("inst", F.col("row").alias("id"), (F.col("us") - HOUR).alias("a"), F.col("us").alias("b"))
    found = scans.interval_sums(probes, rows, ["inst"], "a", "b", "us", {"n": F.lit(1), "volume": F.col("qty")}, session=HOUR)
    return found.select(F.col("id").alias("row"), F.col("n").cast("long").alias("n"), F.col("volume").cast("long").alias("volume"))


@query("m01_standardized", f"""WITH {PREDS.replace('preds AS', 'raw AS')}, preds AS (SELECT *, CASE WHEN "row" % 9 <> 0 THEN x END AS f FROM raw), s AS (SELECT median(f) AS m FROM preds), t AS (SELECT avg(coalesce(f, m)) AS a, stddev_pop(coalesce(f, m)) AS d, any_value(m) AS m FROM preds, s)
  SELECT "row", round((coalesce(f, m) - a) / d, 6) AS z, CASE WHEN f IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS missing FROM preds, t""")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preds(spark, sf_dir).select("row", F.when(F.col("row") % 9 != 0, F.col("x")).alias("f"))
    return models.Preprocessor(rows, ["f"]).apply(rows).select("row", F.round("f_z", 6).alias("z"), F.col("f_missing").alias("missing"))


@query("m09_fold_ic", f"""WITH {PREDS}, {VALID}, d AS (SELECT day, dense_rank() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM preds)), v AS (SELECT valid.*, k FROM valid JOIN d USING (day)),
  w AS (SELECT f.k, regr_slope(v.y, v.x) AS s, regr_intercept(v.y, v.x) AS i FROM d f JOIN v ON v.k < f.k WHERE f.k > 20 GROUP BY f.k)
  SELECT v.day, CAST(count(*) AS BIGINT) AS n, round(avg(abs(v.y - (w.s * v.x + w.i))), 6) AS mae FROM v JOIN w USING (k) GROUP BY v.day""")
def fold_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding folds over days: moments per day, summed up to each fold, give every fit in one pass."""
    v = ranks.pairwise_valid(preds(spark, sf_dir), "x", "y")
    days = preds(spark, sf_dir).select("day").distinct().withColumn("k", F.row_number().over(Window.orderBy("day")))  # a row per day
    m = v.groupBy("day").agg(F.count("*").alias("n"), *[F.sum(e).alias(c) for c, e in {"sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y")}.items()])
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    s = days.join(m, "day", "left").select("day", "k", *[F.sum(c).over(before).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")]).where("k > 20")
    slope = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    fit = s.select("day", slope.alias("s"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("i"))
    error = F.abs(F.col("y") - (F.col("s") * F.col("x") + F.col("i")))
    return _round(v.join(fit, "day").groupBy("day").agg(F.count("*").alias("n"), F.avg(error).alias("mae")), DAY)


@query("a41_qa_counters", f"""WITH {TICKS}, i AS (SELECT inst, 'ERROR' AS severity FROM ticks WHERE price - 40 <= 0 UNION ALL SELECT inst, 'WARNING' FROM ticks WHERE qty > 6) SELECT inst, CAST(count(*) FILTER (WHERE severity = 'ERROR') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE severity = 'WARNING') AS BIGINT) AS warnings FROM i GROUP BY inst""")
def qa_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.issues(ticks(spark, sf_dir), ["inst"], quality.price_size_rules((F.col("price") - 40).cast("string"), F.col("qty").cast("string"), 6))
    return found.groupBy("inst").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
