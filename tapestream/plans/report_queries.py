"""Reports over scenarios: accounting, costs, robustness, executions and signal coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapestream.bridge import FILLS, HOUR, PREDS, TICKS, dealt, fills, kept_fills, preds, table, tasks, ticks
from tapestream.functions import market
from tapestream.operators import economics, execution, ledger, ranks, scans
from tapestream.plans.registry import query
from tapestream.plans.research_queries import DAY, SIGNAL, _round, _signals
from tapestream.plans.trading_queries import BASE, BY, ORDER, REALIZED, SQL_ORDER, SUMS, _base, base_of

MODEL = "CASE WHEN scenario % 2 = 0 THEN 'A' ELSE 'B' END"
LATENCY = "scenario // 2 * 100"
YEAR_US = 31_557_600_000_000


def _notional() -> Column:
    return F.abs(F.col("signed") * F.col("price"))


def _model() -> Column:
    return F.when(F.col("scenario") % 2 == 0, "A").otherwise("B").alias("model")


def _latency() -> Column:
    return (F.floor(F.col("scenario") / 2) * 100).cast("long").alias("latency_ms")


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0.0))), F.lit(0.0))


@query("a23_order_summary", f"""WITH {FILLS}, o AS (SELECT scenario, order_id, sum(signed) AS s, min(us) AS us FROM fills GROUP BY scenario, order_id)
  SELECT scenario, CAST(count(*) AS BIGINT) AS orders, CAST(count(*) FILTER (WHERE s > 0) AS BIGINT) AS buys, CAST(count(*) FILTER (WHERE s < 0) AS BIGINT) AS sells,
  round(count(*) / CAST(count(DISTINCT us // {HOUR}) AS DOUBLE), 6) AS per_active_hour FROM o GROUP BY scenario""")
def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fills(spark, sf_dir).groupBy("scenario", "order_id").agg(F.sum("signed").alias("s"), F.min("us").alias("us"))
    active = F.count_distinct(F.floor(F.col("us") / HOUR))
    return o.groupBy("scenario").agg(F.count("*").alias("orders"), F.count_if(F.col("s") > 0).alias("buys"), F.count_if(F.col("s") < 0).alias("sells"), F.round(F.count("*") / active, 6).alias("per_active_hour"))


PASSIVE = f"""o AS (SELECT inst, "row" AS id, us AS a, us + {6 * HOUR} AS b, price AS lim FROM ticks),
  p AS (SELECT o.id, t.us, t."row", CAST(t.qty AS DOUBLE) AS v FROM o JOIN ticks t ON t.inst = o.inst AND t.us > o.a AND t.us <= o.b AND t.side = 'sell' AND t.price <= o.lim),
  c AS (SELECT *, sum(v) OVER (PARTITION BY id ORDER BY us, "row" ROWS UNBOUNDED PRECEDING) AS u FROM p),
  f AS (SELECT id, us, least(5, greatest(u - 3, 0)) - least(5, greatest(u - v - 3, 0)) AS fill FROM c),
  s AS (SELECT id, sum(fill) AS filled, min(us) AS first_us FROM f WHERE fill > 0 GROUP BY id)"""


@query("a25_passive_summary", f"""WITH {TICKS}, {PASSIVE} SELECT o.inst, CAST(count(*) AS BIGINT) AS orders, round(avg(CASE WHEN filled > 0 THEN 1.0 ELSE 0.0 END), 6) AS any_fill,
  round(avg(CASE WHEN filled >= 5 - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS full_fill, round(avg(coalesce(filled, 0)) / 5, 6) AS filled_share, round(median(first_us - a) / 1000000, 3) AS median_seconds
  FROM o LEFT JOIN s USING (id) GROUP BY o.inst""")
def passive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    orders = rows.select(
        "inst", F.col("row").cast("string").alias("order_id"), F.lit("BUY").alias("side"), F.col("price").alias("limit_price"), F.lit(5.0).alias("quantity"), F.lit(3.0).alias("queue"),
        F.col("us").alias("arrival"), (F.col("us") + 6 * HOUR).alias("expiry"), F.lit(None).cast("long").alias("cancel"),
    )
    done = execution.passive_fills(orders, rows, ["inst"], 6 * HOUR).groupBy("order_id").agg(F.sum("quantity").alias("filled"), F.min("fill_time").alias("first_us"))
    return execution.passive_summary(orders.join(done, "order_id", "left"), ["inst"])


DRAWDOWN = f"""dd AS (SELECT scenario, max(d) AS worst, avg(d) AS mean FROM (SELECT scenario, max(cash) OVER (PARTITION BY scenario ORDER BY {SQL_ORDER} ROWS UNBOUNDED PRECEDING) - cash AS d FROM run) GROUP BY scenario)"""


@query("h26_performance", f"""WITH {FILLS}, {SUMS}, {DRAWDOWN}, {BASE}, n AS (SELECT scenario, count(DISTINCT order_id) AS orders FROM fills GROUP BY scenario)
  SELECT scenario, round(coalesce(worst / nullif(turnover, 0), 0) * 10000, 3) AS worst_bps, round(coalesce(mean / nullif(turnover, 0), 0) * 10000, 3) AS mean_bps,
  round(coalesce((gross - fees) / nullif(CAST(orders AS DOUBLE), 0), 0), 2) AS per_order, round(coalesce(gross / nullif(turnover, 0), 0) * 10000, 3) AS gross_bps FROM base JOIN dd USING (scenario) JOIN n USING (scenario)""")
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_fills(spark, sf_dir)
    orders = kept.groupBy("scenario").agg(F.count_if("first").alias("orders"))
    rows = base_of(kept).join(ledger.drawdown_summary(kept, BY, ORDER), "scenario").join(orders, "scenario")
    t = F.col("turnover")
    return rows.select(
        "scenario", F.round(_ratio(F.col("worst"), t) * 10_000, 3).alias("worst_bps"), F.round(_ratio(F.col("mean"), t) * 10_000, 3).alias("mean_bps"),
        F.round(_ratio(F.col("gross") - F.col("fees"), F.col("orders").cast("double")), 2).alias("per_order"), F.round(_ratio(F.col("gross"), t) * 10_000, 3).alias("gross_bps"),
    )


@query("a34_breakeven_summary", f"""WITH {FILLS}, {BASE}, b AS (SELECT {MODEL} AS model, CASE WHEN gross >= 0 AND turnover > 0 THEN gross / turnover * 10000 END AS breakeven, gross FROM base)
  SELECT model, CAST(count(*) AS BIGINT) AS scenarios, CAST(count(breakeven) AS BIGINT) AS defined, round(avg(breakeven), 4) AS mean, round(avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM b GROUP BY model""")
def breakeven_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir).withColumn("breakeven", market.breakeven_bps(F.col("gross"), F.col("turnover"))).withColumn("model", _model())
    return rows.groupBy("model").agg(F.count("*").alias("scenarios"), F.count("breakeven").alias("defined"), F.round(F.avg("breakeven"), 4).alias("mean"), F.round(ranks.share(F.col("gross") > 0), 6).alias("positive"))


@query("a49_shortfall_by_latency", f"""WITH {FILLS}, r AS (SELECT *, avg(price) OVER (PARTITION BY scenario) AS ref FROM fills), s AS (SELECT {LATENCY} AS latency_ms, CASE WHEN signed > 0 THEN (price - ref) / ref ELSE -(price - ref) / ref END AS x FROM r)
  SELECT CAST(latency_ms AS BIGINT) AS latency_ms, CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median FROM s GROUP BY latency_ms""")
def shortfall_by_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fills(spark, sf_dir).withColumn("ref", F.avg("price").over(Window.partitionBy("scenario"))).withColumn("side", F.when(F.col("signed") > 0, "buy").otherwise("sell"))
    x = market.shortfall(F.col("side"), F.col("price"), F.col("ref"))
    return rows.groupBy(_latency()).agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.median(x), 6).alias("median"))


@query("a50_signal_coverage_means", f"""WITH {PREDS}, {SIGNAL}, r AS (SELECT day, 'q10_q90' AS rule, signal FROM sig UNION ALL SELECT day, 'q05_q95', CASE WHEN x >= q95 THEN 1 WHEN x <= q05 THEN -1 ELSE 0 END FROM preds, q),
  d AS (SELECT day, rule, avg(CASE WHEN signal <> 0 THEN 1.0 ELSE 0.0 END) AS active, count(*) FILTER (WHERE signal <> 0) AS n FROM r GROUP BY day, rule)
  SELECT rule, round(avg(active), 6) AS mean_active, CAST(sum(n) AS BIGINT) AS total FROM d GROUP BY rule""")
def signal_coverage_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _signals(spark, sf_dir).select("day", F.col("signal").alias("q10_q90"), market.raw_signal(F.col("x"), F.col("q05"), F.col("q95")).alias("q05_q95"))
    active = F.col("signal") != 0
    daily = wide.unpivot(["day"], ["q10_q90", "q05_q95"], "rule", "signal").groupBy("day", "rule").agg(ranks.share(active).alias("active"), F.count_if(active).alias("n"))
    return daily.groupBy("rule").agg(F.round(F.avg("active"), 6).alias("mean_active"), F.sum("n").alias("total"))


POSITIONS = "pos AS (SELECT scenario, max(position) AS longest, min(position) AS shortest, avg(abs(position)) AS mean_abs FROM run GROUP BY scenario)"


@query("a51_accounting_reports", f"""WITH RECURSIVE {FILLS}, {SUMS}, {BASE}, {POSITIONS}, {REALIZED},
  n AS (SELECT scenario, count(*) AS fills, count(DISTINCT order_id) AS orders, sum(CASE WHEN role = 'maker' THEN fee ELSE 0 END) AS maker_fees FROM fills GROUP BY scenario),
  w AS (SELECT * FROM base JOIN pos USING (scenario) JOIN realized_pnl USING (scenario) JOIN n USING (scenario))
  SELECT scenario, report, metric, round(value, 2) AS value FROM (
    SELECT scenario, 'pnl' AS report, 'gross' AS metric, gross AS value FROM w UNION ALL SELECT scenario, 'pnl', 'net', gross - fees FROM w
    UNION ALL SELECT scenario, 'inventory', 'longest', longest FROM w UNION ALL SELECT scenario, 'inventory', 'shortest', shortest FROM w UNION ALL SELECT scenario, 'inventory', 'mean_abs', mean_abs FROM w
    UNION ALL SELECT scenario, 'turnover', 'turnover', turnover FROM w UNION ALL SELECT scenario, 'turnover', 'per_order', turnover / orders FROM w
    UNION ALL SELECT scenario, 'realized', 'realized', realized FROM w UNION ALL SELECT scenario, 'realized', 'unrealized', gross - realized FROM w
    UNION ALL SELECT scenario, 'decomposition', 'maker_fees', maker_fees FROM w UNION ALL SELECT scenario, 'decomposition', 'taker_fees', fees - maker_fees FROM w
    UNION ALL SELECT scenario, 'combined', 'orders', CAST(orders AS DOUBLE) FROM w UNION ALL SELECT scenario, 'combined', 'fills', CAST(fills AS DOUBLE) FROM w)""")
def accounting_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_fills(spark, sf_dir)
    counts = rows.groupBy("scenario").agg(F.count("*").alias("fills"), F.count_if("first").alias("orders"), F.sum(F.when(F.col("role") == "maker", F.col("fee")).otherwise(0.0)).alias("maker_fees"))
    wide = base_of(rows).join(ledger.accounts(rows, BY, ORDER).drop("position", "average"), "scenario").join(counts, "scenario")
    g, f = F.col("gross"), F.col("fees")
    return economics.long_report(wide, BY, {
        "pnl": {"gross": g, "net": g - f}, "inventory": {c: F.col(c) for c in ("longest", "shortest", "mean_abs")},
        "turnover": {"turnover": F.col("turnover"), "per_order": F.col("turnover") / F.col("orders")}, "realized": {"realized": F.col("realized"), "unrealized": g - F.col("realized")},
        "decomposition": {"maker_fees": F.col("maker_fees"), "taker_fees": f - F.col("maker_fees")}, "combined": {"orders": F.col("orders"), "fills": F.col("fills")},
    }).withColumn("value", F.round("value", 2))


@query("a52_cost_base", f"""WITH {FILLS}, {SUMS}, {DRAWDOWN}, {BASE}, o AS (SELECT CAST(o_orderkey AS BIGINT) AS order_id, CAST(o_totalprice AS DOUBLE) AS wanted FROM orders),
  c AS (SELECT scenario, count(*) FILTER (WHERE role = 'maker') AS makers, count(*) FILTER (WHERE role = 'taker') AS takers, count(DISTINCT order_id) AS orders FROM fills GROUP BY scenario),
  r AS (SELECT scenario, avg(least(1.0, done / nullif(wanted, 0))) AS fill_rate FROM (SELECT scenario, order_id, sum(abs(signed * price)) AS done FROM fills GROUP BY scenario, order_id) JOIN o USING (order_id) GROUP BY scenario)
  SELECT scenario, round(fill_rate, 6) AS fill_rate, round(turnover / orders, 2) AS turnover_per_order, round(worst, 2) AS worst_drawdown, CAST(makers AS BIGINT) AS makers, CAST(takers AS BIGINT) AS takers,
  round(coalesce(fees / nullif(turnover, 0), 0) * 10000, 4) AS fee_bps FROM base JOIN dd USING (scenario) JOIN c USING (scenario) JOIN r USING (scenario)""")
def cost_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_fills(spark, sf_dir)
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("order_id"), F.col("o_totalprice").cast("double").alias("wanted"))
    n = tasks(spark, sf_dir, "lineitem")
    each = dealt(rows, n, "order_id").groupBy("scenario", "order_id").agg(F.sum(_notional()).alias("done"), F.count_if(F.col("role") == "maker").alias("makers"), F.count_if(F.col("role") == "taker").alias("takers"))
    done = each.join(dealt(wanted, n, "order_id"), "order_id")
    rate = done.groupBy("scenario").agg(F.avg(F.least(F.lit(1.0), F.try_divide(F.col("done"), F.nullif("wanted", F.lit(0.0))))).alias("fill_rate"))
    counts = each.groupBy("scenario").agg(F.sum("makers").alias("makers"), F.sum("takers").alias("takers"), F.count("*").alias("orders"))
    wide = base_of(rows).join(ledger.drawdown_summary(rows, BY, ORDER), "scenario").join(counts, "scenario").join(rate, "scenario")
    return wide.select(
        "scenario", F.round("fill_rate", 6).alias("fill_rate"), F.round(F.col("turnover") / F.col("orders"), 2).alias("turnover_per_order"), F.round("worst", 2).alias("worst_drawdown"),
        "makers", "takers", F.round(_ratio(F.col("fees"), F.col("turnover")) * 10_000, 4).alias("fee_bps"),
    )


@query("a53_robustness_base", f"""WITH {FILLS}, k AS (SELECT {MODEL} AS model, {LATENCY} AS latency_ms, us // {YEAR_US} AS year, signed, price, fee FROM fills)
  SELECT model, CAST(latency_ms AS BIGINT) AS latency_ms, CAST(year AS BIGINT) AS year, round(-sum(signed * price) + sum(signed) * 1000, 2) AS gross, round(-sum(signed * price) + sum(signed) * 1000 - sum(fee), 2) AS net,
  round(sum(abs(signed * price)), 2) AS turnover, round(sum(signed), 4) AS terminal FROM k GROUP BY model, latency_ms, year""")
def robustness_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("signed") * F.col("price")
    gross = -F.sum(n) + F.sum("signed") * 1000
    by = [_model(), _latency(), F.floor(F.col("us") / YEAR_US).alias("year")]
    return fills(spark, sf_dir).groupBy(*by).agg(F.round(gross, 2).alias("gross"), F.round(gross - F.sum("fee"), 2).alias("net"), F.round(F.sum(F.abs(n)), 2).alias("turnover"), F.round(F.sum("signed"), 4).alias("terminal"))


@query("a57_passive_tradeoff", f"""WITH {FILLS}, s AS (SELECT scenario, avg(CASE WHEN role = 'maker' THEN 1.0 ELSE 0.0 END) AS rate, sum(signed) AS terminal FROM fills GROUP BY scenario)
  SELECT {MODEL} AS model, round(avg(rate), 6) AS mean_rate, round(avg(abs(terminal)), 4) AS mean_abs_terminal FROM s GROUP BY 1""")
def passive_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fills(spark, sf_dir).groupBy("scenario").agg(ranks.share(F.col("role") == "maker").alias("rate"), F.sum("signed").alias("terminal"))
    return s.groupBy(_model()).agg(F.round(F.avg("rate"), 6).alias("mean_rate"), F.round(F.avg(F.abs("terminal")), 4).alias("mean_abs_terminal"))


@query("u07_cost_union", f"""WITH {FILLS}, m AS (SELECT scenario, role, sum(abs(signed * price)) AS turnover, sum(fee) AS fees FROM fills GROUP BY scenario, role)
  SELECT concat('market_', CAST(scenario AS VARCHAR)) AS name, round(turnover, 2) AS turnover, round(fees, 4) AS fees, CAST(NULL AS DOUBLE) AS rebate FROM m WHERE role = 'taker'
  UNION ALL SELECT concat('passive_', CAST(scenario AS VARCHAR)), round(turnover, 2), CAST(NULL AS DOUBLE), round(fees, 4) FROM m WHERE role = 'maker'""")
def cost_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fills(spark, sf_dir).groupBy("scenario", "role").agg(F.round(F.sum(_notional()), 2).alias("turnover"), F.round(F.sum("fee"), 4).alias("amount"))

    def side(role: str, name: str, column: str) -> DataFrame:
        return m.where(F.col("role") == role).select(F.concat(F.lit(f"{name}_"), F.col("scenario").cast("string")).alias("name"), "turnover", F.col("amount").alias(column))

    return side("taker", "market", "fees").unionByName(side("maker", "passive", "rebate"), allowMissingColumns=True)


@query("j13_share_of_group", f"""WITH {FILLS}, o AS (SELECT scenario, order_id, sum(qty) AS q FROM fills GROUP BY scenario, order_id), g AS (SELECT scenario, sum(q) AS total, max(q) AS largest FROM o GROUP BY scenario)
  SELECT o.scenario, o.order_id, round(q / total, 8) AS share, q = largest AS is_largest FROM o LEFT JOIN g USING (scenario)""")
def share_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fills(spark, sf_dir).groupBy("scenario", "order_id").agg(F.sum("qty").alias("q"))
    g = o.groupBy("scenario").agg(F.sum("q").alias("total"), F.max("q").alias("largest"))
    return o.join(g, "scenario", "left").select("scenario", "order_id", F.round(F.col("q") / F.col("total"), 8).alias("share"), (F.col("q") == F.col("largest")).alias("is_largest"))


@query("j18_reconciliation", f"""WITH {FILLS}, k AS (SELECT scenario, role, us // {YEAR_US} AS year, signed > 0 AS buy, price, qty, signed FROM fills),
  a AS (SELECT scenario, role, year, buy, sum(price * qty) AS v FROM k GROUP BY scenario, role, year, buy), b AS (SELECT scenario, role, year, buy, sum(abs(signed) * price) AS v FROM k GROUP BY scenario, role, year, buy)
  SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (WHERE abs(a.v - b.v) > greatest(1e-8, abs(b.v) * 1e-11)) AS BIGINT) AS apart FROM a JOIN b USING (scenario, role, year, buy)""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["scenario", "role", "year", "buy"]
    rows = fills(spark, sf_dir).withColumns({"year": F.floor(F.col("us") / YEAR_US), "buy": F.col("signed") > 0})
    left, right = (rows.groupBy(*keys).agg(F.sum(v).alias("v")) for v in (F.col("price") * F.col("qty"), F.abs("signed") * F.col("price")))
    return economics.reconcile(left, right, keys, "v")


@query("p20_losses_kept", f"""WITH {FILLS}, {BASE} SELECT CAST(count(*) AS BIGINT) AS scenarios, CAST(count(*) FILTER (WHERE gross < 0) AS BIGINT) AS negative, count(*) FILTER (WHERE gross < 0) > 0 AS retained FROM base""")
def losses_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    negative = F.count_if(F.col("gross") < 0)
    return _base(spark, sf_dir).agg(F.count("*").alias("scenarios"), negative.alias("negative"), (negative > 0).alias("retained"))


@query("t02_fill_order", f"""WITH {FILLS}, i AS (SELECT scenario, order_id, us, row_number() OVER (PARTITION BY scenario, order_id ORDER BY {SQL_ORDER}) AS child FROM fills),
  k AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY us, order_id, child) AS place FROM i)
  SELECT scenario, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT (order_id, child)) AS BIGINT) AS duplicates, CAST(sum(place * (child % 3)) AS BIGINT) AS fingerprint FROM k GROUP BY scenario""")
def fill_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = F.row_number().over(Window.partitionBy("scenario", "order_id").orderBy(*ORDER))
    copy = F.row_number().over(Window.partitionBy("scenario", "order_id", "child").orderBy("us"))
    k = fills(spark, sf_dir).withColumn("child", child).withColumn("copy", copy).select("scenario", "order_id", "us", "child", "copy")
    k = scans.running(k, BY, ["us", "order_id", "child"], {"place": F.lit(1)})  # in sessions, so a scenario is many tasks
    return k.groupBy("scenario").agg(F.count("*").alias("n"), F.count_if(F.col("copy") > 1).alias("duplicates"), F.sum(F.col("place") * (F.col("child") % 3)).alias("fingerprint"))


@query("a29_mismatch", f"""WITH {PREDS}, {SIGNAL}, h AS (SELECT day, signal AS desired, coalesce(lag(signal) OVER (PARTITION BY day ORDER BY us, "row"), 0) AS actual FROM sig)
  SELECT day, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN desired <> actual THEN 1.0 ELSE 0.0 END), 6) AS mismatched, round(avg(CASE WHEN desired <> 0 AND actual = 0 THEN 1.0 ELSE 0.0 END), 6) AS missing,
  round(avg(CASE WHEN desired = 0 AND actual <> 0 THEN 1.0 ELSE 0.0 END), 6) AS unwanted FROM h GROUP BY day""")
def mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = F.coalesce(F.lag("signal").over(Window.partitionBy("day").orderBy("us", "row")), F.lit(0))
    d, a = F.col("signal"), F.col("actual")
    rows = _signals(spark, sf_dir).withColumn("actual", actual)
    return _round(rows.groupBy("day").agg(F.count("*").alias("n"), ranks.share(d != a).alias("mismatched"), ranks.share((d != 0) & (a == 0)).alias("missing"), ranks.share((d == 0) & (a != 0)).alias("unwanted")), DAY)
