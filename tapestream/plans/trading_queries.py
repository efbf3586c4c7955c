"""Queries of executions, ledgers and costs over fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapestream.bridge import FILLS, HOUR, TICKS, fills, kept_fills, table, ticks
from tapestream.functions import market
from tapestream.operators import digest, economics, execution, ledger
from tapestream.plans.registry import query
from tapestream.plans.research_queries import _round

ORDER = ["us", "row"]
SQL_ORDER = "us, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
BY = ["scenario"]

DEPTH = """depth AS (SELECT CAST(l_orderkey AS BIGINT) AS order_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_extendedprice AS DOUBLE) / nullif(CAST(l_quantity AS DOUBLE), 0) AS price,
  CAST(l_quantity AS DOUBLE) AS size, 0.6 * sum(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey) AS demand FROM lineitem)"""


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fills(spark, sf_dir).select("order_id", "row", "price", F.col("qty").alias("size"))
    return rows.withColumn("demand", 0.6 * F.sum("size").over(Window.partitionBy("order_id")))


@query("w21_depth_fill", f"""WITH {DEPTH}, c AS (SELECT *, sum(size) OVER (PARTITION BY order_id ORDER BY price, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS u FROM depth),
  f AS (SELECT order_id, price, least(demand, u) - least(demand, u - size) AS fill FROM c)
  SELECT order_id, round(sum(fill), 4) AS filled, round(sum(fill * price) / nullif(sum(fill), 0), 6) AS vwap, CAST(count(*) FILTER (WHERE fill > 0) AS BIGINT) AS levels FROM f GROUP BY order_id""")
def depth_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = execution.consume_depth(_depth(spark, sf_dir), ["order_id"], ["price", "row"], "size", "demand")
    found = each.groupBy("order_id").agg(F.round(F.sum("fill"), 4).alias("filled"), F.round(execution.vwap(F.col("price"), F.col("fill")), 6).alias("vwap"), F.count_if(F.col("fill") > 0).alias("levels"))
    return found


@query("w22_queue_fill", f"""WITH {TICKS}, o AS (SELECT inst, "row" AS id, us AS a, us + {6 * HOUR} AS b, price AS lim FROM ticks),
  p AS (SELECT id, t.us, t."row", CAST(t.qty AS DOUBLE) AS v FROM o JOIN ticks t ON t.inst = o.inst AND t.us > o.a AND t.us <= o.b AND t.side = 'sell' AND t.price <= o.lim),
  c AS (SELECT *, sum(v) OVER (PARTITION BY id ORDER BY us, "row" ROWS UNBOUNDED PRECEDING) AS u FROM p),
  f AS (SELECT *, least(5, greatest(u - 3, 0)) - least(5, greatest(u - v - 3, 0)) AS fill FROM c)
  SELECT CAST(id AS VARCHAR) AS order_id, us AS fill_time, CAST(fill AS DOUBLE) AS quantity FROM f WHERE fill > 0""")
def queue_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    orders = rows.select(
        "inst", F.col("row").cast("string").alias("order_id"), F.lit("BUY").alias("side"), F.col("price").alias("limit_price"), F.lit(5.0).alias("quantity"), F.lit(3.0).alias("queue"),
        F.col("us").alias("arrival"), (F.col("us") + 6 * HOUR).alias("expiry"), F.lit(None).cast("long").alias("cancel"),
    )
    return execution.passive_fills(orders, rows, ["inst"]).select("order_id", "fill_time", "quantity")


@query("r14_markouts", f"""WITH {TICKS}, m AS (SELECT inst, max_by(price, us) AS last FROM ticks GROUP BY inst), a AS (SELECT *, us + {6 * HOUR} AS target FROM ticks)
  SELECT a."row", coalesce(t.price, m.last) AS markout_6h FROM a ASOF LEFT JOIN ticks t ON a.inst = t.inst AND a.target <= t.us JOIN m ON m.inst = a.inst""")
def markouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    out = execution.markouts(rows.select("inst", "us", F.col("row").alias("id")), rows.select("inst", "us", "row", F.col("price").alias("mid")), ["inst"], [6 * HOUR])
    return out.select(F.col("id").alias("row"), F.col(f"mid_{6 * HOUR}").alias("markout_6h"))


SUMS = f"""run AS (SELECT *, sum(signed) OVER w AS position, sum(-signed * price) OVER w AS cash, sum(fee) OVER w AS fees, sum(abs(signed * price)) OVER w AS turnover
  FROM fills WINDOW w AS (PARTITION BY scenario ORDER BY {SQL_ORDER} ROWS UNBOUNDED PRECEDING))"""


@query("w15_ledger_sums", f"""WITH {FILLS}, {SUMS} SELECT scenario, us, order_id, round(position, 2) AS position, round(cash, 2) AS cash, round(fees, 3) AS fees, round(turnover, 2) AS turnover FROM run""")
def ledger_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = ledger.running(kept_fills(spark, sf_dir).select("scenario", "us", "row", "signed", "price", "fee"), BY, ORDER)
    return run.select("scenario", "us", F.col("row.l_orderkey").alias("order_id"), F.round("position", 2).alias("position"), F.round("cash", 2).alias("cash"), F.round("fees", 3).alias("fees"), F.round("turnover", 2).alias("turnover"))


@query("w13_drawdown", f"""WITH {FILLS}, {SUMS}, d AS (SELECT scenario, max(cash) OVER (PARTITION BY scenario ORDER BY {SQL_ORDER} ROWS UNBOUNDED PRECEDING) - cash AS dd FROM run)
  SELECT scenario, round(max(dd), 1) AS worst, round(avg(dd), 1) AS mean FROM d GROUP BY scenario""")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ledger.drawdown_summary(kept_fills(spark, sf_dir), BY, ORDER), BY, 1)


@query("a28_position", f"""WITH {FILLS}, {SUMS} SELECT scenario, round(max(position), 4) AS longest, round(min(position), 4) AS shortest, round(avg(abs(position)), 4) AS mean_abs, round(median(abs(position)), 4) AS median_abs,
  round(quantile_cont(abs(position), 0.95), 4) AS p95_abs, round(avg(CASE WHEN position > 0 THEN 1.0 ELSE 0.0 END), 4) AS long_share, round(avg(CASE WHEN position < 0 THEN 1.0 ELSE 0.0 END), 4) AS short_share FROM run GROUP BY scenario""")
def position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ledger.position_summary(ledger.running(kept_fills(spark, sf_dir), BY, ORDER), BY), BY, 4)


@query("r08_mark_to_market", f"""WITH {FILLS}, m AS (SELECT scenario, unnest(range(min(us), max(us) + 1, {24 * HOUR * 30})) AS us FROM fills GROUP BY scenario)
  SELECT m.scenario, m.us, round(coalesce(sum(signed), 0), 2) AS position, round(coalesce(-sum(signed * price), 0) + coalesce(sum(signed), 0) * 1000, 2) AS gross
  FROM m LEFT JOIN fills f ON f.scenario = m.scenario AND f.us <= m.us GROUP BY m.scenario, m.us""")
def mark_to_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fills(spark, sf_dir)
    span = rows.groupBy("scenario").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    marks = span.select("scenario", F.explode(F.sequence("a", "b", F.lit(24 * HOUR * 30))).alias("us"), F.lit(1000.0).alias("mid"))
    return ledger.mark_to_market(rows, marks, BY, "us", ["row"]).select("scenario", "us", F.round("position", 2).alias("position"), F.round("gross", 2).alias("gross"))


REALIZED = f"""numbered AS (SELECT scenario, signed AS q, price AS p, row_number() OVER (PARTITION BY scenario ORDER BY {SQL_ORDER}) AS k FROM fills),
  z AS (SELECT scenario, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS pos, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS real FROM numbered GROUP BY scenario
    UNION ALL SELECT n.scenario, n.k, CASE WHEN abs(pos + q) < 1e-8 THEN 0 ELSE pos + q END,
      CASE WHEN abs(pos + q) < 1e-8 THEN 0 WHEN abs(pos) < 1e-8 OR (sign(pos) <> sign(q) AND abs(q) > abs(pos) + 1e-8) THEN p WHEN sign(pos) = sign(q) THEN (pos * a + q * p) / (pos + q) ELSE a END,
      real + CASE WHEN abs(pos) < 1e-8 OR sign(pos) = sign(q) THEN 0 ELSE least(abs(pos), abs(q)) * sign(pos) * (p - a) END
    FROM z JOIN numbered n ON n.scenario = z.scenario AND n.k = z.k + 1),
  realized_pnl AS (SELECT scenario, pos, a AS average, real AS realized FROM z WHERE (scenario, k) IN (SELECT (scenario, max(k)) FROM numbered GROUP BY scenario))"""


@query("r07_realized_pnl", f"""WITH RECURSIVE {FILLS}, {REALIZED} SELECT scenario, round(pos, 4) AS position, round(average, 4) AS average, round(realized, 1) AS realized FROM realized_pnl""")
def realized_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.average_cost(kept_fills(spark, sf_dir), BY, ORDER)
    return out.select("scenario", F.round("position", 4).alias("position"), F.round("average", 4).alias("average"), F.round("realized", 1).alias("realized"))


# --- costs

BASE = "base AS (SELECT scenario, -sum(signed * price) + sum(signed) * 1000 AS gross, sum(abs(signed * price)) AS turnover, sum(signed) AS position, sum(fee) AS fees FROM fills GROUP BY scenario)"
GRID = "g AS (SELECT *, gross - turnover * fee_bps / 10000 AS net FROM base, (VALUES (0.0), (0.25), (0.5), (1.0), (5.0)) v(fee_bps))"
FEES = (0.0, 0.25, 0.5, 1.0, 5.0)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_of(fills(spark, sf_dir))


def base_of(rows: DataFrame) -> DataFrame:
    n = F.col("signed") * F.col("price")
    return rows.groupBy("scenario").agg((-F.sum(n) + F.sum("signed") * 1000).alias("gross"), F.sum(F.abs(n)).alias("turnover"), F.sum("signed").alias("position"), F.sum("fee").alias("fees"))


def _fee_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economics.with_grid(_base(spark, sf_dir), "fee_bps", FEES).withColumn("net", economics.net_of_fee(F.col("gross"), F.col("turnover"), F.col("fee_bps")))


@query("j16_fee_grid", f"WITH {FILLS}, {BASE}, {GRID} SELECT scenario, CAST(fee_bps AS DOUBLE) AS fee_bps, round(net, 1) AS net FROM g")
def fee_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fee_grid(spark, sf_dir).select("scenario", "fee_bps", F.round("net", 1).alias("net"))


@query("j15_baseline", f"WITH {FILLS}, {BASE}, {GRID} SELECT a.scenario, CAST(a.fee_bps AS DOUBLE) AS fee_bps, round(a.net - b.net, 1) AS delta FROM g a JOIN g b ON a.scenario = b.scenario AND b.fee_bps = 0")
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economics.against_baseline(_fee_grid(spark, sf_dir), BY, "fee_bps", 0.0, "net").select("scenario", "fee_bps", F.round("delta", 1).alias("delta"))


@query("j14_model_difference", f"""WITH {FILLS}, r AS (SELECT scenario, role, sum(abs(signed * price)) AS v FROM fills GROUP BY scenario, role)
  SELECT scenario, round(max(CASE WHEN role = 'maker' THEN v END) - max(CASE WHEN role = 'taker' THEN v END), 1) AS delta FROM r GROUP BY scenario""")
def model_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fills(spark, sf_dir).groupBy("scenario", "role").agg(F.sum(F.abs(F.col("signed") * F.col("price"))).alias("v"))
    return economics.model_difference(rows, BY, "role", "maker", "taker", "v").select("scenario", F.round("delta", 1).alias("delta"))


@query("a33_rank_wins", f"""WITH {FILLS}, r AS (SELECT order_id, role, CAST(count(*) AS BIGINT) AS v FROM fills GROUP BY order_id, role), b AS (SELECT *, max(v) OVER (PARTITION BY order_id) AS m FROM r),
  w AS (SELECT role, 1.0 / count(*) OVER (PARTITION BY order_id) AS part FROM b WHERE v = m) SELECT role, round(CAST(sum(part) AS DOUBLE), 4) AS wins FROM w GROUP BY role""")
def rank_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fills(spark, sf_dir).groupBy("order_id", "role").agg(F.count("*").alias("v"))
    return _round(economics.rank_wins(rows, ["order_id"], "role", "v"), ["role"], 4)


@query("a35_survival", f"""WITH {FILLS}, {BASE}, {GRID} SELECT scenario, CAST(max(CASE WHEN fee_bps = 0 THEN CAST(net > 0 AS INT) END) AS BIGINT) AS fee_0_00, CAST(max(CASE WHEN fee_bps = 5 THEN CAST(net > 0 AS INT) END) AS BIGINT) AS fee_5_00 FROM g GROUP BY scenario""")
def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(economics.survival(_fee_grid(spark, sf_dir), BY, "fee_bps", (0.0, 5.0), "net"), BY)


@query("a30_role_fees", f"""WITH {FILLS} SELECT scenario, round(sum(CASE WHEN role = 'maker' THEN abs(signed * price) ELSE 0 END), 1) AS maker_turnover, round(sum(CASE WHEN role = 'maker' THEN fee ELSE 0 END), 3) AS maker_fees,
  round(sum(CASE WHEN role = 'taker' THEN abs(signed * price) ELSE 0 END), 1) AS taker_turnover, round(sum(CASE WHEN role = 'taker' THEN fee ELSE 0 END), 3) AS taker_fees, CAST(0 AS BIGINT) AS unknown FROM fills GROUP BY scenario""")
def role_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = economics.role_turnover(fills(spark, sf_dir), BY)
    return out.select("scenario", *[F.round(c, 1 if "turnover" in c else 3).alias(c) for c in ("maker_turnover", "maker_fees", "taker_turnover", "taker_fees")], F.col("unknown").cast("long").alias("unknown"))


@query("a27_vwap", f"WITH {FILLS} SELECT order_id, round(sum(price * qty) / nullif(sum(qty), 0) + 1e-9, 6) AS vwap FROM fills GROUP BY order_id")
def vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(spark, sf_dir).groupBy("order_id").agg(F.round(execution.vwap(F.col("price"), F.col("qty")) + 1e-9, 6).alias("vwap"))


@query("a01_group_summary", f"""WITH {FILLS} SELECT scenario, role, CAST(count(*) AS BIGINT) AS n, round(avg(price), 6) AS mean, round(median(price), 6) AS median, round(min(price), 6) AS low, round(max(price), 6) AS high,
  CAST(count(*) FILTER (WHERE signed < 0) AS BIGINT) AS sells FROM fills GROUP BY scenario, role""")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("price")
    return _round(fills(spark, sf_dir).groupBy("scenario", "role").agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.median(p).alias("median"), F.min(p).alias("low"), F.max(p).alias("high"), F.count_if(F.col("signed") < 0).alias("sells")), ["scenario", "role"])


@query("a31_parent_child", f"""WITH {FILLS}, c AS (SELECT order_id, sum(qty) AS q FROM fills GROUP BY order_id), p AS (SELECT CAST(l_orderkey AS BIGINT) AS order_id, sum(CAST(l_quantity AS DOUBLE)) AS q FROM lineitem GROUP BY l_orderkey)
  SELECT CAST(count(*) AS BIGINT) AS parents, CAST(count(*) FILTER (WHERE abs(c.q - p.q) > 1e-8) AS BIGINT) AS mismatched FROM p JOIN c USING (order_id)""")
def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = fills(spark, sf_dir).groupBy("order_id").agg(F.sum("qty").alias("c"))
    parent = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("order_id")).agg(F.sum(F.col("l_quantity").cast("double")).alias("p"))
    return parent.join(child, "order_id").agg(F.count("*").alias("parents"), F.count_if(F.abs(F.col("c") - F.col("p")) > 1e-8).alias("mismatched"))


@query("j17_orphans", f"""WITH {FILLS} SELECT order_id, CAST(count(*) AS BIGINT) AS n FROM fills f WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = f.order_id AND o.o_orderstatus <> 'F') GROUP BY order_id""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").cast("long").alias("order_id"))
    return execution.orphans(fills(spark, sf_dir), alive).groupBy("order_id").agg(F.count("*").alias("n"))


@query("h22_breakeven", f"""WITH {FILLS}, {BASE} SELECT scenario, CASE WHEN gross >= 0 AND turnover > 0 THEN round(gross / turnover * 10000, 6) END AS breakeven,
  CASE WHEN turnover <= 0 THEN 'NO_TURNOVER' WHEN gross < 0 THEN 'ALREADY_NEGATIVE' ELSE 'DEFINED' END AS status FROM base""")
def breakeven(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, t = F.col("gross"), F.col("turnover")
    return _base(spark, sf_dir).select("scenario", F.round(market.breakeven_bps(g, t), 6).alias("breakeven"), market.breakeven_status(g, t).alias("status"))


@query("h27_stress", f"""WITH {FILLS}, {BASE} SELECT scenario, CAST(s AS DOUBLE) AS shock_bps, round(gross - fees + position * 1000 * s / 10000, 1) AS stressed FROM base, (VALUES (-100.0), (-10.0), (0.0), (10.0), (100.0)) v(s)""")
def stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir).withColumns({"net": F.col("gross") - F.col("fees"), "mid": F.lit(1000.0)})
    return economics.terminal_stress(rows, (-100, -10, 0, 10, 100)).select("scenario", "shock_bps", F.round("stressed", 1).alias("stressed"))


@query("h24_order_ids", """SELECT CAST(o_orderkey AS BIGINT) AS order_id, substring(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus)), 1, 24) AS id FROM orders""")
def order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("order_id"), market.short_id(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus").alias("id"))


@query("u02_detail_and_total", f"""WITH {FILLS}, d AS (SELECT CAST(scenario AS VARCHAR) AS scenario, count(*) AS n, sum(qty) AS qty FROM fills GROUP BY scenario)
  SELECT scenario, CAST(n AS BIGINT) AS n, round(qty, 2) AS qty FROM d UNION ALL SELECT 'ALL', CAST(sum(n) AS BIGINT), round(sum(qty), 2) FROM d""")
def detail_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = fills(spark, sf_dir).groupBy(F.col("scenario").cast("string").alias("scenario")).agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))
    total = each.agg(F.lit("ALL").alias("scenario"), F.sum("n").alias("n"), F.sum("qty").alias("qty"))
    return _round(each.unionByName(total), ["scenario"], 2)


@query("u06_equality", """SELECT CAST((SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)) AS BIGINT) AS only_left, CAST((SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders)) AS BIGINT) AS only_right""")
def equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    sides = a.exceptAll(b).select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(b.exceptAll(a).select(F.lit(0).alias("l"), F.lit(1).alias("r")))
    return sides.agg(F.coalesce(F.sum("l"), F.lit(0)).cast("long").alias("only_left"), F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("only_right"))


CELLS = " || ".join(f"coalesce(octet_length(CAST(CAST({c} AS VARCHAR) AS BLOB)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in ("l_orderkey", "l_linenumber", "l_suppkey"))
WORD_SUMS = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS HUGEINT)) AS s{i}" for i in range(digest.WORDS))
CARRIED = "".join(f", c{i} AS (SELECT *, s{i}{f' + t{i + 1} // 4294967296' if i < digest.WORDS - 1 else ''} AS t{i} FROM {f'c{i + 1}' if i < digest.WORDS - 1 else 'sums'})" for i in reversed(range(digest.WORDS)))
HEX = " || ".join(f"lpad(printf('%x', CAST(t{i} % 4294967296 AS BIGINT)), 8, '0')" for i in range(digest.WORDS))


@query("h23_content_hash", f"""WITH h AS (SELECT l_returnflag, sha256({CELLS}) AS h FROM lineitem), sums AS (SELECT l_returnflag, CAST(count(*) AS BIGINT) AS "rows", {WORD_SUMS} FROM h GROUP BY l_returnflag){CARRIED}
  SELECT l_returnflag, "rows", {HEX} AS digest FROM c0""")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.table_digest(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_suppkey"), ["l_returnflag"])
