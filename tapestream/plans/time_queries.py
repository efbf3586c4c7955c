"""Queries over time: trailing windows, as-of and forward lookups, quality, books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapestream.bridge import BOOK, BOOK_ORDER, GRID, HOUR, QUOTES, TICKS, book_updates, grid, quotes, table, ticks
from tapestream.functions import market
from tapestream.operators import asof as lookups
from tapestream.operators import book, quality, scans, trailing
from tapestream.plans.registry import query

BACK = "RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
BOOK_KEYS = ["us", "row"]


@query("w02_trade_window", f"""WITH {TICKS} SELECT "row",
  CAST(sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) OVER w AS BIGINT) AS buy_volume,
  CAST(sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) OVER w AS BIGINT) AS sell_volume,
  round(sum(CASE WHEN side = 'buy' THEN price * qty ELSE 0 END) OVER w, 4) AS buy_notional,
  CAST(count(*) OVER w AS BIGINT) AS trade_count,
  CAST(sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) OVER w AS BIGINT) AS signed_volume,
  round(CAST(sum(CASE WHEN side = 'buy' THEN qty WHEN side = 'sell' THEN -qty ELSE 0 END) OVER w AS DOUBLE)
    / nullif(CAST(sum(CASE WHEN side IN ('buy','sell') THEN qty ELSE 0 END) OVER w AS DOUBLE), 0), 6) AS imbalance
  FROM ticks WINDOW w AS (PARTITION BY inst ORDER BY us {BACK.format(HOUR - 1)})""")  # fmt: skip
def trade_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trailing.trailing(ticks(spark, sf_dir), ["inst"], "us", {"1h": HOUR}, trailing.trade_sums())
    buy, sell = F.col("buy_volume_1h"), F.col("sell_volume_1h")
    return out.select(
        "row", buy.cast("long").alias("buy_volume"), sell.cast("long").alias("sell_volume"), F.round("buy_notional_1h", 4).alias("buy_notional"),
        F.col("trade_count_1h").alias("trade_count"), F.col("signed_volume_1h").cast("long").alias("signed_volume"), F.round(market.imbalance(buy, sell), 6).alias("imbalance"),
    )


OFI = """ofi AS (SELECT *, CASE WHEN pb IS NULL THEN 0 ELSE
    (CASE WHEN bid >= pb THEN bid_sz ELSE 0 END) - (CASE WHEN bid <= pb THEN pbs ELSE 0 END)
  - (CASE WHEN ask <= pa THEN ask_sz ELSE 0 END) + (CASE WHEN ask >= pa THEN pas ELSE 0 END) END AS ofi
  FROM (SELECT *, lag(bid) OVER o AS pb, lag(bid_sz) OVER o AS pbs, lag(ask) OVER o AS pa, lag(ask_sz) OVER o AS pas
        FROM quotes WINDOW o AS (PARTITION BY inst ORDER BY us, "row")))"""


def with_ofi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.with_ofi(quotes(spark, sf_dir), ["inst"], ["us", "row"]).withColumn("ofi", F.col("ofi").cast("long"))


@query("w19_ofi_event", f"""WITH {QUOTES}, {OFI} SELECT "row", CAST(ofi AS BIGINT) AS ofi FROM ofi""")
def ofi_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ofi(spark, sf_dir).select("row", "ofi")


@query("w01_ofi_window", f"""WITH {QUOTES}, {OFI} SELECT "row", CAST(sum(ofi) OVER a AS BIGINT) AS ofi_1h, CAST(count(*) OVER a AS BIGINT) AS n_1h,
  CAST(sum(ofi) OVER b AS BIGINT) AS ofi_6h, CAST(count(*) OVER b AS BIGINT) AS n_6h
  FROM ofi WINDOW a AS (PARTITION BY inst ORDER BY us {BACK.format(HOUR - 1)}), b AS (PARTITION BY inst ORDER BY us {BACK.format(6 * HOUR - 1)})""")
def ofi_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.trailing(with_ofi(spark, sf_dir), ["inst"], "us", {"1h": HOUR, "6h": 6 * HOUR}, {"ofi": F.sum("ofi"), "n": F.count("ofi")}).select("row", "ofi_1h", "n_1h", "ofi_6h", "n_6h")


@query("r04_feature_probes", f"""WITH {TICKS}, {GRID} SELECT g.inst, g.us, CAST(count(t.qty) AS BIGINT) AS n_6h, CAST(coalesce(sum(t.qty), 0) AS BIGINT) AS volume_6h
  FROM grid g LEFT JOIN ticks t ON t.inst = g.inst AND t.us > g.us - {6 * HOUR} AND t.us <= g.us GROUP BY g.inst, g.us""")
def feature_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trailing.trailing(ticks(spark, sf_dir), ["inst"], "us", {"6h": 6 * HOUR}, {"n": F.count("qty"), "volume": F.sum("qty")}, probes=grid(spark, sf_dir))
    return found.select("inst", "us", "n_6h", F.coalesce("volume_6h", F.lit(0)).cast("long").alias("volume_6h"))


@query("w03_realized_vol", f"""WITH {TICKS}, r AS (SELECT *, CASE WHEN price > 0 AND before > 0 THEN ln(price / before) END AS ret FROM (SELECT *, lag(price) OVER (PARTITION BY inst ORDER BY us, "row") AS before FROM ticks))
  SELECT "row", CASE WHEN count(ret) OVER w > 0 THEN round(sqrt(sum(ret * ret) OVER w), 6) END AS vol_24h
  FROM r WINDOW w AS (PARTITION BY inst ORDER BY us {BACK.format(24 * HOUR - 1)})""")
def realized_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.previous(ticks(spark, sf_dir), ["inst"], ["us", "row"], {"before": "price"})
    rows = rows.withColumn("ret", market.log_return(F.col("price"), F.col("before")))
    out = trailing.trailing(rows, ["inst"], "us", {"24h": 24 * HOUR}, {"s": F.sum(F.col("ret") * F.col("ret")), "n": F.count("ret")})
    return out.select("row", F.when(F.col("n_24h") > 0, F.round(F.sqrt(F.greatest("s_24h", F.lit(0.0))), 6)).alias("vol_24h"))


@query("h01_state_features", f"""WITH {QUOTES} SELECT "row", round(mid, 6) AS mid, round((ask - bid) * 10000 / nullif((bid + ask) / 2, 0), 6) AS spread_bps,
  round(CAST(bid_sz - ask_sz AS DOUBLE) / (bid_sz + ask_sz), 6) AS qi, round((ask * bid_sz + bid * ask_sz) / CAST(bid_sz + ask_sz AS DOUBLE), 6) AS microprice FROM quotes""")
def state_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, a, bs, az = (F.col(c) for c in ("bid", "ask", "bid_sz", "ask_sz"))
    return quotes(spark, sf_dir).select(
        "row", F.round(market.mid(b, a), 6).alias("mid"), F.round(market.spread_bps(b, a), 6).alias("spread_bps"),
        F.round(market.imbalance(bs, az), 6).alias("qi"), F.round(market.microprice(b, bs, a, az), 6).alias("microprice"),
    )


@query("j01_asof_backward", f"""WITH {TICKS}, {GRID} SELECT g.inst, g.us, t.us AS at, t.price FROM grid g ASOF LEFT JOIN ticks t ON g.inst = t.inst AND g.us >= t.us""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.asof(grid(spark, sf_dir), ticks(spark, sf_dir), ["inst"], "us", ["price"], "row")


@query("r03_fixed_clock", f"""WITH {TICKS}, {GRID} SELECT g.inst, g.us, CASE WHEN ok THEN "at" END AS "at", CASE WHEN ok THEN price END AS price, CASE WHEN ok THEN qty END AS qty, ok AS is_available,
  CASE WHEN "at" IS NULL THEN 'no_prior_state' WHEN NOT ok THEN 'stale_state' END AS unavailable_reason
  FROM (SELECT g.inst, g.us, t.us AS "at", t.price, t.qty, coalesce(g.us - t.us <= {2 * HOUR}, false) AS ok FROM grid g ASOF LEFT JOIN ticks t ON g.inst = t.inst AND g.us >= t.us) g""")
def fixed_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.fixed_clock(grid(spark, sf_dir), ticks(spark, sf_dir), ["inst"], "us", ["price", "qty"], "row", 2 * HOUR)


@query("j05_momentum", f"""WITH {TICKS}, a AS (SELECT *, us - {6 * HOUR} AS then_us FROM ticks) SELECT a."row", round(a.price - t.price, 6) AS momentum_6h
  FROM a ASOF LEFT JOIN ticks t ON a.inst = t.inst AND a.then_us >= t.us""")
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    probes = rows.select("inst", (F.col("us") - 6 * HOUR).alias("us"), F.col("row").alias("id"), F.col("price").alias("now"))
    found = lookups.asof(probes, rows, ["inst"], "us", ["price"], "row")
    return found.select(F.col("id").alias("row"), F.round(F.col("now") - F.col("price"), 6).alias("momentum_6h"))


LABELS = f"""lab AS (SELECT a."row", a.us, a.price, CASE WHEN t.us - a.target <= {HOUR} THEN t.price END AS future, CASE WHEN t.us - a.target <= {HOUR} THEN t.us END AS "at"
  FROM (SELECT *, us + {HOUR} AS target FROM ticks) a ASOF LEFT JOIN ticks t ON a.inst = t.inst AND a.target <= t.us)"""


@query("j03_forward_lookup", f"""WITH {TICKS}, {LABELS} SELECT "row", "at", future FROM lab""")
def forward_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("row", "at", "future")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    probes = rows.select("inst", (F.col("us") + HOUR).alias("us"), F.col("row").alias("id"), F.col("price").alias("now"))
    found = lookups.asof(probes, rows, ["inst"], "us", ["price"], "row", direction="forward", tolerance=HOUR)
    return found.select(F.col("id").alias("row"), (F.col("us") - HOUR).alias("us"), "now", "at", F.col("price").alias("future"))


@query("r06_labels", f"""WITH {TICKS}, {LABELS} SELECT "row", round(ret, 6) AS ret, CASE WHEN ret > 0.5 THEN 'UP' WHEN ret < -0.5 THEN 'DOWN' WHEN ret IS NOT NULL THEN 'FLAT' END AS direction,
  round((future - price) / nullif(price, 0) * 10000, 4) AS move_bps, CAST(round_even(("at" - us) / 1000.0, 0) AS BIGINT) AS delay_ms
  FROM (SELECT *, CASE WHEN future > 0 AND price > 0 THEN ln(future / price) END AS ret FROM lab)""")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ret = market.log_return(F.col("future"), F.col("now"))
    return _labels(spark, sf_dir).select(
        "row", F.round(ret, 6).alias("ret"), market.direction(ret, 5000).alias("direction"), F.round(F.try_divide(F.col("future") - F.col("now"), F.col("now")) * 10_000, 4).alias("move_bps"),
        market.elapsed_ms(F.col("us"), F.col("at")).alias("delay_ms"),
    )


@query("j04_next_change", f"""WITH {QUOTES}, s AS (SELECT inst, us, "row", CAST(floor(mid / 60) AS BIGINT) AS v FROM quotes)
  SELECT a."row", CASE WHEN b.us - a.us <= {24 * HOUR} THEN b.us END AS change_at, CASE WHEN b.us - a.us <= {24 * HOUR} THEN CASE WHEN b.v > a.v THEN 1 ELSE -1 END END AS change_direction
  FROM s a LEFT JOIN LATERAL (SELECT us, v FROM s c WHERE c.inst = a.inst AND c.us > a.us AND c.v <> a.v ORDER BY us LIMIT 1) b ON true""")
def next_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotes(spark, sf_dir).select("inst", "us", "row", F.floor(F.col("mid") / 60).cast("long").alias("v"))
    return lookups.next_change(rows, ["inst"], "us", "v", "row", 24 * HOUR).select("row", "change_at", "change_direction")


@query("j09_interval_join", f"""WITH {TICKS}, o AS (SELECT inst, "row" AS id, us AS a, us + {6 * HOUR} AS b FROM ticks)
  SELECT id, CAST(count(*) AS BIGINT) AS n, CAST(sum(qty) AS BIGINT) AS volume FROM o JOIN ticks t ON t.inst = o.inst AND t.us > o.a AND t.us <= o.b GROUP BY id""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    spans = rows.select("inst", F.col("row").alias("id"), F.col("us").alias("a"), (F.col("us") + 6 * HOUR).alias("b"))
    found = scans.interval_sums(spans, rows, ["inst"], "a", "b", "us", {"n": F.lit(1), "volume": F.col("qty")})
    return found.where("n > 0").select("id", "n", F.col("volume").cast("long").alias("volume"))


# --- quality


@query("p09_price_size_issues", f"""WITH {TICKS} SELECT rule, severity, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'invalid_price' AS rule, 'ERROR' AS severity FROM ticks WHERE price - 40 <= 0 UNION ALL SELECT 'extreme_size', 'WARNING' FROM ticks WHERE qty > 6
  UNION ALL SELECT 'negative_quantity', 'ERROR' FROM ticks WHERE qty - 2 < 0 ) GROUP BY rule, severity""")
def price_size_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    rules = quality.price_size_rules((F.col("price") - 40).cast("string"), F.col("qty").cast("string"), 6)
    rules["negative_quantity"] = (quality.ERROR, F.col("qty") - 2 < 0)
    return quality.issues(rows, ["row"], rules).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("p10_book_state_issues", f"""WITH {QUOTES} SELECT "row", CASE WHEN bid + bid_sz > ask + ask_sz THEN 'crossed_book' ELSE 'locked_book' END AS rule,
  CASE WHEN bid + bid_sz > ask + ask_sz THEN 'ERROR' ELSE 'WARNING' END AS severity FROM quotes WHERE bid + bid_sz >= ask + ask_sz""")
def book_state_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.book_rules(F.col("bid") + F.col("bid_sz"), F.col("ask") + F.col("ask_sz"))
    return quality.issues(quotes(spark, sf_dir), ["row"], rules)


@query("w17_sequence", f"""WITH {QUOTES}, s AS (SELECT "row", us, CASE WHEN "row" % 13 = 0 THEN NULL ELSE "row" // 3 + CASE WHEN "row" % 50 = 1 THEN 9 ELSE 0 END END AS q FROM quotes),
  p AS (SELECT *, last_value(q IGNORE NULLS) OVER (ORDER BY us, "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s)
  SELECT "row", CASE WHEN q = b THEN 'repeated_sequence' WHEN q < b THEN 'out_of_order_sequence' ELSE 'sequence_gap' END AS rule FROM p WHERE q = b OR q < b OR q > b + 1""")
def sequence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.when(F.col("row") % 13 != 0, F.floor(F.col("row") / 3) + F.when(F.col("row") % 50 == 1, 9).otherwise(0))
    rows = quotes(spark, sf_dir).select(F.lit("one").alias("feed"), "us", "row", seq.alias("q"))
    rows = scans.last_known(rows, ["feed"], ["us", "row"], "b", F.col("q"), inclusive=False)  # sessions, so the one feed is many tasks
    return quality.issues(rows, ["row"], quality.sequence_rules(F.col("q"), F.col("b"))).select("row", "rule")


@query("w18_stale", f"""WITH {QUOTES}, s AS (SELECT inst, us, "row", CAST(floor(mid / 60) AS BIGINT) AS v FROM quotes),
  c AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER (PARTITION BY inst ORDER BY us, "row") THEN 0 ELSE 1 END AS d FROM s),
  g AS (SELECT *, sum(d) OVER (PARTITION BY inst ORDER BY us, "row") AS run FROM c), m AS (SELECT *, min(us) OVER (PARTITION BY inst, run) AS since FROM g)
  SELECT inst, since, CAST(min(us) AS BIGINT) AS us FROM m WHERE us - since > {6 * HOUR} GROUP BY inst, run, since""")
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotes(spark, sf_dir).select("inst", "us", "row", F.floor(F.col("mid") / 60).cast("long").alias("v"))
    return quality.stale(rows, ["inst"], ["us", "row"], "us", ["v"], 6 * HOUR).select("inst", "since", "us")


@query("u03_duplicates", """SELECT l_orderkey, l_linenumber, CAST(k AS BIGINT) AS copy, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k > 1
  GROUP BY l_orderkey, l_linenumber, k""")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return found.groupBy("l_orderkey", "l_linenumber", F.col("copy").cast("long").alias("copy")).agg(F.count("*").alias("n"))


# --- books

FINAL = f"""final AS (SELECT inst, side, price, qty FROM (SELECT *, row_number() OVER (PARTITION BY inst, side, price ORDER BY us DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM book) WHERE k = 1 AND qty > 0)"""


@query("r01_book_final", f"""WITH {BOOK}, {FINAL} SELECT inst, side, price, qty FROM final""")
def book_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.final_levels(book_updates(spark, sf_dir), ["inst"], BOOK_KEYS)


@query("t03_top_levels", f"""WITH {BOOK}, {FINAL} SELECT inst, side, price, qty, CAST(k AS BIGINT) AS level FROM (
  SELECT *, row_number() OVER (PARTITION BY inst, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS k FROM final) WHERE k <= 3""")
def top_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.top_levels(book_final(spark, sf_dir), ["inst"], 3).withColumn("level", F.col("level").cast("long"))


@query("w16_book_actions", f"""WITH {BOOK}, a AS (SELECT *, coalesce(lag(qty) OVER (PARTITION BY inst, side, price ORDER BY {BOOK_ORDER}), 0) AS p FROM book)
  SELECT inst, CASE WHEN qty > 0 AND p > 0 THEN 'update' WHEN qty > 0 THEN 'insert' WHEN p > 0 THEN 'delete' ELSE 'noop' END AS action, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY ALL""")
def book_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.actions(book_updates(spark, sf_dir), ["inst"], BOOK_KEYS).groupBy("inst", "action").agg(F.count("*").alias("n"))


STATE_COLUMNS = ", ".join(f"max(CASE WHEN side = '{s}' AND k = {i} THEN {v} END) AS {s}_{w}_{i}" for s in ("bid", "ask") for i in range(1, 6) for w, v in (("px", "CAST(price AS DOUBLE)"), ("sz", "qty")))


@query("r02_event_states", f"""WITH {BOOK}, g AS (SELECT inst, us, bool_or(snapshot) AS snap FROM book GROUP BY inst, us), gs AS (SELECT inst, us, max(CASE WHEN snap THEN us END) OVER (PARTITION BY inst ORDER BY us) AS since FROM g),
  l AS (SELECT DISTINCT inst, side, price FROM book), u AS (SELECT inst, side, price, us, qty FROM (SELECT *, row_number() OVER (PARTITION BY inst, side, price, us ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS j FROM book) WHERE j = 1),
  p AS (SELECT gs.inst, gs.us, gs.since, l.side, l.price FROM gs JOIN l USING (inst)), s AS (SELECT p.inst, p.us, p.side, p.price, u.qty FROM p ASOF JOIN u ON u.inst = p.inst AND u.side = p.side AND u.price = p.price AND p.us >= u.us WHERE u.qty > 0 AND u.us >= coalesce(p.since, u.us)),
  r AS (SELECT *, row_number() OVER (PARTITION BY inst, us, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS k FROM s)
  SELECT gs.inst, gs.us, 'ok' AS status, {STATE_COLUMNS} FROM gs LEFT JOIN r USING (inst, us) GROUP BY gs.inst, gs.us""")
def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book after each day's updates; a stateful fold, in sessions of 90 days. Bids are below 100 and asks above, so none crosses."""
    return book.replay(book_updates(spark, sf_dir), ["inst"], "us", BOOK_KEYS, 5, need_snapshot=False, session=90 * 24 * HOUR)
