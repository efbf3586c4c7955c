"""Market views of the driver's tables, once for Spark and once, as CTEs, for DuckDB.

Times are epoch microseconds without a zone: no session setting changes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapestream.sources.scratch import stored

HOUR = 3_600_000_000
#: Rows that one task sorts or groups by key, about.
TASK_ROWS = 250_000

#: Microseconds of a timestamp without zone, by its own fields.
US = (
    "unix_date(cast({0} as date)) * 86400000000L + (hour({0}) * 3600 + minute({0}) * 60) * 1000000L"
    " + cast(extract(second from {0}) * 1000000 as bigint)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, name: str, times: int = 1) -> int:
    """As many tasks as a table's rows, ``times`` over, make at TASK_ROWS each; its files' footers are counted."""
    return -(-table(spark, sf_dir, name).count() * times // TASK_ROWS)


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows hashed by keys to n tasks, which adaptive execution leaves apart, if that is more than run at once."""
    return rows.repartition(n, *keys) if n > rows.sparkSession.sparkContext.defaultParallelism else rows


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: inst, us, row, price, qty, side."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_type as inst",
        f"{US.format('ts')} as us",
        "event_id as row",
        "value as price",
        "cast(1 + user_id % 7 as bigint) as qty",
        "case when event_type in ('click', 'view') then 'buy' when event_type in ('purchase', 'signup') then 'sell' else 'other' end as side",
    )


TICKS = """ticks AS (
  SELECT event_type AS inst, epoch_us(ts) AS us, event_id AS "row", value AS price, CAST(1 + user_id % 7 AS BIGINT) AS qty,
         CASE WHEN event_type IN ('click','view') THEN 'buy' WHEN event_type IN ('purchase','signup') THEN 'sell' ELSE 'other' END AS side
  FROM events)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bid and offer: inst, us, row, mid, bid, ask, bid_sz, ask_sz."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(user_id % 5 as bigint) as inst",
        f"{US.format('ts')} as us",
        "event_id as row",
        "value as mid",
        "value - 0.5D as bid",
        "value + 0.5D as ask",
        "cast(1 + event_id % 9 as bigint) as bid_sz",
        "cast(1 + event_id % 7 as bigint) as ask_sz",
    )


QUOTES = """quotes AS (
  SELECT CAST(user_id % 5 AS BIGINT) AS inst, epoch_us(ts) AS us, event_id AS "row", value AS mid, value - 0.5 AS bid, value + 0.5 AS ask,
         CAST(1 + event_id % 9 AS BIGINT) AS bid_sz, CAST(1 + event_id % 7 AS BIGINT) AS ask_sz
  FROM events)"""


def grid(spark: SparkSession, sf_dir: str, step: int = HOUR) -> DataFrame:
    """Fixed clock of each instrument of ticks, from its first tick's own time."""
    span = ticks(spark, sf_dir).groupBy("inst").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return span.select("inst", F.explode(F.sequence("a", "b", F.lit(step))).alias("us"))


GRID = """grid AS (
  SELECT inst, unnest(range(min(us), max(us) + 1, 3600000000)) AS us FROM ticks GROUP BY inst)"""


def book_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level changes: inst, side, price, qty (0 deletes), us, and row, a total order within the instrument."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey % 10 as bigint) as inst",
        "case when l_linestatus = 'O' then 'bid' else 'ask' end as side",
        "cast(case when l_linestatus = 'O' then 100 - l_linenumber else 100 + l_linenumber end as bigint) as price",
        "cast(case when l_quantity <= 5 then 0 else l_quantity end as double) as qty",
        f"{US.format('l_shipdate')} as us",
        "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as row",
        "l_tax = 0.08D as snapshot",
    )


BOOK = """book AS (
  SELECT CAST(l_suppkey % 10 AS BIGINT) AS inst, CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side,
         CAST(CASE WHEN l_linestatus = 'O' THEN 100 - l_linenumber ELSE 100 + l_linenumber END AS BIGINT) AS price,
         CAST(CASE WHEN l_quantity <= 5 THEN 0 ELSE l_quantity END AS DOUBLE) AS qty, epoch_us(l_shipdate) AS us,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_tax AS DOUBLE) = 0.08 AS snapshot
  FROM lineitem)"""
BOOK_ORDER = "us, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions: scenario, order_id, us, row, signed, price, qty, fee, role."""
    return _as_fills(_executed(spark, sf_dir))


def kept_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fills joined once and stored, for queries that pass over them several times; first: whether a row is its scenario's first of an order.

    What is stored are the lines' own columns, from which the others are computed when they are read.
    The rows of an order are together after the join, so ``first`` takes no shuffle, and to count orders is to count it.
    """
    rank = F.row_number().over(Window.partitionBy("l_orderkey", F.expr("l_suppkey % 10")).orderBy("l_linenumber"))
    return _as_fills(stored(_executed(spark, sf_dir).withColumn("first", rank == 1), "fills"), "first")


def _executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tasks(spark, sf_dir, "lineitem")
    lines, orders = dealt(table(spark, sf_dir, "lineitem"), n, "l_orderkey"), dealt(table(spark, sf_dir, "orders"), n, "o_orderkey")
    names = ("orderkey", "linenumber", "partkey", "suppkey", "quantity", "extendedprice", "discount", "returnflag", "linestatus", "shipdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(*[f"l_{c}" for c in names])


def _as_fills(lines: DataFrame, *more: str) -> DataFrame:
    return lines.selectExpr(
        "cast(l_suppkey % 10 as bigint) as scenario",
        "cast(l_orderkey as bigint) as order_id",
        f"{US.format('l_shipdate')} as us",
        "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as row",
        "cast(case when l_returnflag = 'R' then -l_quantity else l_quantity end as double) as signed",
        "try_divide(cast(l_extendedprice as double), cast(l_quantity as double)) as price",
        "cast(l_quantity as double) as qty",
        "cast(l_extendedprice as double) * cast(l_discount as double) / 10000D as fee",
        "case when l_linestatus = 'O' then 'maker' else 'taker' end as role",
        *more,
    )


FILLS = """fills AS (
  SELECT CAST(l_suppkey % 10 AS BIGINT) AS scenario, CAST(l_orderkey AS BIGINT) AS order_id, epoch_us(l_shipdate) AS us,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS DOUBLE) AS signed,
         CAST(l_extendedprice AS DOUBLE) / nullif(CAST(l_quantity AS DOUBLE), 0) AS price, CAST(l_quantity AS DOUBLE) AS qty,
         CAST(l_extendedprice AS DOUBLE) * CAST(l_discount AS DOUBLE) / 10000 AS fee,
         CASE WHEN l_linestatus = 'O' THEN 'maker' ELSE 'taker' END AS role
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and outcomes: day, row, x, y (the user's next value; null at the end)."""
    return dealt(table(spark, sf_dir, "events"), tasks(spark, sf_dir, "events"), "user_id").selectExpr(
        "cast(unix_date(cast(ts as date)) as bigint) as day",
        "event_id as row",
        "user_id",
        f"{US.format('ts')} as us",
        "value as x",
        f"lead(value) over (partition by user_id order by {US.format('ts')}, event_id) as y",
    )


PREDS = """preds AS (
  SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, event_id AS "row", user_id, epoch_us(ts) AS us, value AS x,
         lead(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS y
  FROM events)"""
