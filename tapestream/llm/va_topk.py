"""Exact top-k by inner product over a vector-approximation file.

Components become integers, floor(scale * x).  A cell grid with ``cells`` steps per
dimension approximates every vector by one byte a component; blocks of such cells are
scanned against blocks of queries, and the cell's sides bound each score from both sides.
The k-th best lower bound of any block is a score that surely exists, so only vectors whose
upper bound reaches the best of these are left.  Each block of cells goes to one task and
stays there, and the blocks of queries come to it one after another.  Their exact vectors are fetched in the order
of their upper bounds, a few of each query in the first round and more in later ones, until
no vector is left whose bound reaches the k-th score.

Equal vectors: a query passes over its own row alone, so only the k + 1 first rows, by id, of
each distinct vector can be in a result, and larger families are cut to these before anything
is compared; this drops no result.  Rows are numbered, and bounds go back to the row they are of.

Defined results: vectors null, empty, or holding null or non-finite components take no part,
nor do rows without id; shorter vectors count as ending in zeros; each row is a candidate
and, if its id is divisible, a query of its own, also rows of one id with equal vectors or
different ones; ties go to the smaller id; a query with fewer candidates gets all; components and
scores beyond a long are held at its ends; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

BOUNDS = "query long, floor_score double, row array<long>, ceiling array<double>"
#: Rows of a block of cells: of small tables, and at most; and cells compared with a block of queries at a time.
LEAST_BLOCK, MOST_BLOCK, AT_ONCE = 4096, 65_536, 4096


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) of the rows that take part; v is an array of long."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("e") > 0) & finite)
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _grid(exact: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value and cell size of each dimension; a row per dimension comes back."""
    sides = exact.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("d").toPandas()
    low = np.minimum(sides["low"].to_numpy(), 0.0)  # shorter vectors end in zeros
    high = np.maximum(sides["high"].to_numpy(), 0.0)
    return low, np.maximum(1, np.ceil((high - low + 1) / cells))


def _packed(rows: DataFrame, name: str, blocks: int, low: np.ndarray, step: np.ndarray, approximate: bool) -> DataFrame:
    """(name, rows, data): rows dealt by hash into blocks; data is cells of one byte, or the vectors."""
    width = len(low)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        m = _matrix(table.column("v"), width)
        data = ((m - low) // step).astype(np.uint8) if approximate else m
        return pa.table({name: [key[0].as_py()], "rows": [table.column("row").to_numpy().tobytes()], "data": [data.tobytes()]}, pa.schema([(name, pa.int32()), ("rows", pa.binary()), ("data", pa.binary())]))

    dealt = rows.select("row", "v").withColumn(name, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return dealt.groupBy(name).applyInArrow(pack, f"{name} int, rows binary, data binary")


def _bounds(met: DataFrame, k: int, low: np.ndarray, step: np.ndarray) -> DataFrame:
    """Per query and block of cells: the k-th best lower bound, and what may reach it.

    met: of each block (cb) first its cells (qb = -1), then the blocks of queries.
    """
    width, largest = len(low), np.maximum(np.abs(low), np.abs(low + step * 256))

    def compare(q_rows: np.ndarray, q: np.ndarray, c_rows: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        size = np.abs(q) @ largest  # sums below 2^52 are exact
        slack = np.where(size < 2.0**52, 0.0, size * width * 2.0**-50)[:, None]
        best = np.full((len(q), k), -np.inf)  # the k best lower bounds so far
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(c_rows), AT_ONCE):
            rows, least = c_rows[at : at + AT_ONCE], low + cells[at : at + AT_ONCE] * step
            most = least + step - 1
            ceiling, floor_ = up @ most.T + down @ least.T + slack, up @ least.T + down @ most.T - slack
            own = q_rows[:, None] == rows[None, :]
            ceiling[own] = floor_[own] = -np.inf
            both = np.concatenate([best, floor_], axis=1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            which = np.nonzero((ceiling >= best.min(1)[:, None]) & ~own)
            found.append((which[0], rows[which[1]], ceiling[which]))
        sure = best.min(1)
        query, row, ceiling = map(np.concatenate, zip(*found))
        left = ceiling >= sure[query]
        query, row, ceiling = query[left], row[left], ceiling[left]
        order = np.argsort(query, kind="stable")
        cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(query, minlength=len(q)))]), pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(x[order], t)) for x, t in ((row, pa.int64()), (ceiling, pa.float64()))]
        return pa.record_batch([pa.array(q_rows), pa.array(sure), *lists], ["query", "floor_score", "row", "ceiling"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = c_rows = cells = None
        for batch in batches:
            for i in range(batch.num_rows):
                cb, qb, rows, data = (batch.column(c)[i].as_py() for c in ("cb", "qb", "rows", "data"))
                if qb < 0:
                    at, c_rows, cells = cb, np.frombuffer(rows, np.int64), np.frombuffer(data, np.uint8).reshape(-1, width)
                elif cb == at:  # a hash may leave a block without cells
                    yield compare(np.frombuffer(rows, np.int64), np.frombuffer(data, np.float64).reshape(-1, width), c_rows, cells)

    return met.mapInArrow(run, BOUNDS)


def _scores(rows: DataFrame) -> DataFrame:
    """query, vec_id and exact score of rows (query, vec_id, q, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, v = batch.column(2), batch.column(3)
            width = int(max(np.diff(x.offsets.to_numpy()).max(initial=0) for x in (q, v)))
            a, b = _matrix(q, width), _matrix(v, width)
            scores = np.zeros(batch.num_rows, np.int64)
            exact = (np.abs(a) * np.abs(b)).sum(1) < 2.0**52
            scores[exact] = (a[exact] * b[exact]).sum(1)
            for i in np.flatnonzero(~exact).tolist():
                product = sum(x * y for x, y in zip(q[i].as_py(), v[i].as_py()))
                scores[i] = max(-(2**63), min(2**63 - 1, product))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores)], ["query", "vec_id", "score"])

    return rows.select("query", "vec_id", "q", "v").mapInArrow(run, "query long, vec_id long, score long")


def _read_in_order(left: DataFrame, candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query's survivors (query, row, ceiling), whose vectors are fetched while their ceilings can still reach."""
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    left = keep(left.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("ceiling").desc(), "row"))), "survivors")
    asked, best, upto = queries.select(F.col("row").alias("query"), F.col("v").alias("q")), None, 4 * k
    while best is None or not left.isEmpty():
        scored = _scores(left.where(F.col("place") <= upto).select("query", "row").join(candidates, "row").join(asked, "query"))
        best = scored if best is None else best.unionByName(scored)
        best = keep(best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank"), "best")
        sure = best.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        rest = left.where(F.col("place") > upto).join(sure, "query", "left")
        left = keep(rest.where(F.col("kth").isNull() | (F.col("ceiling") >= F.col("kth"))).select("query", "row", "ceiling", "place"), "survivors")
        upto *= 16
    return best.withColumn("rank", F.row_number().over(ranked))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, cells: int = 64, query_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id and score of the k best for each row whose id is divisible by ``every``."""
    exact = keep(integer_vectors(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    width = exact.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return exact.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    low, step = _grid(exact, cells)
    family = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    candidates = keep(exact.withColumn("_n", family).where(F.col("_n") <= k + 1).select("vec_id", "v", "row"), "candidates")
    queries = exact.where(F.col("vec_id") % every == 0)
    n_queries, n = -(-queries.count() // query_block), candidates.count()
    n_blocks = max(-(-n // MOST_BLOCK), min(-(-n // LEAST_BLOCK), 64))
    stored = _packed(candidates, "cb", n_blocks, low, step, True).withColumn("qb", F.lit(-1))
    asked = _packed(queries, "qb", max(1, n_queries), low, step, False).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    met = stored.unionByName(asked).repartition(n_blocks, "cb").sortWithinPartitions("cb", "qb")
    found = keep(_bounds(met, k, low, step), "bounds")
    sure = found.groupBy("query").agg(F.max("floor_score").alias("sure"))
    left = found.select("query", F.explode(F.arrays_zip("row", "ceiling")).alias("x")).join(sure, "query").where(F.col("x.ceiling") >= F.col("sure"))
    best = _read_in_order(left.select("query", F.col("x.row").alias("row"), F.col("x.ceiling").alias("ceiling")), candidates, queries, k)
    return best.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
