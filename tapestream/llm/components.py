"""Connected components by contraction, with DataFrame operations only, and a shortcut in Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import forget, keep


def _rank(node: str, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), node) if turn else F.col(node)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (src, dst); component is its smallest node.

    Each round a node moves to the best-ranked among itself and its neighbours, edges follow
    their ends, and edges within a node go; what is left is a graph smaller by a factor.
    The first rank is the node itself, so stars around their smallest node take one round;
    later ranks are hashes, new in each round, so that no order of ids makes long paths
    slow.  Hubs need no special case: minima are combined before the shuffle, and joins on
    a hub are split as skewed ones.  Null ends are ignored.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    alone = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("head"))
    edges = keep(edges.where("src <> dst").distinct(), "edges")
    moves: list[DataFrame] = []
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("dst", "src"))
        best = both.groupBy("src").agg(F.min_by("dst", _rank("dst", turn)).alias("m"))
        move = best.select(F.col("src").alias("node"), F.when(_rank("m", turn) < _rank("src", turn), F.col("m")).otherwise(F.col("src")).alias("head"))
        move = keep(move, "moves")
        moved = edges.join(move.select(F.col("node").alias("src"), F.col("head").alias("a")), "src")
        moved = moved.join(move.select(F.col("node").alias("dst"), F.col("head").alias("b")), "dst").where("a <> b")
        left = keep(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
        forget(edges)
        edges, turn = left, turn + 1
        moves.append(move)
    if not moves:
        return alone.distinct().withColumnRenamed("head", "component")
    heads = moves[0]
    for move in moves[1:]:
        again = move.select(F.col("node").alias("head"), F.col("head").alias("next"))
        heads = heads.join(again, "head", "left").select("node", F.coalesce("next", "head").alias("head"))
    heads = keep(heads, "heads")
    least = heads.groupBy("head").agg(F.min("node").alias("component"))
    found = heads.join(least, "head").select("node", "component")
    lone = alone.distinct().join(heads.select("node"), "node", "left_anti").withColumnRenamed("head", "component")
    return found.union(lone)


def local_stars(edges: DataFrame, share: int = 100_000) -> DataFrame:
    """Fewer edges (src, dst, both long) with the same components: each task, which has about ``share``
    of them, gives the nodes of its own components their smallest one.  Few edges are settled at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["src", "dst"])

    tasks = max(1, -(-edges.count() // share))
    return edges.select("src", "dst").where("src is not null and dst is not null").repartition(tasks).mapInArrow(run, "src long, dst long")
