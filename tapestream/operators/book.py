"""Order books from level updates: actions, final states, and the state after every group."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapestream.operators.ledger import runs

LEVEL = ["side", "price"]


def with_epochs(updates: DataFrame, by: Sequence[str], group: str, order: Sequence[str]) -> DataFrame:
    """updates with epoch, which rises at each group that holds a snapshot row; rows before the first are epoch 0."""
    flags = updates.withColumn("_snap", F.max(F.col("snapshot").cast("int")).over(Window.partitionBy(*by, group)))
    first = F.row_number().over(Window.partitionBy(*by, group).orderBy(*order)) == 1
    flags = flags.withColumn("_new", F.when(first, F.col("_snap")).otherwise(0))
    seen = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return flags.withColumn("epoch", F.sum("_new").over(seen)).drop("_snap", "_new")


def actions(updates: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """updates with action: insert, update, delete or noop, by the level's quantity before."""
    before = F.coalesce(F.lag("qty").over(Window.partitionBy(*by, *LEVEL).orderBy(*order)), F.lit(0.0))
    now = F.col("qty") > 0
    return updates.withColumn("action", F.when(now & (before > 0), "update").when(now, "insert").when(before > 0, "delete").otherwise("noop"))


def final_levels(updates: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Levels alive at the end. The last row of a level decides, so partial results combine before the shuffle."""
    last = updates.groupBy(*by, *LEVEL).agg(F.max_by("qty", F.struct(*order)).alias("qty"))
    return last.where("qty > 0")


def top_levels(levels: DataFrame, by: Sequence[str], depth: int) -> DataFrame:
    """level (from 1) of the best ``depth`` prices of each side: bids from above, asks from below."""
    better = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    level = F.row_number().over(Window.partitionBy(*by, "side").orderBy(better))
    return levels.withColumn("level", level).where(F.col("level") <= depth)


def level_quantity(levels: Column, price: Column) -> Column:
    """What a book's levels (px, sz) hold at exactly this price, else 0."""
    at = F.filter(levels, lambda x: x.px == price)
    return F.coalesce(F.get(at, F.lit(0)).sz, F.lit(0.0))


def _carried(rows: DataFrame, by: Sequence[str], group: str, order: Sequence[str], need_snapshot: bool) -> DataFrame:
    """For each session (_part) after a key's first: the levels alive at its start, and a row without side if there was a snapshot before."""
    last = F.max_by(F.struct("qty", F.col(group).alias("at")), F.struct(*order)).alias("_e")
    ends = rows.groupBy(*by, *LEVEL, "_part").agg(last)
    later = Window.partitionBy(*by, *LEVEL).orderBy("_part")
    ends = ends.withColumn("_until", F.coalesce(F.lead("_part").over(later), F.max("_part").over(Window.partitionBy(*by))))
    ends = ends.where((F.col("_e.qty") > 0) & (F.col("_until") > F.col("_part")))
    ends = ends.select(*by, *LEVEL, "_e.qty", "_e.at", F.explode(F.sequence(F.col("_part") + 1, "_until")).alias("_part"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by, "_part").agg(F.max(F.when(F.col("snapshot"), F.col(group))).alias("_snap"))
    parts = parts.select(*by, "_part", F.max("_snap").over(before).alias("_since"))
    alive = F.col("at") >= F.col("_since")
    levels = ends.join(parts, [*by, "_part"]).where(alive if need_snapshot else F.coalesce(alive, F.lit(True)))
    return levels.select(*by, "_part", *LEVEL, "qty").unionByName(parts.where("_since is not null").select(*by, "_part"), allowMissingColumns=True)


class Book:
    """Levels of both sides and their prices in order."""

    def __init__(self, levels: Mapping[tuple[str, float], float], live: bool) -> None:
        self.live = live
        self.sizes: dict[str, dict[float, float]] = {"bid": {}, "ask": {}}
        for (side, price), qty in levels.items():
            self.sizes[side][price] = qty
        self.ladder = {"bid": sorted(-p for p in self.sizes["bid"]), "ask": sorted(self.sizes["ask"])}

    def levels(self) -> dict[tuple[str, float], float]:
        return {(side, price): qty for side, own in self.sizes.items() for price, qty in own.items()}

    def apply(self, clears: bool, rows: Iterable[tuple[str, float, float]], depth: int) -> list | None:
        """One group: status, then price and size of the best levels of each side; None before the first snapshot."""
        if clears:
            self.sizes, self.ladder, self.live = {"bid": {}, "ask": {}}, {"bid": [], "ask": []}, True
        if not self.live:
            return None
        for side, price, qty in rows:
            rank = -price if side == "bid" else price
            if qty > 0:
                if price not in self.sizes[side]:
                    insort(self.ladder[side], rank)
                self.sizes[side][price] = qty
            elif self.sizes[side].pop(price, None) is not None:
                del self.ladder[side][bisect_left(self.ladder[side], rank)]
        bids, asks = [-x for x in self.ladder["bid"][:depth]], self.ladder["ask"][:depth]
        gap = bids[0] - asks[0] if bids and asks else -1
        out: list = ["ok" if gap < 0 else "locked" if gap == 0 else "crossed"]
        for side, best in (("bid", bids), ("ask", asks)):
            for price in best:
                out += [price, self.sizes[side][price]]
            out += [None] * (2 * (depth - len(best)))
        return out


def state_columns(depth: int) -> tuple[str, list[str]]:
    """Schema and names of what ``Book.apply`` gives."""
    names = [f"{s}_{w}_{i}" for s in ("bid", "ask") for i in range(1, depth + 1) for w in ("px", "sz")]
    return "status string" + "".join(f", {c} double" for c in names), ["status", *names]


def replay(updates: DataFrame, by: Sequence[str], group: str, order: Sequence[str], depth: int, need_snapshot: bool = True, session: int | None = None) -> DataFrame:
    """A row per group: the book after it, its best ``depth`` levels, and whether it is crossed or locked.

    Groups are applied in order within each key; one whose rows hold a snapshot clears the
    book first, and rows before the first snapshot are ignored if one is needed.  This is
    the one fold that window functions can't express, as a row's book depends on all before.
    ``session`` (in the group's unit) cuts a key into tasks that start from the levels alive
    at their session's start, found by aggregates; the result doesn't depend on it.  Spark
    sorts each session once, spilling where it must, and a task holds one book.
    """
    schema, names = state_columns(depth)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.select(*by, group).schema)
    width = len(by) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), *[pa.float64()] * (len(names) - 1)]
        at = book = None
        us, clears, held, held_in = None, False, [], None  # the group that may go on in the next batch
        done: list[tuple[pa.RecordBatch, int, list]] = []

        def finish() -> None:
            nonlocal held, clears, us
            if us is not None:
                found = book.apply(clears, held, depth)
                if found is not None:
                    done.append((*held_in, found))
            us, clears, held = None, False, []

        def emit() -> pa.RecordBatch:
            parts = [row.slice(i, 1) for row, i, _ in done]
            columns = [pa.concat_arrays([p.column(c) for p in parts]) for c in (*range(width - 1), width)]
            return pa.record_batch([*columns, *(pa.array(c, t) for c, t in zip(zip(*[f for _, _, f in done]), types))], [*by, group, *names])

        for key, rows in runs(batches, width):
            if key != at:
                if book is not None:
                    finish()
                at, book = key, Book({}, not need_snapshot)
            groups, carried, snaps, sides, prices, sizes = (rows.column(width + c).to_pylist() for c in range(6))
            for i, (g, first, snap, side, price, qty) in enumerate(zip(groups, carried, snaps, sides, prices, sizes)):
                if first:  # what the session starts with
                    if side is None:
                        book.live = True
                    else:
                        insort(book.ladder[side], -price if side == "bid" else price)
                        book.sizes[side][price] = qty
                    continue
                if g != us:
                    finish()
                    us, held_in = g, (rows, i)
                clears = clears or bool(snap)
                held.append((side, price, qty))
            if len(done) > 5000:
                yield emit()
                done.clear()
        if book is not None:
            finish()
        if done:
            yield emit()

    rows = updates.withColumn("_part", F.floor(F.col(group) / session).cast("long") if session else F.lit(0).cast("long")).withColumn("_carried", F.lit(False))
    columns = [*by, "_part", group, "_carried", "snapshot", "side", F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty")]
    sorts = [c for c in order if c not in (group, *by)]
    typed = rows.select(*columns, *sorts)
    if session:
        carried = _carried(rows.drop("_carried"), by, group, order, need_snapshot).withColumns({"price": F.col("price").cast("double"), "qty": F.col("qty").cast("double"), "snapshot": F.lit(False), "_carried": F.lit(True)})
        typed = typed.unionByName(carried.select(*by, "_part", "_carried", "snapshot", "side", "price", "qty"), allowMissingColumns=True)
    dealt = typed.repartition(*by, "_part").sortWithinPartitions(*by, "_part", F.desc("_carried"), *order)
    return dealt.select(*by, "_part", group, "_carried", "snapshot", "side", "price", "qty").mapInArrow(run, f"{keys}, {schema}")
