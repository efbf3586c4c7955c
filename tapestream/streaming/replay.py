"""Order books over a stream of level updates: the batch replay's rows, as groups become complete.

State is kept by instrument: one entry per live level, the updates of groups that may still
grow, and whether a snapshot was seen.  A group is complete when the watermark passes its
time; an event-time timer then applies it, so a group that a micro-batch cuts in two, or
updates that come in another order within the watermark's delay, change nothing.  Only
levels that change are written to the state store, and what a restart reads from the
checkpoint is what there was.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapestream.operators.book import Book, state_columns

PENDING = "us long, row long, side string, price double, qty double, snapshot boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Replay(StatefulProcessor):
    """Applies complete groups in order of time, rows of one group in order of ``row``."""

    def __init__(self, names: Sequence[str], depth: int, need_snapshot: bool) -> None:
        self.names, self.depth, self.need_snapshot = list(names), depth, need_snapshot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "side string, price double", "qty double")
        self.pending = handle.getListState("pending", PENDING)
        self.status = handle.getValueState("status", "live boolean, earliest long")

    def _status(self) -> tuple[bool, int | None]:
        return tuple(self.status.get()) if self.status.exists() else (not self.need_snapshot, None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        live, earliest = self._status()
        for frame in rows:
            own = list(zip(*(frame[c].tolist() for c in ("us", "row", "side", "price", "qty", "snapshot"))))
            self.pending.appendList(own)
            for at in sorted({us // 1000 for us, *_ in own}):
                self.handle.registerTimer(at)
            earliest = min([us for us, *_ in own] + ([earliest] if earliest is not None else []), default=None)
        self.status.update((live, earliest))
        yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        live, earliest = self._status()
        if earliest is None or earliest // 1000 > upto:
            yield pd.DataFrame(columns=self.names)  # an earlier timer of this trigger did the work
            return
        every = [tuple(r) for r in self.pending.get()]
        ready = sorted((r for r in every if r[0] // 1000 <= upto), key=lambda r: r[:2])
        left = [r for r in every if r[0] // 1000 > upto]
        before = {tuple(level): qty[0] for level, qty in self.levels.iterator()}
        book, out = Book(before, live), []
        at = 0
        while at < len(ready):
            us, end = ready[at][0], at
            while end < len(ready) and ready[end][0] == us:
                end += 1
            group = ready[at:end]
            found = book.apply(any(r[5] for r in group), [r[2:5] for r in group], self.depth)
            if found is not None:
                out.append([*key, us, *found])
            at = end
        after = book.levels()
        for level in before.keys() - after.keys():
            self.levels.removeKey(level)
        for level, qty in after.items():
            if before.get(level) != qty:
                self.levels.updateValue(level, (qty,))
        if left:
            self.pending.put(left)
        else:
            self.pending.clear()
        self.status.update((book.live, min((r[0] for r in left), default=None)))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def replay_stream(updates: DataFrame, by: Sequence[str], depth: int, need_snapshot: bool = True, late: str = "1 second") -> DataFrame:
    """A row per complete group of updates (us, row, side, price, qty, snapshot) of each key, as ``book.replay`` gives.

    Updates later than ``late`` behind the newest one are dropped; it must be at least a
    millisecond, or the rest of a group that a micro-batch cut in two is late.  The session
    must use the RocksDB state store (PROVIDER).
    """
    typed = updates.select(*by, "us", "row", "side", F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"), F.coalesce("snapshot", F.lit(False)).alias("snapshot"), F.timestamp_micros("us").alias("_ts"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.select(*by).schema)
    schema, names = state_columns(depth)
    processor = Replay([*by, "us", *names], depth, need_snapshot)
    return typed.withWatermark("_ts", late).groupBy(*by).transformWithStateInPandas(processor, f"{keys}, us long, {schema}", "Append", "EventTime")
