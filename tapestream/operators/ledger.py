"""Positions and profit of fills, in sessions: one scenario is many tasks.

Sums and maxima are scans in two passes (``scans``).  The average-cost fold looks like one
that must go row by row, but positions are sums, so they are known at each session's start;
and given them, a fill changes the cost of the open position (position times average) by
multiplying it and adding to it: an addition adds, a reduction takes a share away, a fill
that opens or turns the position sets it.  Such steps compose.  So a first pass composes
each session's fills, the compositions are applied one after another, a row per scenario and
session, and a second pass folds each session from the position and cost it starts with.
What a session realizes is linear in the cost it starts with, so where only ends are asked
for, the first pass composes that too, and there is no second one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapestream.operators import scans, selection
from tapestream.operators.scans import SESSION
from tapestream.sources.scratch import stored

FLAT = 1e-8
STATE = ("position", "average", "realized")
ENDS = ("_times", "_plus", "_gain_times", "_gain_plus", "_position", "_longest", "_shortest", "_sizes", "_known")


def running(fills: DataFrame, by: Sequence[str], order: Sequence[str], session: int = SESSION) -> DataFrame:
    """fills (signed, price, fee) with position, cash (without fees), fees and turnover so far; order[0] is the time."""
    notional = F.col("signed") * F.col("price")
    sums = {"position": F.col("signed"), "cash": -notional, "fees": F.col("fee"), "turnover": F.abs(notional)}
    return scans.running(fills, by, order, sums, session=session)


def mark_to_market(fills: DataFrame, marks: DataFrame, by: Sequence[str], on: str, order: Sequence[str]) -> DataFrame:
    """marks (mid) with position, cash, fees, turnover, gross and net of the fills at or before each mark.

    Fills of one time count for the same marks, so they are added up before they are shuffled; ``order`` only names them.
    """
    notional = F.col("signed") * F.col("price")
    sums = {"position": F.col("signed"), "cash": -notional, "fees": F.col("fee"), "turnover": F.abs(notional)}
    rows = fills.groupBy(*by, F.col(on).alias("_us")).agg(*[F.sum(v).alias(f"_s_{name}") for name, v in sums.items()]).withColumn("_flag", F.lit(0))
    probes = marks.select(*by, F.col(on).alias("_us"), F.lit(1).alias("_flag"), F.struct(*marks.columns).alias("_mark"))
    both = rows.unionByName(probes, allowMissingColumns=True)
    seen = scans.running(both, by, ["_us", "_flag"], {name: F.col(f"_s_{name}") for name in sums}).where(F.col("_mark").isNotNull())
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("position", "cash", "fees", "turnover")]
    out = seen.select("_mark.*", *zero)
    gross = F.col("cash") + F.col("position") * F.col("mid")
    return out.withColumn("gross", gross).withColumn("net", F.col("gross") - F.col("fees"))


def drawdown(rows: DataFrame, by: Sequence[str], order: Sequence[str], equity: str, session: int = SESSION) -> DataFrame:
    found = scans.running(rows, by, order, maxima={"_peak": F.col(equity)}, session=session)
    return found.withColumn("drawdown", F.col("_peak") - F.col(equity)).drop("_peak")


def drawdown_summary(fills: DataFrame, by: Sequence[str], order: Sequence[str], session: int = SESSION) -> DataFrame:
    """worst and mean drawdown of the running cash (without fees) of each scenario; the rows are shuffled once.

    Rows of a session with one peak so far go on together, as how many they are, how far they are below it and the
    lowest; these few rows are stored and get the peak of all sessions up to theirs.
    """
    parts = scans.cut(fills.select(*by, *order, (-F.col("signed") * F.col("price")).alias("_v")), by, order, {"_v": (F.sum("_v"), F.sum)}, session)
    upto = Window.partitionBy(*by, "_part").orderBy(F.col("_carried").desc(), *order).rowsBetween(Window.unboundedPreceding, 0)
    path = parts.withColumn("_cash", F.sum("_v").over(upto)).withColumn("_peak", F.max(F.when(~F.col("_carried"), F.col("_cash"))).over(upto)).where(~F.col("_carried"))
    steps = path.groupBy(*by, "_part", "_peak").agg(F.count("_cash").alias("_n"), F.sum(F.col("_peak") - F.col("_cash")).alias("_below"), F.min("_cash").alias("_low"))
    steps = stored(steps.withColumn("_us", F.col("_part") * session).drop("_part"), "steps")
    steps = scans.running(steps, by, ["_us", "_peak"], maxima={"_top": F.col("_peak")}, session=session)
    below = F.sum(F.col("_below") + F.col("_n") * (F.col("_top") - F.col("_peak")))
    return steps.groupBy(*by).agg(F.max(F.col("_top") - F.col("_low")).alias("worst"), F.try_divide(below, F.sum("_n")).alias("mean"))


def _step(state: tuple[float, float, float], q: float | None, p: float | None) -> tuple[float, float, float]:
    """One fill on position, average price and realized profit; one without quantity or price changes nothing."""
    if q is None or p is None or abs(q) < FLAT:
        return state
    pos, avg, realized = state
    after = pos + q
    if abs(pos) < FLAT:
        avg = p
    elif (pos > 0) == (q > 0):
        avg = (pos * avg + q * p) / after
    else:
        realized += min(abs(pos), abs(q)) * (1 if pos > 0 else -1) * (p - avg)
        if abs(q) > abs(pos) + FLAT:
            avg = p
    return (0.0, 0.0, realized) if abs(after) < FLAT else (after, avg, realized)


def _composed(pos: float, fills: Iterator[tuple[float | None, float | None]]) -> tuple[float, float]:
    """What fills from a position do to its cost: they multiply it and add to it."""
    times, plus = 1.0, 0.0
    for q, p in fills:
        if q is None:
            continue
        after = pos + q
        if abs(after) < FLAT:
            times = plus = after = 0.0
        elif abs(pos) < FLAT or ((pos > 0) != (q > 0) and abs(q) > abs(pos) + FLAT):
            times, plus = 0.0, after * p
        elif (pos > 0) == (q > 0):
            plus += q * p
        else:
            times, plus = times * after / pos, plus * after / pos
        pos = after
    return times, plus


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows with equal values in the first columns, as (these values, rows); a run may come in several pieces."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n - 1, bool)
        for c in range(width):
            a, b = batch.column(c).slice(0, n - 1), batch.column(c).slice(1)
            apart = pc.or_(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
            new |= apart.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for first, last in zip(cuts[:-1], cuts[1:]):
            yield tuple(batch.column(c)[first].as_py() for c in range(width)), batch.slice(first, last - first)


def _schema(rows: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)


def _costs(parts: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """by, _part and _cost: the open position's cost before each session.

    parts: fills (_q, _p) in sessions, with the position before each as _q of its first row, which is _carried.
    """
    width = len(by) + 1

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pos, times, plus, first, done = None, 0.0, 1.0, 0.0, None, []

        def emit() -> pa.RecordBatch:
            keys = [pa.concat_arrays([row.column(c) for row, _, _ in done]) for c in range(width)]
            return pa.record_batch([*keys, *(pa.array([x[c] for x in done], pa.float64()) for c in (1, 2))], [*by, "_part", "_m", "_b"])

        for key, rows in runs(batches, width):
            if key != at:
                if first is not None:
                    done.append((first, times, plus))
                at, pos, times, plus, first = key, 0.0, 1.0, 0.0, rows.slice(0, 1)
            carried, q, p = (rows.column(width + c).to_pylist() for c in range(3))
            if carried[0]:
                pos, q, p = q[0] or 0.0, q[1:], p[1:]
            m, b = _composed(pos, zip(q, p))
            times, plus = times * m, plus * m + b
            for x in q:
                pos = 0.0 if x is not None and abs(pos + x) < FLAT else pos + (x or 0.0)
            if len(done) > 10_000:
                yield emit()
                done = []
        if first is not None:
            done.append((first, times, plus))
        if done:
            yield emit()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cost = None, 0.0
        for key, rows in runs(batches, width - 1):
            if key != at:
                at, cost = key, 0.0
            costs = []
            for m, b in zip(rows.column(width).to_pylist(), rows.column(width + 1).to_pylist()):
                costs.append(cost)
                cost = m * cost + b
            yield pa.record_batch([*rows.columns[:width], pa.array(costs, pa.float64())], [*by, "_part", "_cost"])

    keys = _schema(parts, [*by, "_part"])
    dealt = parts.repartition(*by, "_part").sortWithinPartitions(*by, "_part", F.desc("_carried"), *order)
    composed = dealt.select(*by, "_part", "_carried", "_q", "_p").mapInArrow(compose, f"{keys}, _m double, _b double")
    return composed.repartition(*by).sortWithinPartitions(*by, "_part").mapInArrow(apply, f"{keys}, _cost double")  # a row per key and session


def _gained(pos: float, fills: Iterator[tuple[float | None, float | None]], ends: list[float]) -> float:
    """The position after fills; ends: times, plus of _composed, then what the realized profit is, times the first cost and plus, all so far."""
    times, plus, gain_times, gain_plus = ends[:4]
    for q, p in fills:
        if q is None or p is None or abs(q) < FLAT:
            continue
        after = pos + q
        if abs(pos) < FLAT:
            times, plus = 0.0, after * p
        elif (pos > 0) == (q > 0):
            plus += q * p
        else:
            closed = (min(abs(pos), abs(q)) if pos > 0 else -min(abs(pos), abs(q))) / pos
            gain_times -= closed * times
            gain_plus += closed * (pos * p - plus)
            times, plus = (0.0, after * p) if abs(q) > abs(pos) + FLAT else (times * after / pos, plus * after / pos)
        if abs(after) < FLAT:
            times = plus = after = 0.0
        pos = after
    ends[:4] = times, plus, gain_times, gain_plus
    return pos


def _ends(fills: DataFrame, by: Sequence[str], order: Sequence[str], session: int) -> DataFrame:
    """by, _part, STATE at each session's end (realized: within it), and of the running sums of signed _longest, _shortest, _sizes and how many are _known.

    The fills are shuffled once.
    """
    width = len(by) + 1
    counts = F.col("_p").isNotNull() & (F.abs("_s") >= FLAT)
    values = fills.select(*by, *order, F.col("signed").cast("double").alias("_s"), F.col("price").cast("double").alias("_p"))
    parts = scans.cut(values, by, order, {"_s": (F.sum("_s"), F.sum), "_q": (F.sum(F.when(counts, F.col("_s"))), F.sum)}, session)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, pos, total, ends, done = None, None, 0.0, None, [], []

        def emit() -> pa.RecordBatch:
            keys = [pa.concat_arrays([row.column(c) for row, _ in done]) for c in range(width)]
            return pa.record_batch([*keys, *(pa.array(x, pa.float64()) for x in zip(*[e for _, e in done]))], [*by, "_part", *ENDS])

        for key, rows in runs(batches, width):
            if key != at:
                if first is not None:
                    done.append((first, ends))
                at, first, pos, total, ends = key, rows.slice(0, 1), 0.0, None, [1.0, 0.0, 0.0, 0.0, 0.0, None, None, 0.0, 0.0]
            carried, s, q, p = (rows.column(width + c).to_pylist() for c in range(4))
            if carried[0]:
                pos, total, s, p = q[0] or 0.0, s[0], s[1:], p[1:]
            ends[4] = pos = _gained(pos, zip(s, p), ends)
            known = 0 if total is not None else next((i for i, x in enumerate(s) if x is not None), len(s))  # null until the first that isn't
            if known < len(s):
                path = np.cumsum([total or 0.0, *(x or 0.0 for x in s[known:])])[1:]
                total, high, low = float(path[-1]), float(path.max()), float(path.min())
                ends[5:] = high if ends[5] is None else max(ends[5], high), low if ends[6] is None else min(ends[6], low), ends[7] + float(np.abs(path).sum()), ends[8] + len(path)
            if len(done) > 10_000:
                yield emit()
                done = []
        if first is not None:
            done.append((first, ends))
        if done:
            yield emit()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cost = None, 0.0
        for key, rows in runs(batches, width - 1):
            if key != at:
                at, cost = key, 0.0
            states = []
            for times, plus, gain_times, gain_plus, pos in zip(*(rows.column(width + c).to_pylist() for c in range(5))):
                gain, cost = gain_times * cost + gain_plus, times * cost + plus
                states.append((pos, cost / pos, gain) if abs(pos) >= FLAT else (0.0, 0.0, gain))
            columns = [*rows.columns[:width], *(pa.array(x, pa.float64()) for x in zip(*states)), *rows.columns[width + 5 :]]
            yield pa.record_batch(columns, [*by, "_part", *STATE, *ENDS[5:]])

    keys = _schema(parts, [*by, "_part"])
    dealt = parts.repartition(*by, "_part").sortWithinPartitions(*by, "_part", F.desc("_carried"), *order)
    composed = dealt.select(*by, "_part", "_carried", "_s", "_q", "_p").mapInArrow(compose, f"{keys}, " + ", ".join(f"{c} double" for c in ENDS))
    schema = f"{keys}, " + ", ".join(f"{c} double" for c in (*STATE, *ENDS[5:]))
    return composed.repartition(*by).sortWithinPartitions(*by, "_part").mapInArrow(apply, schema)  # a row per key and session


def _fold(fills: DataFrame, by: Sequence[str], order: Sequence[str], path: bool, session: int) -> DataFrame:
    """The fold of each session from what it starts with, its realized profit counted from 0.

    ``path``: a row per fill, with all its columns, else one per scenario and session.
    """
    q, p = F.col("signed").cast("double"), F.col("price").cast("double")
    counts = q.isNotNull() & p.isNotNull() & (F.abs(q) >= FLAT)
    values = fills.withColumns({"_q": F.when(counts, q), "_p": p})
    parts = scans.cut(values, by, order, {"_q": (F.sum("_q"), F.sum)}, session)
    kept = list(fills.columns) if path else list(by)
    more = [c for c in kept if c not in by]
    rows = parts.unionByName(_costs(parts, by, order).withColumn("_carried", F.lit(True)), allowMissingColumns=True)
    dealt = rows.repartition(*by, "_part").sortWithinPartitions(*by, "_part", F.desc("_carried"), *order)
    width = len(by) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, state, first, done = [*by, "_part", *more, *STATE], None, (0.0, 0.0, 0.0), None, []

        def emit() -> pa.RecordBatch:
            keys = [pa.concat_arrays([row.column(c) for row, _ in done]) for c in range(width)]
            return pa.record_batch([*keys, *(pa.array(x, pa.float64()) for x in zip(*[s for _, s in done]))], names)

        for key, piece in runs(batches, width):
            if key != at:
                if first is not None and not path:
                    done.append((first, state))
                at, state, first, pos, cost = key, (0.0, 0.0, 0.0), piece.slice(0, 1), 0.0, 0.0
            carried, qs, ps, costs = (piece.column(width + c).to_pylist() for c in range(4))
            head = sum(carried)
            for x, c in zip(qs[:head], costs[:head]):
                pos, cost = (x or 0.0, cost) if c is None else (pos, c)
                state = (pos, cost / pos, 0.0) if abs(pos) >= FLAT else (0.0, 0.0, 0.0)
            states = []
            for x, y in zip(qs[head:], ps[head:]):
                state = _step(state, x, y)
                if path:
                    states.append(state)
            if states:
                own = piece.slice(head)
                columns = [own.column(c) for c in (*range(width), *range(width + 4, width + 4 + len(more)))]
                yield pa.record_batch([*columns, *(pa.array(c, pa.float64()) for c in zip(*states))], names)
            if len(done) > 10_000:
                yield emit()
                done = []
        if first is not None and not path:
            done.append((first, state))
        if done:
            yield emit()

    schema = _schema(parts, [*by, "_part", *more]) + ", " + ", ".join(f"{c} double" for c in STATE)
    return dealt.select(*by, "_part", "_carried", "_q", "_p", "_cost", *more).mapInArrow(run, schema)


def average_cost(fills: DataFrame, by: Sequence[str], order: Sequence[str], session: int = SESSION) -> DataFrame:
    """Terminal position, average price and realized profit of each scenario; order[0] is the time."""
    return accounts(fills, by, order, session).select(*by, *STATE)


def accounts(fills: DataFrame, by: Sequence[str], order: Sequence[str], session: int = SESSION) -> DataFrame:
    """average_cost, and of the running positions (sums of signed) the longest, shortest and mean size; the fills are shuffled once."""
    last = F.max_by(F.struct("position", "average"), F.coalesce("_part", F.lit(-(2**63))))
    mean = F.try_divide(F.sum("_sizes"), F.sum("_known"))
    of = (last.alias("_e"), F.sum("realized").alias("realized"), F.max("_longest").alias("longest"), F.min("_shortest").alias("shortest"), mean.alias("mean_abs"))
    return _ends(fills, by, order, session).groupBy(*by).agg(*of).select(*by, "_e.position", "_e.average", "realized", "longest", "shortest", "mean_abs")


def average_cost_path(fills: DataFrame, by: Sequence[str], order: Sequence[str], session: int = SESSION) -> DataFrame:
    """fills with position, average and realized after each, for scenarios whose path is wanted."""
    ends = _fold(fills, by, order, False, session)
    earlier = F.sum("realized").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate((*by, "_part"))], F.coalesce(earlier, F.lit(0.0)).alias("_earlier"))
    same = F.lit(True)
    for i, c in enumerate((*by, "_part")):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    steps = _fold(fills, by, order, True, session).join(earlier, same)
    return steps.select(*fills.columns, "position", "average", (F.col("realized") + F.col("_earlier")).alias("realized"))


def position_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    p = F.col("position")
    sums = rows.groupBy(*by).agg(
        F.max(p).alias("longest"), F.min(p).alias("shortest"), F.avg(F.abs(p)).alias("mean_abs"),
        F.avg((p > 0).cast("double")).alias("long_share"), F.avg((p < 0).cast("double")).alias("short_share"),
    )
    out = selection.with_quantiles(sums, rows, by, {"size": F.abs(p)}, {"size": {"median_abs": 0.5, "p95_abs": 0.95}})
    return out.select(*by, "longest", "shortest", "mean_abs", "median_abs", "p95_abs", "long_share", "short_share")
