"""Scans, ledgers, fills, quantiles and digests that are cut into tasks: results don't depend on the cuts."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapestream.operators import asof, digest, dominance, execution, ledger, quality, scans, selection, trailing

SESSIONS = (1, 7, 10**9)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(60) if rng.random() < 0.95 else None, i, rng.choice([None, 1.0, 2.0, 3.0]), float(rng.randint(-3, 3))) for i in range(300)]
    rows += [("c", 5, 1000, None, 1.0)]
    return spark.createDataFrame(rows, "k string, us long, row long, v double, q double")


def in_order(series):
    """Rows of each key, nulls first, as Spark sorts them."""
    out = {}
    for r in sorted(series.collect(), key=lambda r: (r.us is not None, r.us or 0, r.row)):
        out.setdefault(r.k, []).append(r)
    return out


def test_running_previous_and_nearest(series):
    want = {}
    for rows in in_order(series).values():
        for i, r in enumerate(rows):
            upto = [x.v for x in rows[: i + 1] if x.v is not None]
            before, after = [x.v for x in rows[:i] if x.v is not None], [x.v for x in rows[i + 1 :] if x.v is not None]
            want[r.row] = (sum(upto) if upto else None, max(upto, default=None), rows[i - 1].v if i else None, rows[i - 1].row if i else None,
                           upto[-1] if upto else None, before[-1] if before else None, after[0] if after else None)
    for session in SESSIONS:
        out = scans.running(series, ["k"], ["us", "row"], {"total": F.col("v")}, {"most": F.col("v")}, session)
        out = scans.previous(out, ["k"], ["us", "row"], {"pv": "v", "prow": "row"}, session)
        for name, options in (("upto", {}), ("before", {"inclusive": False}), ("after", {"inclusive": False, "later": True})):
            out = scans.last_known(out, ["k"], ["us", "row"], name, F.col("v"), session=session, **options)
        got = {r.row: (r.total, r.most, r.pv, r.prow, r.upto, r.before, r.after) for r in out.collect()}
        assert got == want
        assert out.columns == [*series.columns, "total", "most", "pv", "prow", "upto", "before", "after"]


def test_interval_sums_equal_sums_over_pairs(spark, series):
    points = series.where("us is not null and k is not null")
    spans = spark.createDataFrame([(k, a, b) for k in "abz" for a in range(-2, 62, 5) for b in (a - 3, a, a + 1, a + 20)] * 2, "k string, a long, b long")
    data = points.collect()
    want = sorted((r.k, r.a, r.b, sum(1 for x in data if x.k == r.k and r.a < x.us <= r.b), sum(x.q for x in data if x.k == r.k and r.a < x.us <= r.b)) for r in spans.collect())
    for session in SESSIONS:
        got = scans.interval_sums(spans, points, ["k"], "a", "b", "us", {"n": F.lit(1), "q": F.col("q")}, session)
        assert sorted(map(tuple, got.collect())) == want
    joined = asof.interval_join(spans.distinct(), points, ["k"], "a", "b", "us", 10).groupBy("k", "a", "b").count()
    assert {tuple(r) for r in joined.collect()} == {(k, a, b, n) for k, a, b, n, _ in want if n}


def test_changes_stale_runs_and_order_flow_in_sessions(series):
    rows = series.where("us is not null and k is not null and v is not null")
    states = rows.select("k", "us", "row", F.col("v").alias("v"))
    want_next, want_stale = set(), set()
    for own in in_order(states).values():
        since = None
        reported = False
        for i, r in enumerate(own):
            later = next((x for j, x in enumerate(own[i + 1 :], i + 1) if own[j - 1].v != x.v), None)
            near = later is not None and later.us - r.us <= 15
            want_next.add((r.row, later.us if near else None, (1 if later.v > r.v else -1) if near else None))
            if i == 0 or own[i - 1].v != r.v:
                since, reported = r.us, False
            if r.us - since > 1 and not reported:
                want_stale.add((r.row, since))
                reported = True
    quotes = rows.select("k", "us", "row", F.col("v").alias("bid"), (F.col("row") % 3 + 1).alias("bid_sz"), (F.col("v") + 1).alias("ask"), (F.col("row") % 2 + 1).alias("ask_sz"))
    flows = None
    for session in SESSIONS:
        found = asof.next_change(states, ["k"], "us", "v", "row", 15, session)
        assert {(r.row, r.change_at, r.change_direction) for r in found.collect()} == want_next
        late = quality.stale(states, ["k"], ["us", "row"], "us", ["v"], 1, session)
        assert {(r.row, r.since) for r in late.collect()} == want_stale and late.columns == [*states.columns, "since"]
        flow = sorted((r.row, r.ofi) for r in trailing.with_ofi(quotes, ["k"], ["us", "row"], session).collect())
        assert flows is None or flows == flow
        flows = flow


def test_ledger_in_sessions(spark):
    rng = random.Random(8)
    rows = []
    for s in ("x", "y", None):
        lean = {"x": 0, "y": 2, None: -1}[s]  # y hardly ever gets flat
        for i in range(250):
            q = rng.choice([None, 0.0, *[float(rng.randint(-3, 3) + lean)] * 9])
            rows.append((s, i // 3, i, q, None if rng.random() < 0.03 else 100 + rng.random(), 0.1, i))
    fills = spark.createDataFrame(rows, "s string, us long, row long, signed double, price double, fee double, average_before long").repartition(3)
    state, want, ends = {}, {}, {}
    for s, _, i, q, p, _, _ in rows:
        state[s] = ledger._step(state.get(s, (0.0, 0.0, 0.0)), q, p)
        want[s, i] = ends[s] = state[s]
    for session in SESSIONS:
        got = {r.s: (r.position, r.average, r.realized) for r in ledger.average_cost(fills, ["s"], ["us", "row"], session).collect()}
        assert got.keys() == ends.keys() and all(got[s] == pytest.approx(ends[s], abs=1e-6) for s in ends)
        path = ledger.average_cost_path(fills, ["s"], ["us", "row"], session)
        assert path.columns == [*fills.columns, "position", "average", "realized"]
        seen = {(r.s, r.row): (r.position, r.average, r.realized) for r in path.collect()}
        assert seen.keys() == want.keys() and all(seen[k] == pytest.approx(want[k], abs=1e-6) for k in want)
        run = ledger.running(fills, ["s"], ["us", "row"], session)
        low = ledger.drawdown(run, ["s"], ["us", "row"], "cash", session)
        assert low.columns == [*run.columns, "drawdown"] and low.where("drawdown < 0").count() == 0
    assert ledger.average_cost(fills.limit(0), ["s"], ["us", "row"]).count() == 0
    assert ledger._fold(fills, ["s"], ["us", "row"], False, 7).count() == 3 * 12  # one scenario is many groups


def test_accounts_and_drawdowns_shuffle_the_fills_once(spark):
    rng = random.Random(9)
    rows = [(s, None if i < 3 else i // 4, i, rng.choice([None, 0.0, 1e-9, *[float(rng.randint(-3, 4))] * 9]), None if rng.random() < 0.05 else 100 + rng.random()) for s in ("x", "y", None) for i in range(200)]
    rows += [("z", i, i, 1.0 if i else None, None) for i in range(5)]
    fills = spark.createDataFrame(rows, "s string, us long, row long, signed double, price double").repartition(3)
    want = {}
    for s in ("x", "y", "z", None):
        state, position, cash, peak, sizes, below = (0.0, 0.0, 0.0), None, None, None, [], []
        for _, _, _, q, p in [r for r in rows if r[0] == s]:
            state = ledger._step(state, q, p)
            if q is not None:
                position = (position or 0.0) + q
            if position is not None:
                sizes.append(position)
            if q is not None and p is not None:
                cash = (cash or 0.0) - q * p
            if cash is not None:
                peak = cash if peak is None else max(peak, cash)
                below.append(peak - cash)
        want[s] = (*state, max(sizes), min(sizes), sum(map(abs, sizes)) / len(sizes)), (max(below), sum(below) / len(below)) if below else (None, None)
    for session in SESSIONS:
        found = ledger.accounts(fills, ["s"], ["us", "row"], session)
        got = {r.s: tuple(r)[1:] for r in found.collect()}
        low = {r.s: (r.worst, r.mean) for r in ledger.drawdown_summary(fills, ["s"], ["us", "row"], session).collect()}
        assert got.keys() == low.keys() == want.keys()
        for s, (ends, below) in want.items():
            assert got[s] == pytest.approx(ends, abs=1e-6)
            assert low[s] == (pytest.approx(below, abs=1e-6) if below[0] is not None else below)
    for of in (ledger.accounts, ledger.average_cost):  # composing the sessions and applying them, no second fold
        assert of(fills, ["s"], ["us", "row"])._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert ledger.accounts(fills.limit(0), ["s"], ["us", "row"]).count() == ledger.drawdown_summary(fills.limit(0), ["s"], ["us", "row"]).count() == 0


def test_dominance_against_plain_sums():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 64, 100):
        prices, weights = rng.integers(0, 6, n).astype(float), rng.integers(1, 4, n).astype(float)
        d = dominance.Dominance(prices, weights)
        limits = np.arange(-1.0, 7.0)
        k = d.cheapest(limits)
        assert k.tolist() == [(prices <= x).sum() for x in limits]
        for limit, own in zip(limits, k):
            upto = np.cumsum(np.where(prices <= limit, weights, 0))
            t = np.arange(n + 2)
            assert d.before(np.full(n + 2, own), t).tolist() == [0.0, *upto.tolist(), *([upto[-1] if n else 0.0])][: n + 2]
            for target in (0.0, 0.5, 3.0, 1e9):
                assert d.reach(np.array([own]), np.array([target]))[0] == next((i for i in range(n) if upto[i] > target), n)


def queue_by_loop(orders, prints):
    out = []
    for o in orders:
        ahead, left = o["queue"], o["quantity"]
        end = min(o["expiry"], o["cancel"] if o["cancel"] is not None else o["expiry"])
        for us, _, price, qty, side in prints:
            hits = (side == "sell" and price <= o["limit_price"]) if o["side"] == "BUY" else (side == "buy" and price >= o["limit_price"])
            if not (o["arrival"] < us <= end and hits):
                continue
            used = min(ahead, qty)
            ahead -= used
            got = min(left, qty - used)
            if got > 0:
                out.append((o["order_id"], us, got))
                left -= got
    return sorted(out)


def test_passive_fills_against_a_loop(spark):
    rng = random.Random(11)
    prints = sorted((rng.randrange(400), i, float(rng.randint(95, 105)), float(rng.randint(0, 4)), rng.choice(["buy", "sell", "other"])) for i in range(700))
    orders = []
    for i in range(150):
        at = rng.randrange(-20, 400)
        orders.append({"order_id": f"o{i}", "side": rng.choice(["BUY", "SELL"]), "limit_price": float(rng.randint(93, 107)), "quantity": float(rng.choice([0, 1, 5, 400])), "queue": float(rng.choice([0, 3, 50])),
                       "arrival": at, "expiry": at + rng.choice([-1, 0, 3, 60]), "cancel": rng.choice([None, at + 20])})
    asked = spark.createDataFrame([("i", *o.values()) for o in orders], "inst string, order_id string, side string, limit_price double, quantity double, queue double, arrival long, expiry long, cancel long")
    seen = spark.createDataFrame([("i", *p) for p in prints], "inst string, us long, row long, price double, qty double, side string")
    for session in (1, 100, 10**9):
        got = execution.passive_fills(asked, seen, ["inst"], session)
        assert sorted((r.order_id, r.fill_time, r.quantity) for r in got.collect()) == queue_by_loop(orders, prints)
    assert execution.passive_fills(asked.limit(0), seen, ["inst"]).count() == execution.passive_fills(asked, seen.limit(0), ["inst"]).count() == 0


def test_quantiles_are_exact(spark, monkeypatch):
    rng = random.Random(5)
    values = {"a": [rng.gauss(0, 1) for _ in range(400)], "b": [1e300, -1e300, 0.0, 1e-300, 5.0], "c": [2.0] * 50 + [3.0], "d": [7.0], None: [float(i % 5) for i in range(77)]}
    rows = [(g, v, -v) for g, vs in values.items() for v in vs] + [("a", None, None), ("a", float("nan"), 0.0), ("e", None, None)]
    frame = spark.createDataFrame(rows, "g string, v double, w double")
    ps = [0.0, 0.05, 0.5, 0.95, 1.0]

    def exact(vs):
        vs = sorted(vs)
        at = [p * (len(vs) - 1) for p in ps]
        return [vs[int(x)] + (vs[min(int(x) + 1, len(vs) - 1)] - vs[int(x)]) * (x - int(x)) for x in at]

    for ranges, rounds in ((4096, 3), (2, 1), (3, 2)):
        monkeypatch.setattr(selection, "RANGES", ranges)
        got = {r.g: r for r in selection.quantiles(frame, ["g"], {"v": F.col("v"), "w": F.col("w")}, {"v": ps, "w": [0.5]}, rounds).collect()}
        assert got.keys() == {*values, "e"} and got["e"].v is None
        for g, vs in values.items():
            assert got[g].v == pytest.approx(exact(vs), rel=1e-12)
        assert got["d"].w == [-7.0] and got["c"].w == [-2.0]
        assert got[None].w[0] == -statistics.median(values[None])
    whole = selection.quantiles(frame, [], {"v": F.col("v")}, {"v": [0.5]}).collect()
    assert len(whole) == 1 and whole[0].v[0] == pytest.approx(statistics.median([v for _, v, _ in rows if v is not None and v == v]))


def test_digests_add_up(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, 1.5), (2, "é|1:", 0.0)]
    frame = spark.createDataFrame(rows, "k long, s string, x double")
    total = digest.table_digest(frame).first()
    again = digest.table_digest(frame.repartition(3).orderBy("s")).first()
    assert total == again and total.rows == 4 and len(total.digest) == 64
    parts = digest.table_digest(frame.select("*", F.col("k").alias("part")), ["part"]).collect()
    assert f"{sum(int(r.digest, 16) for r in parts) % 2**256:064x}" == total.digest
    assert digest.table_digest(frame.distinct()).first().digest != total.digest
    assert digest.table_digest(frame.limit(0)).first().digest == "0" * 64
    shifted = spark.createDataFrame([("ab", "c"), ("a", "bc")], "s string, t string")
    assert len({r.h for r in shifted.select(digest.row_hash(["s", "t"]).alias("h")).collect()}) == 2
