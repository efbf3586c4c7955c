import random

import pytest
from pyspark.sql import functions as F

from tapestream.functions import market
from tapestream.operators import asof, book, quality, trailing


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_asof_bounds(spark):
    left = spark.createDataFrame([("a", t) for t in (5, 10, 15, 31)], "inst string, us long")
    right = spark.createDataFrame([("a", 10, 1, 1.0), ("a", 10, 2, 2.0), ("b", 1, 1, 9.0)], "inst string, us long, row long, price double")
    back = asof.asof(left, right, ["inst"], "us", ["price"], "row")
    assert rows(back, "us", "at", "price") == [(5, None, None), (10, 10, 2.0), (15, 10, 2.0), (31, 10, 2.0)]
    strict = asof.asof(left, right, ["inst"], "us", ["price"], "row", strict=True)
    assert rows(strict, "us", "price") == [(5, None), (10, None), (15, 2.0), (31, 2.0)]
    near = asof.asof(left, right, ["inst"], "us", ["price"], "row", tolerance=20)
    assert rows(near, "us", "price") == [(5, None), (10, 2.0), (15, 2.0), (31, None)]
    ahead = asof.asof(left, right, ["inst"], "us", ["price"], "row", direction="forward")
    assert rows(ahead, "us", "price") == [(5, 1.0), (10, 1.0), (15, None), (31, None)]


def test_clock_is_fresh_at_the_bound(spark):
    grid = spark.createDataFrame([("a", t) for t in (0, 10, 20, 21)], "inst string, us long")
    states = spark.createDataFrame([("a", 10, 1, 7.0)], "inst string, us long, row long, mid double")
    out = asof.fixed_clock(grid, states, ["inst"], "us", ["mid"], "row", 10)
    assert rows(out, "us", "mid", "is_available", "unavailable_reason") == [
        (0, None, False, "no_prior_state"), (10, 7.0, True, None), (20, 7.0, True, None), (21, None, False, "stale_state")
    ]


def test_trailing_window_edges_and_probes(spark):
    events = spark.createDataFrame([("a", 100, 1), ("a", 200, 2)], "inst string, us long, qty long")
    probes = spark.createDataFrame([("a", t) for t in (99, 100, 199, 200, 300)], "inst string, us long")
    out = trailing.trailing(events, ["inst"], "us", {"w": 100}, {"n": F.count("qty"), "s": F.sum("qty")}, probes=probes)
    assert rows(out, "us", "n_w", "s_w") == [(99, 0, None), (100, 1, 1), (199, 1, 1), (200, 1, 2), (300, 0, None)]


def test_the_future_does_not_move_the_past(spark):
    rng = random.Random(1)
    data = [("a", 10 * i, i, rng.random(), rng.randint(1, 5), rng.choice(["buy", "sell", "other"])) for i in range(60)]
    schema = "inst string, us long, row long, price double, qty long, side string"
    changed = data[:40] + [(a, u, i, p * 3, q + 7, "buy") for a, u, i, p, q, _ in data[40:]]
    found = [trailing.trailing(spark.createDataFrame(d, schema), ["inst"], "us", {"w": 55}, trailing.trade_sums()).where("row < 40") for d in (data, changed)]
    columns = [c for c in found[0].columns if c.endswith("_w")]
    assert rows(found[0], "row", *columns) == rows(found[1], "row", *columns)


def test_unknown_side_counts_and_subtracts(spark):
    events = spark.createDataFrame([("a", 1, 2.0, 3, "other")], "inst string, us long, price double, qty long, side string")
    r = trailing.trailing(events, ["inst"], "us", {"w": 5}, trailing.trade_sums()).first()
    assert (r.buy_volume_w, r.sell_volume_w, r.trade_count_w, r.signed_volume_w) == (0, 0, 1, -3)


def test_next_change(spark):
    states = spark.createDataFrame([("a", 0, 0, 5), ("a", 10, 1, 5), ("a", 20, 2, 6), ("a", 50, 3, 4)], "inst string, us long, row long, v long")
    out = asof.next_change(states, ["inst"], "us", "v", "row", 25)
    assert rows(out, "row", "change_at", "change_direction") == [(0, 20, 1), (1, 20, 1), (2, None, None), (3, None, None)]


def test_book_path_ends_in_the_final_state(spark):
    rng = random.Random(2)
    data = []
    for i in range(300):
        side = rng.choice(["bid", "ask"])
        price = rng.randint(95, 99) if side == "bid" else rng.randint(101, 105)
        data.append(("a", i // 3, i, side, price, float(rng.choice([0, 1, 2])), i in (4, 150)))
    updates = spark.createDataFrame(data, "inst string, us long, row long, side string, price long, qty double, snapshot boolean")
    path = book.replay(updates, ["inst"], "us", ["us", "row"], 5)
    last = path.orderBy(F.col("us").desc()).first()
    epochs = book.with_epochs(updates, ["inst"], "us", ["us", "row"])
    newest = epochs.agg(F.max("epoch")).first()[0]
    assert newest == 2 and path.count() == len({u for _, u, *_ in data if u >= 1})
    final = book.top_levels(book.final_levels(epochs.where(F.col("epoch") == newest), ["inst"], ["us", "row"]), ["inst"], 5)
    got = {(r.side, r.level): (float(r.price), r.qty) for r in final.collect()}
    for side in ("bid", "ask"):
        for i in range(1, 6):
            want = got.get((side, i), (None, None))
            assert (last[f"{side}_px_{i}"], last[f"{side}_sz_{i}"]) == want


def test_book_reports_crossing_and_needs_a_snapshot(spark):
    data = [("a", 0, 0, "bid", 9, 1.0, False), ("a", 1, 1, "bid", 10, 1.0, True), ("a", 2, 2, "ask", 10, 1.0, False), ("a", 3, 3, "ask", 9, 1.0, False)]
    updates = spark.createDataFrame(data, "inst string, us long, row long, side string, price long, qty double, snapshot boolean")
    assert rows(book.replay(updates, ["inst"], "us", ["us", "row"], 2), "us", "status") == [(1, "ok"), (2, "locked"), (3, "crossed")]


def test_quality_rules(spark):
    data = [(1, "10", "1", 5, 5), (2, "0", "-1", 5, 6), (3, "x", "2000000", 7, 9), (4, None, None, 6, 20)]
    feed = spark.createDataFrame(data, "row long, price string, qty string, seq long, us long").withColumn("f", F.lit(1))
    feed = feed.withColumns({"b": quality.previous("seq", ["f"], ["row"]), "u": quality.previous("us", ["f"], ["row"])})
    rules = quality.price_size_rules(F.col("price"), F.col("qty")) | quality.sequence_rules(F.col("seq"), F.col("b")) | quality.time_rules(F.col("us"), F.col("u"), 10)
    found = quality.issues(feed, ["row"], rules)
    assert rows(found, "row", "rule") == [
        (2, "invalid_price"), (2, "negative_quantity"), (2, "repeated_sequence"), (3, "extreme_size"), (3, "invalid_price"), (3, "sequence_gap"), (4, "out_of_order_sequence"), (4, "update_gap")
    ]
    with pytest.raises(ValueError, match="invalid_price x 2"):
        quality.check_gate(found)
    quality.check_gate(found.where("severity = 'WARNING'"))


def test_scalars(spark):
    q = spark.createDataFrame([(99.0, 2.0, 101.0, 6.0), (0.0, 0.0, 0.0, 0.0)], "b double, bs double, a double, az double")
    b, bs, a, az = (F.col(c) for c in q.columns)
    r = q.select(market.mid(b, a), market.spread_bps(b, a), market.imbalance(bs, az), market.microprice(b, bs, a, az)).collect()
    assert tuple(r[0]) == (100.0, 200.0, -0.5, 99.5) and tuple(r[1]) == (0.0, None, None, None)
    assert market.window_name(100_000) == "100ms" and market.window_name(30_000_000) == "30s"


def test_lookups_do_not_depend_on_sessions(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randint(0, 400), i) for i in range(200)]
    right = [(rng.choice("abc"), rng.randint(100, 300), i, rng.random()) for i in range(60)]
    probes = spark.createDataFrame(left, "inst string, us long, id long")
    states = spark.createDataFrame(right, "inst string, us long, row long, price double")
    for direction in ("backward", "forward"):
        for strict in (False, True):
            want = []
            for inst, us, i in left:
                back = direction == "backward"
                own = [r for r in right if r[0] == inst and (r[1] < us if back else r[1] > us) or r[0] == inst and r[1] == us and not strict]
                best = (max if back else min)(own, key=lambda r: (r[1], r[2]), default=(None,) * 4)
                want.append((i, best[1], best[3]))
            for session in (7, 50, 10**9):
                found = asof.asof(probes, states, ["inst"], "us", ["price"], "row", direction, strict, session=session)
                assert sorted(tuple(r) for r in found.select("id", "at", "price").collect()) == sorted(want)


def test_forward_lookups_are_one_step_a_row(spark):
    n = 200_000
    states = spark.range(n).select(F.lit("a").alias("inst"), (F.col("id") * 10).alias("us"), F.col("id").alias("row"), (F.col("id") % 7).alias("v"))
    probes = states.select("inst", (F.col("us") + 1).alias("us"), F.col("row").alias("id"))
    found = asof.asof(probes, states, ["inst"], "us", ["v"], "row", direction="forward")
    assert found.where("at = us + 9").count() == n - 1  # quadratic work would take hours
    assert asof.next_change(states, ["inst"], "us", "v", "row", 10).where("change_at = us + 10").count() == n - 1


def test_trailing_windows_do_not_depend_on_sessions_or_their_size(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.randint(-50, 400), i, rng.choice([None, rng.randint(1, 9)])) for i in range(150)]
    events = spark.createDataFrame(data, "inst string, us long, row long, qty long")
    probes = spark.createDataFrame([(rng.choice("ab"), rng.randint(-60, 600), i) for i in range(60)], "inst string, us long, id long")
    sums = {"n": F.count("qty"), "s": F.sum("qty")}
    for frame, key in ((None, "row"), (probes, "id")):
        times = data if frame is None else [tuple(r) for r in probes.collect()]
        want = []
        for inst, us, k, *_ in times:
            for w in (30, 200):
                inside = [q for i, u, _, q in data if i == inst and us - w < u <= us]
                want.append((k, w, len([q for q in inside if q is not None]), sum(q or 0 for q in inside) if inside else None))
        for session in (1, 77, 10**9):
            out = trailing.trailing(events, ["inst"], "us", {"30": 30, "200": 200}, sums, probes=frame, session=session).collect()
            got = [(r[key], w, r[f"n_{w}"], r[f"s_{w}"] if r[f"n_{w}"] or r[f"s_{w}"] else (None if r[f"s_{w}"] is None else 0)) for r in out for w in (30, 200)]
            assert len(got) == len(want)
            assert sorted((k, w, n, s or 0) for k, w, n, s in got) == sorted((k, w, n, s or 0) for k, w, n, s in want)


def test_replay_does_not_depend_on_sessions(spark):
    rng = random.Random(5)
    for snapshots in ((), (40, 170)):
        data = [("ab"[i % 2], i // 4 * 10, i, side, rng.randint(95, 99) if side == "bid" else rng.randint(101, 105), float(rng.choice([0, 1, 2])), i in snapshots) for i in range(240) for side in [rng.choice(["bid", "ask"])]]
        updates = spark.createDataFrame(data, "inst string, us long, row long, side string, price long, qty double, snapshot boolean")
        for need in (True, False):
            whole = book.replay(updates, ["inst"], "us", ["us", "row"], 3, need)
            want = sorted(map(str, whole.collect()))
            for session in (70, 250):
                assert sorted(map(str, book.replay(updates, ["inst"], "us", ["us", "row"], 3, need, session).collect())) == want
