import math
import random

import pytest
from pyspark.sql import functions as F

from tapestream.operators import economics, execution, ledger, models, ranks, signals


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_market_order_walks_the_book(spark):
    books = spark.createDataFrame([("x", 5, 1, [(99.0, 2.0), (98.0, 3.0)], [(101.0, 2.0), (102.0, 3.0), (103.0, 5.0)])], "inst string, us long, row long, bids array<struct<px:double,sz:double>>, asks array<struct<px:double,sz:double>>")
    orders = spark.createDataFrame([("x", "o1", "BUY", 4.0, 5), ("x", "o2", "SELL", 9.0, 9), ("x", "o3", "BUY", 1.0, 4)], "inst string, order_id string, side string, quantity double, arrival long")
    out = execution.market_fills(orders, books, ["inst"], 10)
    assert rows(out, "order_id", "book_level", "price", "fill") == [("o1", 1, 101.0, 2.0), ("o1", 2, 102.0, 2.0), ("o2", 1, 99.0, 2.0), ("o2", 2, 98.0, 3.0)]


def test_passive_order_waits_for_its_queue(spark):
    order = [("x", "o", "BUY", 100.0, 4.0, 3.0, 10, 30, 25)]
    orders = spark.createDataFrame(order, "inst string, order_id string, side string, limit_price double, quantity double, queue double, arrival long, expiry long, cancel long")
    prints = [(10, 9.0, "sell", 100.0), (11, 2.0, "sell", 100.0), (12, 2.0, "sell", 99.0), (13, 9.0, "buy", 99.0), (14, 9.0, "sell", 101.0), (25, 2.0, "sell", 100.0), (26, 9.0, "sell", 100.0)]
    trades = spark.createDataFrame([("x", t, i, p, q, s) for i, (t, q, s, p) in enumerate(prints)], "inst string, us long, row long, price double, qty double, side string")
    out = execution.passive_fills(orders, trades, ["inst"], 7)
    assert rows(out, "fill_time", "quantity") == [(12, 1.0), (25, 2.0)]
    assert execution.order_status(orders, out).first().status == "PARTIALLY_FILLED"


def loop(fills):
    """Average cost, one fill at a time."""
    pos = avg = real = 0.0
    for q, p in fills:
        if abs(pos) < 1e-8:
            avg = p
        elif pos * q > 0:
            avg = (pos * avg + q * p) / (pos + q)
        else:
            real += min(abs(pos), abs(q)) * math.copysign(1, pos) * (p - avg)
            if abs(q) > abs(pos):
                avg = p
        pos += q
        if abs(pos) < 1e-8:
            pos = avg = 0.0
    return pos, avg, real


def test_ledger_fold_path_and_identity(spark):
    rng = random.Random(3)
    fills = [(s, i, float(rng.choice([-3, -2, -1, 1, 2, 3])), 100 + rng.random(), 0.1) for s in range(4) for i in range(80)]
    table = spark.createDataFrame(fills, "s long, i long, signed double, price double, fee double")
    end = {r.s: r for r in ledger.average_cost(table, ["s"], ["i"]).collect()}
    path = {r.s: r for r in ledger.average_cost_path(table, ["s"], ["i"]).where("i = 79").collect()}
    run = {r.s: r for r in ledger.running(table, ["s"], ["i"]).where("i = 79").collect()}
    for s in range(4):
        pos, avg, real = loop([(q, p) for x, _, q, p, _ in fills if x == s])
        for got in (end[s], path[s]):
            assert (got.position, got.average, got.realized) == pytest.approx((pos, avg, real))
        mark = 123.0  # gross profit is realized plus unrealized
        assert run[s].cash + run[s].position * mark == pytest.approx(real + pos * (mark - avg))


def test_marks_see_fills_at_their_own_time(spark):
    fills = spark.createDataFrame([("s", 10, 1, 2.0, 50.0, 1.0)], "s string, us long, id long, signed double, price double, fee double")
    marks = spark.createDataFrame([("s", 9, 60.0), ("s", 10, 60.0)], "s string, us long, mid double")
    assert rows(ledger.mark_to_market(fills, marks, ["s"], "us", ["id"]), "us", "position", "gross", "net") == [(9, 0.0, 0.0, 0.0), (10, 2.0, 20.0, 19.0)]


def test_ranks_and_buckets(spark):
    data = [(1, i, float(x), float(y)) for i, (x, y) in enumerate([(1, 2), (1, 1), (2, 3), (3, 5), (4, 4), (5, 9), (6, 8)])]
    t = spark.createDataFrame(data, "d long, i long, x double, y double")
    assert ranks.spearman(t, ["d"], "x", "y").first().ic == pytest.approx(0.919, abs=1e-3)
    constant = t.withColumn("x", F.lit(1.0))
    assert ranks.spearman(constant, ["d"], "x", "y").first().ic is None
    k = t.withColumn("b", ranks.equal_count_bucket("x", "i", ["d"], 3))
    assert [r[1] for r in rows(k, "i", "b")] == [1, 1, 1, 2, 2, 3, 3]
    means = ranks.bucket_means(t.limit(2), ["d"], "x", "y", "i", 4)
    assert [r[1] for r in rows(means, "bucket", "n")] == [1, 0, 1, 0]


def test_false_discovery_and_p_values(spark):
    p = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03), (1, "d", None)], "f long, k string, p double")
    got = {r.k: r.q for r in ranks.benjamini_hochberg(p, ["f"], "p", "k").collect()}
    assert got["d"] is None and [got[k] for k in "abc"] == pytest.approx([0.03, 0.04, 0.04])
    assert ranks.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert ranks.t_two_sided(0.1, 3) == pytest.approx(0.926645, abs=1e-5)
    assert ranks.sign_test(8, 2) == pytest.approx(0.109375)


def test_signals(spark):
    data = [("d", i, s) for i, s in enumerate([0, 1, 1, -1, 0, 0, 1])]
    t = spark.createDataFrame(data, "day string, us long, s int")
    moves = signals.transitions(t, ["day"], ["us"], "us", "s")
    assert rows(moves, "us", "delta", "next_at") == [(1, 1, 3), (3, -2, 4), (4, 1, 6), (6, 1, None)]
    assert rows(signals.runs(t, ["day"], ["us"], "s"), "s", "length") == [(-1, 1), (0, 1), (0, 2), (1, 1), (1, 2)]
    flat = t.withColumn("f", signals.final_signal(F.col("s"), F.lit(True), F.lit(False), ["day"], ["us"]))
    assert [r[1] for r in rows(flat, "us", "f")] == [0, 1, 1, -1, 0, 0, 0]


def test_ridge_is_the_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 2))
    y = x @ [1.0, -2.0] + 3 + rng.normal(size=50) * 0.1
    t = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "p double, q double, y double")
    w, b = models.ridge(t, ["p", "q"], "y", 1.0)
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + np.eye(2), c.T @ (y - y.mean()))
    assert w == pytest.approx(want) and b == pytest.approx(y.mean() - x.mean(0) @ want)


def test_preprocessing_learns_from_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, None), (5.0, 7.0)], "a double, b double")
    p = models.Preprocessor(train, ["a", "b"])
    assert p.columns == ["a_z", "b_z", "b_missing"]
    r = p.apply(spark.createDataFrame([(None, None)], "a double, b double")).first()
    assert (r.a_z, r.b_missing) == (0.0, 1.0)


def test_folds_keep_time_order():
    days = [f"2024-{m:02d}-01" for m in range(1, 13)]
    for train, day in models.expanding_folds(days, 6) + models.rolling_folds(days, 6):
        assert max(train) < day
    assert [len(t) for t, _ in models.expanding_folds(days, 6)] == [6, 7, 8, 9, 10, 11]


def test_ties_share_wins_and_breakeven(spark):
    t = spark.createDataFrame([("c1", "a", 1.0), ("c1", "b", 1.0), ("c2", "a", 2.0), ("c2", "b", 0.0)], "c string, m string, v double")
    assert rows(economics.rank_wins(t, ["c"], "m", "v"), "m", "wins") == [("a", 1.5), ("b", 0.5)]
    n = spark.createDataFrame([("s", 0.0, 4.0), ("s", 1.0, 1.0), ("s", 2.0, -1.0)], "s string, fee double, net double")
    assert economics.interpolated_breakeven(n, ["s"], "fee", "net").first().breakeven == 1.5


def test_p_values_in_the_plan_are_those_of_the_driver(spark):
    rows = [(t, v) for t in (0.0, 0.3, 1.7, 2.5, 9.0) for v in (1, 2, 3, 4, 5, 8, 29, 30)]
    out = spark.createDataFrame(rows, "t double, v long").select("t", "v", ranks.t_p(F.col("t"), F.col("v")).alias("p")).collect()
    for r in out:
        assert r.p == pytest.approx(ranks.t_two_sided(r.t, r.v), abs=1e-9)
    signs = [(0, 0), (1, 0), (5, 5), (9, 1), (40, 20)]
    for r in spark.createDataFrame(signs, "a long, b long").select("a", "b", ranks.sign_p(F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p is None if r.a + r.b == 0 else r.p == pytest.approx(ranks.sign_test(r.a, r.b))


def test_whole_ranks_agree_with_one_window(spark):
    rng = random.Random(9)
    data = [(i, rng.choice([rng.random(), 0.5, 0.25]), rng.randint(0, 1)) for i in range(500)]
    rows = spark.createDataFrame(data, "id long, score double, label int").withColumn("part", F.lit("all"))
    placed = {r.id: r.bucket for r in ranks.with_whole_bucket(rows, "score", "id").collect()}
    for k, (i, *_) in enumerate(sorted(data, key=lambda r: (r[1], r[0]))):
        assert placed[i] == k * 10 // 500 + 1
    ones, zeros = ([s for _, s, y in data if y == k] for k in (1, 0))
    want = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert ranks.auc(rows, ["part"], "label", "score").first().auc == pytest.approx(want)


def test_newton_s_logistic_regression_is_at_its_optimum(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2)) * [1.0, 30.0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] / 30 + 0.5)))).astype(float)
    frame = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0), (1.0, 1.0, None)], "a double, b double, y double")
    for c in (1.0, 0.01):
        w, b = models.logistic(frame, ["a", "b"], "y", c)
        p = 1 / (1 + np.exp(-(x @ np.array(w) + b)))
        assert np.abs(x.T @ (p - y) + np.array(w) / c).max() < 1e-6 and abs((p - y).sum()) < 1e-6
    apart = frame.where("y is not null and a is not null").withColumn("y", (F.col("a") > 0).cast("double"))  # separable: the penalty holds the weights
    assert all(math.isfinite(v) for v in models.logistic(apart, ["a", "b"], "y")[0])
    assert models.logistic(frame.limit(0), ["a", "b"], "y") == ([0.0, 0.0], 0.0)
