"""What must hold whatever the numbers: windows without their anchor, no future in training, hand-made results."""

import random

import pytest
from pyspark.sql import functions as F

from oddsmill.functions import scalars
from oddsmill.functions import windows as fw
from oddsmill.operators import bars, boards, cohorts, ensemble, evaluate, normalize, ranks, signals, splits, stats, windows


def series(spark, prices, key=1):
    return spark.createDataFrame([(key, k, float(p), float(k), k) for k, p in enumerate(prices)], "market_id long, bar_ts long, close double, t double, seq long")


def test_window_excludes_its_anchor(spark):
    got = {r.bar_ts: r for r in windows.labelled(series(spark, [((k * 7) % 11) / 20 for k in range(25)])).collect()}
    assert sorted(got) == list(range(16, 21))
    p = [((k * 7) % 11) / 20 for k in range(25)]
    assert got[16].window == p[:16] and got[16].fwd == pytest.approx(p[20] - p[16])


def test_flat_windows_are_dropped(spark):
    assert windows.labelled(series(spark, [0.5] * 40)).count() == 0


def test_rising_series(spark):
    r = windows.price13(series(spark, [0.1 + 0.01 * k + 0.001 * (k % 2) for k in range(30)])).first()
    assert r.rsi > 0.9 and r.stoch_k > 0.9 and r.drift > 0


def test_coefficients_equal_the_recursion():
    rng = random.Random(1)
    xs = [rng.random() for _ in range(16)]
    for f in (fw.macd_histogram, fw.holt, lambda v: fw.ewma(v)):
        assert sum(c * x for c, x in zip(fw.coefficients(f), reversed(xs))) == pytest.approx(f(xs))


def test_polynomial_end_recovers_derivatives():
    xs = [3 + 2 * k - 0.5 * k * k for k in range(16)]
    back = list(reversed(xs))
    assert sum(c * x for c, x in zip(fw.polynomial_end(1, 2, 8), back)) == pytest.approx(2 - 15)
    assert sum(c * x for c, x in zip(fw.polynomial_end(2, 2, 8), back)) == pytest.approx(-1)


def test_bars_merge_in_any_order(spark):
    rows = [(1, float(k * 100), k, random.Random(k).random(), 10.0 * k, "BUY" if k % 2 else "SELL") for k in range(50)]
    t = spark.createDataFrame(rows, "market_id long, t double, seq long, price double, usd double, side string")
    whole = sorted(map(tuple, bars.ohlcv_flow(t, 1000).select("bar_ts", "open", "close", "high", "low", "volume").collect()))
    parts = bars.partial_bars(t.where("seq % 2 = 0"), 1000).unionByName(bars.partial_bars(t.where("seq % 2 = 1"), 1000))
    assert sorted(map(tuple, bars.merge_partial(parts).select("bar_ts", "open", "close", "high", "low", "volume").collect())) == whole


def records(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq long, prob double, market_price double, outcome double, ts double")


def test_one_trade_by_hand(spark):
    r = evaluate.results(evaluate.trades(records(spark, [(0.7, 0.5, 1.0, 1.0)]), 0.05, 0.01)).first()
    assert (r.n_trades, r.pnl, r.hit_rate) == (1, pytest.approx(0.49), 1.0)


def test_drawdown_by_hand_and_by_blocks(spark):
    rng = random.Random(2)
    t = spark.createDataFrame([(k, float(k), rng.uniform(-1, 1)) for k in range(200)], "seq long, ts double, net double")
    equity = peak = deepest = 0.0
    for r in t.orderBy("ts").collect():
        equity += r.net
        peak = max(peak, equity)
        deepest = max(deepest, peak - equity)
    assert evaluate.drawdown(t).first()[0] == pytest.approx(deepest)
    assert evaluate.drawdown_blocks(t, 7.0).first()[0] == pytest.approx(deepest)


def test_auc_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 5) / 5, 0.5, float(rng.random() > 0.5), 0.0) for _ in range(300)]
    pos, neg = [p for p, _, y, _ in rows if y > 0.5], [p for p, _, y, _ in rows if y <= 0.5]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluate.auc(records(spark, rows)).first()[0] == pytest.approx(want)
    assert evaluate.auc(records(spark, [(0.2, 0.5, 1.0, 0.0)])).first()[0] == 0.5


def test_ranks_are_exact(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.randint(0, 40))) for k in range(500)]
    got = {r.seq: r.i for r in ranks.row_index(spark.createDataFrame(rows, "seq long, v double"), "v", "seq", 8).collect()}
    assert got == {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert ranks.row_index(spark.createDataFrame([], "seq long, v double"), "v", "seq").count() == 0


def test_ranges_of_any_number_hold_every_value(spark):
    values = [None, -2.5, -1e-9, 0.0, 1e-300, 0.1, 0.25, 7.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in range(12):
        bounds = [-1.0, -1e-9, 0.0, 0.1, 0.2, 0.25, 0.3, 5.0, 7.0, 8.0, 1e300][:n]
        got = {str(r.v): r._b for r in ranks._range(df, "v", bounds).collect()}
        assert got == {str(v): sum(v is not None and (b < v or v != v) for b in bounds) for v in values}
    rng = random.Random(9)
    rows = [(k, rng.gauss(0, 1)) for k in range(3000)]
    df = spark.createDataFrame(rows, "seq long, v double")
    cut = ranks._cut(df, "v", 1500)
    assert cut.select("_b").distinct().count() > 1000
    assert {r.seq: r.i for r in ranks.row_index(df, "v", "seq", 1500).collect()} == {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: r[1]))}


def test_training_never_reaches_validation(spark):
    d = splits.out_of_time(series(spark, [k / 100 for k in range(50)]).withColumn("bar_ts", F.col("bar_ts")))
    t, v = (d.where(f"part = '{p}'").agg(F.max("bar_ts") if p == "train" else F.min("bar_ts")).first()[0] for p in ("train", "val"))
    assert t + splits.HORIZON < v
    assert splits.out_of_time(series(spark, [0.1] * 4)).where("part = 'train'").count() == 4


def test_sweep_ignores_later_outcomes(spark):
    rng = random.Random(5)
    rows = [(rng.random(), rng.random(), float(rng.random() > 0.5), float(k)) for k in range(100)]
    flipped = [(p, m, 1 - y if k >= 70 else y, t) for k, (p, m, y, t) in enumerate(rows)]
    a, b = (evaluate.chosen(records(spark, r), [0.0, 0.05, 0.1]).first().threshold for r in (rows, flipped))
    assert a == b


def test_scalars_have_defined_values(spark):
    d = spark.createDataFrame([("x", None, "['1', '0']"), ("2.5", float("nan"), "bad"), (None, float("inf"), None)], "a string, b double, c string")
    r = d.select(scalars.finite_or("a").alias("a"), scalars.finite_or("b", 7.0).alias("b"), scalars.json_strings("c").alias("c"), scalars.outcome_label("c").alias("l"), scalars.saturate("b", 1.0).alias("s")).collect()
    assert [x.a for x in r] == [0.0, 2.5, 0.0] and [x.b for x in r] == [7.0] * 3
    assert r[0].c == ["1", "0"] and r[1].c == [] and [x.l for x in r] == [1, None, None] and [x.s for x in r] == [0.0] * 3


def test_rounding_is_half_up(spark):
    assert [r[0] for r in spark.createDataFrame([(-2.5,), (2.5,), (0.49,)], "x double").select(scalars.half_up("x")).collect()] == [-2, 3, 0]


def test_single_market_has_no_robust_z(spark):
    m = spark.createDataFrame([(1, 6000.0, 7000.0, 3.0)], "market_id long, volume24h double, volume1w double, chg24h double")
    x = stats.cross_section(m)
    assert x.crossJoin(stats.population(x, "volume_ratio", "p_")).select(stats.robust_z(F.col("volume_ratio"), "p_")).first()[0] == 0.0


def test_basket_with_one_open_leg_is_no_arbitrage(spark):
    q = spark.createDataFrame([(1, True, True, 0.6, 0.61, 10.0), (1, True, False, 0.6, 0.61, 10.0)], "basket_id long, neg_risk boolean, accepting boolean, best_bid double, best_ask double, liquidity double")
    assert signals.arbitrage(q).count() == 0
    assert signals.arbitrage(q.withColumn("accepting", F.lit(True))).first().side == "sell-basket"


def test_blend_without_models_holds(spark):
    d = spark.createDataFrame([(1, "resolve", 0.9), (1, "flow", 0.8), (2, "other", 0.9)], "seq long, model string, prob double")
    b = ensemble.blend(ensemble.parsed(d)).collect()
    assert len(b) == 1 and 0.8 < b[0].prob < 0.9 and b[0].n_models == 2
    none = spark.createDataFrame([(0.5, 0.0, 0, 0.2)], "prob double, confidence double, n_models int, price double")
    assert ensemble.decide(none).first().hold_reason == "no_models"


def test_dust_and_one_sided_fills_are_dropped(spark):
    fields = "timestamp long, maker string, taker string, maker_asset_id string, taker_asset_id string, maker_amount_filled string, taker_amount_filled string, protocol_fee string, taker_fee string"
    d = spark.createDataFrame([(1, "a", "b", "tok", "0", "2000000", "1000000", None, None), (1, "a", "b", "tok", "tok", "1", "1", None, None), (1, "a", "b", "0", "0", "1", "1", None, None), (1, "a", "b", "tok", "0", "0", "1", None, None), (1, "a", "b", "tok", "0", "x", "1", None, None)], fields)
    r = normalize.fills(d).collect()
    assert len(r) == 1 and r[0].price == 0.5 and r[0].direction == 1


def test_skilled_wallet_is_found(spark):
    rows = [(k, 1, f"w{k % 20}", 0.5, 100.0, 200.0 if k % 20 == 3 else (-200.0 if k % 20 < 3 else 1.0)) for k in range(200)]
    t = spark.createDataFrame(rows, "seq long, market_id long, wallet string, price double, usd double, token_amount double").withColumn("t", F.col("seq").cast("double"))
    final = spark.createDataFrame([(1, 1.0)], "market_id long, final double")
    board = cohorts.leaderboard(cohorts.wallet_pnl(t, cohorts.market_final(t, final)))
    assert cohorts.top_share(board, 0.05).first().wallet == "w3"
    assert {r.wallet for r in cohorts.smart_and_dumb(board, 0.15).where("cohort = 'dumb'").collect()} == {"w0", "w1", "w2"}


def test_decimation_keeps_both_ends(spark):
    s = series(spark, [k / 100 for k in range(101)]).withColumnRenamed("close", "price")
    got = sorted(r.seq for r in boards.decimate(s, 11).collect())
    assert got == list(range(0, 101, 10))
    assert boards.decimate(s, 500).count() == 101


def test_fuzzy_order(spark):
    from oddsmill.operators import models

    d = spark.createDataFrame([("art",), ("the art of it",), ("a long rest at night",), ("smart",), ("xyz",), (None,)], "name string")
    got = [r.name for r in models.fuzzy_top(d, "name", "art").collect()]
    assert got[0] == "art" and "xyz" not in got and set(got) == {"art", "the art of it", "a long rest at night", "smart"}


def test_bootstrap_covers_the_mean(spark):
    from oddsmill.operators import models

    d = spark.createDataFrame([(k, float(k % 10)) for k in range(500)], "seq long, x double")
    r = models.bootstrap_mean(d, "x", "seq").first()
    assert r.low < 4.5 < r.high and r.high - r.low < 1.2


def test_temperature_is_found(spark):
    from oddsmill.operators import models

    rng = random.Random(6)
    import math

    rows = []
    for _ in range(4000):
        z = rng.gauss(0, 2)
        rows.append((1 / (1 + math.exp(-2 * z)), float(rng.random() < 1 / (1 + math.exp(-z)))))
    assert models.fit_temperature(spark.createDataFrame(rows, "prob double, outcome double")) == pytest.approx(2, abs=0.3)
