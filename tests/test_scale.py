"""Plans for hot keys and whole-table quantiles: the same results, and no task that holds a whole key or table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmill.operators import derivatives, fills, ranks, windows
from oddsmill.sources.driver_tables import Domain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(3)
    rows = []
    for m, n in ((1, 400), (2, 30), (3, 90), (None, 25)):
        p = 0.5
        for k in range(n):
            p = min(0.95, max(0.05, p + rng.uniform(-0.05, 0.05)))
            h, l = p + rng.random() * 0.03, p - rng.random() * 0.03
            buy, sell = rng.random() * 900, rng.random() * 900
            rows.append((m, 21600 * (k + k // 7), p + 0.001, h, l, p, buy + sell, rng.randint(1, 9), buy - sell, buy, sell, buy / 2))
    return spark.createDataFrame(rows, "market_id long, bar_ts long, open double, high double, low double, close double, volume double, trades long, signed_vol double, buy_vol double, sell_vol double, whale_vol double").persist()


def table(df):
    out = [tuple(None if x is None else round(x, 9) if isinstance(x, float) else repr(x) for x in r) for r in df.select(*sorted(df.columns)).collect()]
    return sorted(out, key=repr)


@pytest.mark.parametrize("f", [windows.labelled, windows.price13, windows.triple_barrier, windows.range_features, windows.polynomial, windows.trend_estimators, windows.flow_features, windows.flow11, windows.ohlcv20, windows.big22, derivatives.family25], ids=lambda f: f.__name__)
def test_stretches_give_what_the_whole_key_gives(spark, bars, f):
    cut = windows.over_stretches(lambda b, k: f(b, key=k), bars, [1, 3], rows=37)
    assert sorted(cut.columns) == sorted(f(bars).columns)
    assert table(cut) == table(f(bars))


def test_hot_keys_are_found_and_cut(spark, bars):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert windows.hot_keys(bars, least=50) == [1]
    assert windows.hot_keys(bars) == []
    # every task of the cut key has about 37 rows and its halo: partitions of the feature's window are (key, stretch)
    sizes = []

    def look(b, k):
        sizes.extend(r["count"] for r in b.where(F.col(k)["key"] == 1).groupBy(k).count().collect())
        return b.select(k, "bar_ts")

    windows.over_stretches(look, bars, [1], rows=37).count()
    assert len(sizes) == 11 and max(sizes) <= 37 + windows.WINDOW + 1 + windows.HORIZON + 1


def test_fills_of_a_hot_market(spark):
    d = Domain(spark, SF)
    from oddsmill.plans.fill_queries import fill_rows

    whole, hot = fill_rows(d), [r.market_id for r in d.tape.groupBy("market_id").count().orderBy(F.desc("count")).limit(2).collect()]
    old = windows.STRETCH_ROWS
    try:
        fills.over_stretches.__defaults__ = tuple(20 if x == old else x for x in fills.over_stretches.__defaults__)
        cut = table(fills.micro14(whole, hot=hot)), table(fills.smart10(d.tape, d.tape.select("wallet").where("wallet < 'w4'"), hot=hot))
    finally:
        fills.over_stretches.__defaults__ = tuple(old if x == 20 else x for x in fills.over_stretches.__defaults__)
    assert cut[0] == table(fills.micro14(whole)) and cut[1] == table(fills.smart10(d.tape, d.tape.select("wallet").where("wallet < 'w4'")))


def test_a_fill_is_shuffled_a_few_times_only(spark):
    """Rows written to shuffles by the fill features stay within a small multiple of the tape's."""
    d = Domain(spark, SF)
    from oddsmill.plans.fill_queries import fill_rows

    plan = fills.micro14(fill_rows(d))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan


@pytest.mark.parametrize("bins", [1 << 16, 4])
def test_quantiles_are_exact(spark, bins):
    rng = random.Random(bins)
    values = [rng.lognormvariate(0, 3) for _ in range(500)] + [1.0] * 120 + [-5.0, 1e12] + [None, float("nan")]
    groups = {g: [v for k, v in enumerate(values) if k % 3 == i or g == "b"] for i, g in enumerate("abc")} | {"d": [7.0], "e": [None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r.g: r for r in ranks.quantiles(df, "v", {"m": 0.5, "low": 0.1, "high": 0.93, "top": 1.0}, "g", bins).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    for g, r in got.items():
        xs = [v for v in groups[g] if v is not None and v == v]
        assert [r.m, r.low, r.high, r.top] == pytest.approx(np.quantile(xs, [0.5, 0.1, 0.93, 1.0]).tolist())
    one = ranks.quantiles(df.where("g = 'b'"), "v", {"m": 0.5}, bins=bins).first()
    assert one.m == pytest.approx(got["b"].m)
    assert [r.m for r in ranks.quantiles(df.limit(0), "v", {"m": 0.5}).collect()] == [None]


def test_no_exact_percentile_of_a_whole_table(spark):
    from oddsmill import plans

    for name in ("robust_z", "enrich_markets", "top_bottom_quantile", "train_quantile_threshold", "selective_short_ledger"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            assert not (line.strip(" +-:").startswith("Aggregate [") and ("median(" in line or "percentile(" in line)), (name, line)
