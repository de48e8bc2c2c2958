"""Queries against their SQL on tables as larger ones have them: first trades without volume, several trades at one time."""

import glob
import os

import pytest
from pyspark.sql import functions as F
from test_queries import SF, rows

from oddsmill import plans


def changed(spark, folder, events):
    """The smallest tables with other events, and DuckDB over the same files."""
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        d = spark.read.parquet(f)
        to = f"{folder}/{os.path.basename(f)}"
        (events(d).coalesce(1) if f.endswith("/events.parquet") else d).write.parquet(to)
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{to}/*.parquet')")
    return str(folder), con


@pytest.fixture(scope="module")
def empty_starts(spark, tmp_path_factory):
    """The first events of every third market have a value of zero."""
    first = F.col("event_id") < 300
    return changed(spark, tmp_path_factory.mktemp("starts"), lambda d: d.withColumn("value", F.when(first & (F.col("user_id") % 3 == 0), 0.0).otherwise(F.col("value"))))


@pytest.fixture(scope="module")
def same_times(spark, tmp_path_factory):
    """All events of a day are at one time, and some have no market."""
    return changed(spark, tmp_path_factory.mktemp("times"), lambda d: d.withColumns({"ts": F.date_trunc("day", "ts"), "user_id": F.when(F.col("event_id") % 40 != 0, F.col("user_id"))}))


def equal(spark, tables, name):
    folder, con = tables
    got, want = plans.QUERIES[name](spark, folder).toPandas(), con.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return want


def test_aligned_rows_without_flow_stay(spark, empty_starts):
    assert equal(spark, empty_starts, "align_oof")["flow"].isna().any()


def test_aligned_rows_of_one_time_are_told_apart(spark, same_times):
    assert equal(spark, same_times, "align_oof").duplicated(["market_id", "t"]).any()


def test_windows_without_volume_have_a_prediction(spark, empty_starts):
    equal(spark, empty_starts, "stacker_predict")


@pytest.fixture(scope="module")
def mixed_times(spark, tmp_path_factory):
    """Times that don't rise with the events' numbers, and a wallet that never paid anything."""
    mixed = F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, event_id * 7919 % 1000003)")
    return changed(spark, tmp_path_factory.mktemp("mixed"), lambda d: d.withColumns({"ts": mixed, "value": F.when(F.col("props") != '{"k": 7}', F.col("value")).otherwise(0.0)}))


@pytest.fixture
def moving_board(spark):
    """A board whose pnl has other last digits each time it is read, as sums of doubles from many tasks have."""
    noise = F.udf(lambda: int.from_bytes(os.urandom(2)) * 1e-12, "double").asNondeterministic()
    return spark.range(100).select(F.format_string("w%02d", "id").alias("wallet"), (F.col("id") + noise()).alias("pnl"), F.lit(1000.0).alias("volume"), F.lit(1).alias("n_markets"))


def test_best_wallets_of_a_board_that_moves(moving_board):
    from oddsmill.operators import cohorts

    assert sorted(r.wallet for r in cohorts.top_share(moving_board).collect()) == [f"w{k}" for k in range(80, 100)]


def test_best_wallets_of_mixed_times(spark, mixed_times):
    equal(spark, mixed_times, "smart_top_frac")


def test_cohorts_of_a_board_that_moves(moving_board):
    from oddsmill.operators import cohorts

    found = {r.wallet: r.cohort for r in cohorts.smart_and_dumb(moving_board).collect()}
    assert found == {f"w{k:02d}": "smart" if k >= 80 else "dumb" for k in range(100) if not 20 <= k < 80}


def test_baskets_of_equal_drift_go_by_number(spark):
    import random

    from oddsmill.operators import signals

    rng, legs = random.Random(2), []
    for basket in range(60):
        shares = [rng.random() for _ in range(5)]
        for s in shares:
            mid = 1.03 * s / sum(shares)
            legs.append((basket, True, True, mid - 0.002, mid + 0.002, 1.0))
    rng.shuffle(legs)
    quotes = spark.createDataFrame(legs, "basket_id long, neg_risk boolean, accepting boolean, best_bid double, best_ask double, liquidity double")
    assert [r.basket_id for r in signals.basket_drift(quotes).collect()] == list(range(12))


def test_all_families_of_mixed_times(spark, mixed_times):
    equal(spark, mixed_times, "feat_all66")
