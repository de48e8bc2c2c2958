"""Queries against their SQL on the smallest tables, one or more of each family; all are compared on larger ones by the driver."""

import glob
import os

import pandas as pd
import pytest

from oddsmill import plans

SF = "/root/testdata/sf0.001"
NAMES = [
    "bars_ohlcv_flow", "bars_partial_merge", "bars_multi_resolution", "feat_price13", "triple_barrier_label", "sg_endpoint", "deriv_estimators", "feat_flow20",
    "book_stats", "score_market", "signal_order", "rank_scan", "find_arbitrage", "find_basket_drift", "robust_z", "vol_compression", "normalize_market", "normalize_fill",
    "nearest_sample", "event_panel_align", "series_decimate", "depth_ladder", "movers", "auc", "top_bottom_quantile", "decile_ladder", "max_drawdown", "chosen_threshold",
    "split_oot_purged", "split_walk_forward", "blend", "best_signal", "smart_dumb_cohorts", "time_cutoff_quantile", "sink_series", "stream_book_state", "stream_alert_crossing",
    "deriv_family25", "score_logistic_signal", "score_tree_dump", "score_mlp", "feat_event11", "feat_smart6", "snap_named24", "sequence_summary10", "feat_all66", "trend_consistency",
    "stream_book_quote", "stream_peer_latest", "stream_bars", "stream_rolling_window", "stream_scan_snapshot", "fit_logistic", "stacker_fit", "two_model_combiner", "feature_importance_families", "calibrate_logit", "bootstrap_ci", "fuzzy_topk", "train_quantile_threshold",
]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(df: pd.DataFrame) -> list:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return f"{float(x):.6g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)

    return sorted(tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def with_zero(spark, tmp_path_factory):
    """The smallest tables, some events of which have a value of zero, as larger ones do."""
    import duckdb
    from pyspark.sql import functions as F

    folder = tmp_path_factory.mktemp("zero")
    for f in glob.glob(f"{SF}/*.parquet"):
        d = spark.read.parquet(f)
        if f.endswith("/events.parquet"):
            d = d.withColumn("value", F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(F.col("value"))).coalesce(1)
        d.write.parquet(f"{folder}/{os.path.basename(f)}")
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}/*.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", ["wallet_pnl", "wallet_leaderboard", "portfolio_totals", "portfolio_sort", "holders_topk", "scan_holders", "scan_user_parquet", "feat_micro14", "feat_smart10", "realized_spread", "wei_to_units", "scan_positions", "normalize_fill"])
def test_prices_of_zero(spark, with_zero, name):
    folder, con = with_zero
    got, want = plans.QUERIES[name](spark, folder).toPandas(), con.sql(plans.SQL[name]).df()
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(plans.QUERIES) - set(plans.SQL) == {"fit_gbdt", "fit_mlp", "ablation_pair"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
