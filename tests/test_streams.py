"""Streams over several batches: what the state keeps between them, timers, and batches that run again."""

import os

import pytest
from pyspark.sql import functions as F

from oddsmill.streaming import scan, state


def feed(spark, folder, batches, schema):
    """A stream of one file a batch, in this order."""
    os.makedirs(folder, exist_ok=True)
    for k, rows in enumerate(batches):
        path = f"{folder}/part-{k}.parquet"
        spark.createDataFrame(rows, schema).toPandas().to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


BOOK = "token long, seq long, kind string, side string, price double, size double"


def test_a_book_starts_at_its_snapshot(spark, tmp_path):
    batches = [
        [(1, 1, "delta", "bid", 0.4, 10.0), (2, 2, "delta", "ask", 0.6, 5.0)],
        [(1, 3, "snapshot", "bid", 0.3, 7.0), (1, 4, "delta", "ask", 0.5, 2.0), (2, 5, "delta", "bid", 0.5, 9.0)],
        [(1, 6, "delta", "bid", 0.3, 0.0), (1, 7, "delta", "bid", 0.31, 4.0)],
    ]
    out = state.drain(state.stateful(feed(spark, f"{tmp_path}/in", batches, BOOK), "token", state.Book()), f"{tmp_path}/run").collect()
    levels = lambda b: sorted((r.token, r.side, r.price, r.size) for r in out if r.batch == b and r.kind == "level")
    quotes = lambda b: sorted((r.token, r.bid, r.ask) for r in out if r.batch == b and r.kind == "quote")
    assert levels(0) == [] and sorted(quotes(0), key=repr) == sorted([(1, 0.4, None), (2, None, 0.6)], key=repr)
    assert levels(1) == [(1, "ask", 0.5, 2.0), (1, "bid", 0.3, 7.0)] and quotes(1) == [(1, 0.3, 0.5), (2, 0.5, 0.6)]
    assert levels(2) == [(1, "ask", 0.5, 2.0), (1, "bid", 0.31, 4.0)] and quotes(2) == [(1, 0.31, 0.5)]


def test_peers_expire_by_the_streams_time(spark, tmp_path):
    schema = "peer string, ts double, at timestamp, market_id long, prob double, seq long"
    t0 = 1_700_000_000
    row = lambda peer, s, seq, prob=0.7: (peer, float(t0 + s), __import__("datetime").datetime.fromtimestamp(t0 + s), 5, prob, seq)
    batches = [
        [row("a", 0, 1), row("b", 0, 2), row("me", 0, 3), row("a", 0, 4, 0.1)],
        [row("b", 40, 5)],
        [row("c", 80, 6), row("me", 400, 7)],
        [row("d", 81, 10)],
        [row("a", 84, 8), row("a", 81, 9)],
    ]
    out = state.drain(state.peers(feed(spark, f"{tmp_path}/in", batches, schema), "me", 45.0), f"{tmp_path}/run").collect()
    last = {}
    for r in sorted(out, key=lambda r: r.batch):
        last[r.peer] = (r.ts - t0, r.prob, r.alive)
    assert "me" not in last
    assert last == {"a": (84.0, 0.7, True), "b": (40.0, 0.7, True), "c": (80.0, 0.7, True), "d": (81.0, 0.7, True)}
    # the first of two messages of one time stays; the peer was dropped at 80 and came back at 84
    assert [(r.ts - t0, r.prob, r.alive) for r in sorted(out, key=lambda r: r.batch) if r.peer == "a"] == [(0.0, 0.7, True), (0.0, None, False), (84.0, 0.7, True)]


def test_alerts_fire_once_and_start_anew(spark, tmp_path):
    schema = "market_id long, seq long, kind string, op string, target double, price double"
    tick = lambda seq, p, m=1: (m, seq, "tick", "gte", 0.5, p)
    arm, off = lambda seq, t=0.5: (1, seq, "arm", "gte", t, 0.0), lambda seq: (1, seq, "disarm", "gte", 0.5, 0.0)
    batches = [
        [tick(1, 0.1), arm(2), tick(3, 0.6), tick(4, 0.4)],
        [tick(5, 0.7), tick(6, 0.3), tick(7, 0.8)],
        [arm(8), tick(9, 0.2), off(10), tick(11, 0.9), arm(12), tick(13, 0.4)],
        [arm(14), tick(15, 0.6), tick(16, 0.45), tick(17, 0.5)],
    ]
    out = state.drain(state.stateful(feed(spark, f"{tmp_path}/in", batches, schema), "market_id", state.Crossing()), f"{tmp_path}/run").collect()
    assert sorted(r.seq for r in out) == [5, 17]


def test_windows_keep_the_last_ticks(spark, tmp_path):
    prices = [0.1 * (k // 2 % 7) + 0.05 for k in range(60)]
    batches = [[(1, k, prices[k]) for k in range(a, b)] for a, b in ((0, 3), (3, 40), (40, 41), (41, 60))]
    out = state.drain(state.stateful(feed(spark, f"{tmp_path}/in", batches, "market_id long, seq long, price double"), "market_id", state.Rolling()), f"{tmp_path}/run").collect()
    for r in out:
        moved = [p for k, p in enumerate(prices[: r.seq + 1]) if k == 0 or p != prices[k - 1]]
        assert r.prices == moved[-16:]


def trades(rows):
    return [(s, s % 23, 1_700_000_000.0 + 977 * s, ((s * 37) % 90 + 5) / 100, float((s * 131) % 9000), "BUY" if s % 3 else "SELL", s % 2) for s in rows]


TAPE = "seq long, market_id long, t double, price double, usd double, side string, outcome_index int"


def scanned(spark, path, batch):
    return sorted(map(tuple, spark.read.parquet(f"{path}/scan/batch={batch}").collect()))


def test_each_scan_is_that_of_its_prefix(spark, tmp_path):
    """Folded batch by batch, over more than a week so that old hours are folded too; a batch that runs again changes nothing."""
    cuts = [(0, 400), (400, 410), (410, 1500)]
    live = scan.LiveScan(f"{tmp_path}/live", 5000.0)
    for k, (a, b) in enumerate(cuts):
        df = spark.createDataFrame(trades(range(a, b)), TAPE)
        live.fold(df, k)
        once = scanned(spark, live.path, k)
        live.fold(df, k)
        assert scanned(spark, live.path, k) == once
        whole = scan.LiveScan(f"{tmp_path}/whole{k}", 5000.0)
        whole.fold(spark.createDataFrame(trades(range(b)), TAPE), 0)
        want = scanned(spark, whole.path, 0)
        assert [r[:5] for r in once] == [r[:5] for r in want] and once and len(once) <= 30
    hours = spark.read.parquet(f"{live.path}/hours/batch=2")
    assert hours.agg(F.sum(F.col("volume") + F.col("old_volume"))).first()[0] == pytest.approx(sum(r[4] for r in trades(range(1500))))
    assert hours.count() < 1500 and hours.where("old_volume > 0").count() == 23


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    schema = "market_id long, seq long, price double"
    stream = state.stateful(feed(spark, f"{tmp_path}/in", [[(1, 1, 0.5)], [(1, 2, 0.6)]], schema), "market_id", state.Quote())
    out = state.drain(stream, f"{tmp_path}/run")
    before = sorted(map(tuple, out.collect()))
    # as after a failure between writing the last batch and noting it
    for name in os.listdir(f"{tmp_path}/run/state/commits"):
        if name.lstrip(".").startswith("1"):
            os.remove(f"{tmp_path}/run/state/commits/{name}")
    again = state.drain(state.stateful(feed(spark, f"{tmp_path}/in", [[(1, 1, 0.5)], [(1, 2, 0.6)]], schema), "market_id", state.Quote()), f"{tmp_path}/run")
    assert sorted(map(tuple, again.collect())) == before == [(1, 0.5, 0, 1, 0), (1, 0.6, 1, 2, 1)]
