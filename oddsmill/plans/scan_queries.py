"""Scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import scans, sinks
from .registry import query
from .signal_queries import ranked


@query("scan_markets", "select market_id, last, volume24h from market where accepting order by volume24h desc, market_id limit 20 offset 10", "last volume24h")
def _(d):
    return scans.markets(d.market, 20, 10).select("market_id", "last", "volume24h")


@query("scan_events", "select basket_id, count(*) as legs, sum(volume24h) as volume24h from market group by 1", "volume24h")
def _(d):
    return d.market.groupBy("basket_id").agg(F.count("*").alias("legs"), F.sum("volume24h").alias("volume24h"))


@query("scan_trades", "select seq, market_id, usd from tape where usd >= 2000 order by t desc, seq desc limit 500", "usd")
def _(d):
    return scans.prints(d.tape, 2000.0).select("seq", "market_id", "usd")


@query("scan_books", "select * from book where token in (select s_suppkey from supplier where s_nationkey < 5)", "price size")
def _(d):
    return scans.books(d.book, d.table("supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("token")))


@query("scan_history", "select market_id, (floor(t / 3600) * 3600)::bigint as bucket, arg_max(price, t) as price from tape where t > (select max(t) from tape) - 604800 group by 1, 2", "price")
def _(d):
    return scans.history(d.tape, "1w", d.now)


@query("scan_positions", "select market_id, size, abs(size * cur) as value from positions where wallet = 'w7' and abs(size) >= 1", "size value", 4)
def _(d):
    return scans.positions(d.positions, "w7").select("market_id", "size", "value")


@query("scan_trade_parquet", "select event_id, user_id, value from events", "value")
def _(d):
    return d.table("events").select("event_id", "user_id", "value")


@query("scan_market_parquet_for_trades", "select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49)")
def _(d):
    return d.table("part").join(d.table("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("scan_ohlcv_parquet", "select * from (select market_id, bar_ts, close, count(*) over (partition by market_id) as n_candles from bars) where n_candles >= 50", "close")
def _(d):
    return scans.candles(d.bars, 50).select("market_id", "bar_ts", "close", "n_candles")


@query("universe_tokens", "select market_id, volume, n_points from market join (select market_id, count(*) as n_points from tape group by 1) using (market_id) where n_points >= 24 order by volume desc, market_id limit 50", "volume")
def _(d):
    return scans.universe(d.market, d.tape, 50)


def _path(d, name: str) -> str:
    """A new folder where the session keeps its shared files."""
    root = d.spark.sparkContext.getConf().get("spark.checkpoint.dir") or d.spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("sink_series", "select market_id, seq, price from tape", "price")
def _(d):
    path = _path(d, "series")
    sinks.series(d.tape.select("market_id", "t", "seq", "price"), path)
    return d.spark.read.parquet(path).select("market_id", "seq", "price")


@query("sink_scan_snapshot", "select (select count(*) from ranked) as flagged, r as rank, market_id, score, heat, bias from (select market_id, round(score, 9) as score, heat, bias, row_number() over (order by round(score, 9) desc, market_id) as r from ranked) where r <= 30", "score heat bias")
def _(d):
    r, path = ranked(d).withColumn("score", F.round("score", 9)).persist(), _path(d, "snapshots")
    for run, at in enumerate((1.0, 2.0, 2.0)):  # the last one is the second again
        sinks.append(sinks.scan_snapshot(r, r.agg(F.count("*").alias("flagged")), at), path, min(run, 1))
    r.unpersist()
    last = d.spark.read.parquet(path).where("at = 2.0").select("flagged", F.posexplode("top").alias("k", "x"))
    return last.select("flagged", (F.col("k") + 1).cast("long").alias("rank"), "x.market_id", (-F.col("x.order")).alias("score"), "x.heat", "x.bias")


@query("sink_event_log", """select epoch_us(ts) as at, event_type as level, 'event ' || event_id as event, '{"user_id":' || user_id || ',"kind":"' || event_type || '"}' as context from events""")
def _(d):
    path = _path(d, "log")
    rows = d.table("events").select(F.col("ts").alias("at"), F.col("event_type").alias("level"), F.concat(F.lit("event "), "event_id").alias("event"), F.struct("user_id", F.col("event_type").alias("kind")).alias("context"))
    for _ in range(2):  # a run that is repeated adds nothing
        sinks.event_log(rows, path, "a")
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', at)")
    return d.spark.read.parquet(path).select(at.alias("at"), "level", "event", "context")


@query("sink_leaderboard", "select market_id, round(score, 6) as score from (select market_id, score from ranked order by round(score, 9) desc, market_id limit 20)", "score")
def _(d):
    path = _path(d, "leaderboard")
    sinks.leaderboard(ranked(d).orderBy(F.desc(F.round("score", 9)), "market_id").limit(20).select("market_id", "score"), path)
    return d.spark.read.schema("market_id long, score double").json(path)


@query("window_cache", "select market_id, bar_ts, fwd from anchors", "fwd")
def _(d):
    from ..operators import windows

    path = _path(d, "windows")
    d.windowed(windows.labelled).select("market_id", "bar_ts", "fwd").write.parquet(path)
    return d.spark.read.parquet(path)
