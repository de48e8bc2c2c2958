"""Streams over the driver's tables, run to their end; their batch twins are the SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import derivatives, windows
from ..sources.driver_tables import SECONDS
from ..streaming import scan, state
from .family_queries import NET_FEATURES, NETWORK, SCORE_SQL
from .registry import VIEWS, query
from .scan_queries import _path

#: A terminal's own name among the peers, and how long a message lives here: the tape has one for a peer in some hours.
ME, LIFETIME = "w7", 21600


def _stream(d, name: str):
    """A table as a stream of its files; a pattern serves a lone file and a folder of them alike."""
    return d.spark.readStream.schema(d.table(name).schema).option("maxFilesPerTrigger", 4).parquet(f"{d.sf_dir}/{name}.parque[t]")


def ticks(d):
    buy = F.col("event_type").isin("purchase", "signup", "click")
    return _stream(d, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("market_id"), F.expr(SECONDS).alias("t"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / (F.col("value") + 50)).alias("price"), (F.col("value") * 100).alias("usd"),
        F.when(buy, "BUY").otherwise("SELL").alias("side"), F.when(F.col("event_type").isin("signup", "error"), 1).otherwise(0).alias("outcome_index"), "event_type",
    )


VIEWS["feed"] = """select l_suppkey as token, l_orderkey * 10 + l_linenumber as seq, case when l_linenumber = 7 then 'snapshot' else 'delta' end as kind,
  case when l_linestatus = 'O' then 'bid' else 'ask' end as side, round(l_discount, 2) as price, case when l_quantity > 45 then 0 else l_quantity end as size from lineitem"""


def _book(d):
    m = _stream(d, "lineitem").select(
        F.col("l_suppkey").alias("token"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linenumber") == 7, "snapshot").otherwise("delta").alias("kind"),
        F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"), F.round("l_discount", 2).alias("price"), F.when(F.col("l_quantity") > 45, 0.0).otherwise(F.col("l_quantity")).alias("size"),
    )
    return state.newest(state.drain(state.stateful(m, "token", state.Book()), _path(d, "book")), "token")


@query("stream_book_state", """with k as (select feed.* from feed join (select token, max(seq) as s from feed where kind = 'snapshot' group by 1) x using (token) where seq >= s)
select token, side, price, arg_max(size, seq) as size from k group by 1, 2, 3 having arg_max(size, seq) > 0""", "price size")
def _(d):
    return _book(d).where("kind = 'level'").select("token", "side", "price", "size")


@query("stream_book_quote", "select token, arg_max(price, seq) filter (where side = 'bid') as bid, arg_max(price, seq) filter (where side = 'ask') as ask from (select *, kind = 'delta' or size > 0 as moves from feed) group by token, moves having moves union all select token, null, null from feed group by 1 having not bool_or(kind = 'delta' or size > 0)", "bid ask")
def _(d):
    return _book(d).where("kind = 'quote'").select("token", "bid", "ask")


@query("stream_quote_state", "select market_id, arg_max(price, seq) as price, arg_max(sign(step), seq)::int as tick from (select *, price - lag(price) over (partition by market_id order by seq) as step from tape) group by 1", "price")
def _(d):
    out = state.drain(state.stateful(ticks(d), "market_id", state.Quote()), _path(d, "quote"))
    return state.newest(out, "market_id").select("market_id", "price", "tick")


#: A sign-up arms a market's alert, an error disarms it; all else is a tick.
VIEWS["alert_feed"] = "select t.*, a.op, a.target, case event_type when 'signup' then 'arm' when 'error' then 'disarm' else 'tick' end as kind from (select event_id as seq, user_id as market_id, value / (value + 50) as price, event_type from events) t join alerts a using (market_id)"
_cross = """with s as (select *, sum((kind <> 'tick')::int) over (partition by market_id order by seq) as session from alert_feed),
p as (select s.*, lag(price) over (partition by market_id, session order by seq) as before from s where kind = 'tick'),
armed as (select market_id, session from s where kind = 'arm'),
hits as (select p.*, row_number() over (partition by market_id, session order by seq) as k from p join armed using (market_id, session)
  where (op = 'gte' and before < target and price >= target) or (op = 'lte' and before > target and price <= target))
select market_id, op, target, price, seq from hits where k = 1"""


@query("stream_alert_crossing", _cross, "target price")
def _(d):
    kind = F.when(F.col("event_type") == "signup", "arm").when(F.col("event_type") == "error", "disarm").otherwise("tick")
    armed = ticks(d).withColumn("kind", kind).join(d.alerts, "market_id")
    return state.drain(state.stateful(armed, "market_id", state.Crossing()), _path(d, "alerts")).drop("batch")


VIEWS["live_tails"] = """select market_id, list(price order by seq) as win from (select *, row_number() over (partition by market_id order by seq desc) as k from (
  select market_id, seq, price, lag(price) over (partition by market_id order by seq) as before from tape) where before is null or before <> price) where k <= 16 group by 1"""
VIEWS["live_newest"] = VIEWS["newest"].replace("from tails", "from (" + re.sub(r"from \(select market_id, list.*$", "from live_tails where len(win) = 16", VIEWS["tails"], flags=re.S) + ")")


@query("stream_rolling_window", f"select market_id, len(win) as n, list_sum(win) as total, prob, direction, conviction from live_tails left join ({SCORE_SQL.replace('newest', 'live_newest')}) using (market_id)", "total prob conviction")
def _(d):
    # the model reads each full window as the state gives it; a window that isn't full has no reading
    out = windows.of_array(state.stateful(ticks(d), "market_id", state.Rolling()), "prices")
    out = state.newest(state.drain(derivatives.network_signal(out, NET_FEATURES, NETWORK), _path(d, "rolling")), "market_id")
    return out.select("market_id", F.size("prices").cast("long").alias("n"), F.aggregate("prices", F.lit(0.0), lambda s, x: s + x).alias("total"), "prob", "direction", "conviction")


def _messages(d):
    return _stream(d, "events").select(F.concat(F.lit("w"), F.get_json_object("props", "$.k")).alias("peer"), F.expr(SECONDS).alias("ts"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("market_id"), (F.col("value") / (F.col("value") + 50)).alias("prob"), F.col("event_id").alias("seq"))


def _latest(d, lifetime: float):
    return state.newest(state.drain(state.peers(_messages(d), ME, lifetime), _path(d, "peers")), "peer")


VIEWS["peer_latest"] = f"select wallet as peer, max(t) as ts, arg_max(market_id, t) as market_id, arg_max(price, t) as prob from tape where wallet <> '{ME}' group by 1"


@query("stream_peer_latest", f"""select peer, ts, case when alive then market_id end as market_id, case when alive then prob end as prob, alive from (
  select *, floor((select max(ts) from peer_latest) * 1000) - floor(ts * 1000) <= {LIFETIME * 1000} as alive from peer_latest)""", "ts prob")
def _(d):
    return _latest(d, LIFETIME).drop("seq")


@query("consensus", """select market_id, count(*) filter (where prob > 0.5) as bulls, count(*) filter (where prob < 0.5) as bears, count(*) as voters, avg(prob) as mean_prob,
  case when count(*) filter (where prob <> 0.5) > 0 then (count(*) filter (where prob > 0.5) - count(*) filter (where prob < 0.5)) / count(*) filter (where prob <> 0.5) else 0 end as agreement
  from peer_latest where floor((select max(ts) from peer_latest) * 1000) - floor(ts * 1000) <= 86400000 group by 1""", "mean_prob agreement")
def _(d):
    return state.consensus(_latest(d, 86400.0).where("alive"), float("-inf"))


@query("stream_bars", "select * from bars", "open high low close volume signed_vol buy_vol sell_vol whale_vol")
def _(d):
    return state.newest(state.drain(state.live_bars(ticks(d), 21600, "30 days", 1000.0), _path(d, "bars")), "market_id", "bar_ts")


@query("stream_flow_blocks", "select market_id, (floor(t / 3600) * 3600 - k * 3600)::bigint as start, sum(case when side = 'BUY' then usd else -usd end) as net, count(*) as n from tape, range(2) r(k) where usd >= 2000 group by 1, 2", "net")
def _(d):
    f = ticks(d).where("usd >= 2000").withWatermark("ts", "30 days").groupBy("market_id", F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.sum(F.when(F.col("side") == "BUY", F.col("usd")).otherwise(-F.col("usd"))).alias("net"), F.count("*").alias("n"))
    f = f.select("market_id", F.expr("timestampdiff(SECOND, timestamp'1970-01-01 00:00:00', w.start)").alias("start"), "net", "n")
    return state.newest(state.drain(f, _path(d, "flow")), "market_id", "start")


#: The live scan's markets: turnover of whole hours, no books and no histories.
VIEWS["s_market"] = """select market_id, arg_max(price, seq) as last, true as accepting, max(t) + 86400 as "end",
  sum(case when h > edge - 86400 then usd else 0 end) as volume24h, sum(case when h > edge - 7 * 86400 then usd else 0 end) as volume1w,
  100 * (arg_max(price, t) - coalesce(arg_max(price, t) filter (where h <= edge - 86400), arg_max(price, t))) as chg24h
  from (select *, floor(t / 3600) * 3600 as h from tape), (select floor(max(t) / 3600) * 3600 as edge from tape) group by 1"""
VIEWS["s_books"] = "select * from book_stats where false"
VIEWS["s_history"] = "select * from history where false"
_names = {"market": "s_market", "cross_s": "s_cross", "pops": "s_pops", "wide": "s_wide", "found": "s_found", "scored": "s_scored", "book_stats": "s_books", "history": "s_history"}
for _old in ("cross_s", "pops", "wide", "found", "scored"):
    VIEWS[_names[_old]] = re.sub(r"\b(" + "|".join(_names) + r")\b", lambda m: _names[m[0]], VIEWS[_old])


@query("stream_scan_snapshot", """select market_id, heat, bias, conviction, row_number() over (order by heat desc, market_id) as rank, (select count(*) from s_scored) as flagged,
  (select count(*) from s_scored where bias > 10) as bullish, (select count(*) from s_scored where bias < -10) as bearish from s_scored order by heat desc, market_id limit 30""", "heat bias conviction")
def _(d):
    path = _path(d, "scan")
    scan.run(ticks(d), path, 5000.0)
    out = d.spark.read.parquet(f"{path}/scan")
    return out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


@query("stream_trade_dedupe", "select count(*) as n from tape")
def _(d):
    twice = ticks(d).withColumn("id", F.concat(F.lit("h"), "seq")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withWatermark("ts", "30 days")
    return state.drain(twice.dropDuplicatesWithinWatermark(["id"]), _path(d, "trades"), "append").agg(F.count("*").alias("n"))
