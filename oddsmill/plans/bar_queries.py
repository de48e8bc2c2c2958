"""Bars."""

from __future__ import annotations

from ..operators import bars
from .registry import query

ALL = "open high low close volume signed_vol buy_vol sell_vol whale_vol"


@query("bars_ohlcv_flow", "select * from bars", ALL)
def _(d):
    return d.bars


@query("bars_ohlcv_simple", "select * from (select market_id, bar_ts, open, high, low, close, volume, trades, signed_vol as signed_flow, count(*) over (partition by market_id) as n_bars from bars) where n_bars >= 48", "open high low close volume signed_flow")
def _(d):
    return bars.ohlcv_simple(d.tape, 21600, 48)


@query("bars_partial_merge", "select * from bars", ALL)
def _(d):
    parts = [bars.partial_bars(d.tape.where(f"seq % 3 = {k}"), 21600) for k in range(3)]
    return bars.merge_partial(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("bars_vwap", "select market_id, (floor(t / 3600) * 3600)::bigint as bar_ts, case when sum(usd) > 0 then sum(price * usd) / sum(usd) else arg_max(price, t) end as close, sum(usd) as volume, count(*) as fills from tape group by 1, 2", "close volume")
def _(d):
    return bars.vwap(d.tape)


@query("bars_last_price", "select market_id, (floor(t / 3600) * 3600)::bigint as bar_ts, arg_max(price, t) as close from tape group by 1, 2", "close")
def _(d):
    return bars.last_price(d.tape)


@query("bars_multi_resolution", """
with busy as (select market_id, row_number() over (order by count(*) desc, market_id) as r from tape group by 1),
keep as (select s as seconds, market_id from busy, (values (60, 20), (300, 30), (900, 40)) v(s, top) where r <= top)
select seconds, market_id, (floor(t / seconds) * seconds)::bigint as bar_ts, arg_min(price, t) as open, max(price) as high, min(price) as low,
  arg_max(price, t) as close, sum(usd) as volume, count(*) as trades from tape join keep using (market_id) group by 1, 2, 3""", "open high low close volume")
def _(d):
    return bars.multi_resolution(d.tape, {60: 20, 300: 30, 900: 40})


@query("bar_sequence_channels", """select market_id, bar_ts, (close - before) / greatest(before, 1e-6) as ret, (high - low) / greatest(close, 1e-6) as range, (close - open) / greatest(close, 1e-6) as body,
  ln(1 + volume) as log_volume, signed_vol / (volume + 1e-9) as flow, ln(1 + trades::double) as log_trades from (select *, coalesce(lag(close) over (partition by market_id order by bar_ts), close) as before from bars)""", "ret range body log_volume flow log_trades")
def _(d):
    return bars.channels(d.bars)


