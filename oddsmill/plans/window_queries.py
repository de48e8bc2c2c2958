"""Windows, their features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as fw
from ..operators import windows
from .registry import VIEWS, query


def _dot(coefficients: list[float], p: str = "close") -> str:
    """The SQL form of a dot product with the window, newest value first."""
    return "(" + " + ".join(f"({c!r}::double) * lag({p}, {k}) over w" for k, c in enumerate(coefficients, 1) if c) + ")"


VIEWS["steps"] = "select *, close - lag(close) over (partition by market_id order by bar_ts) as d from bars"
VIEWS["anchors"] = """select * from (select *, lead(close, 4) over w - close as fwd, row_number() over w - 1 as i, count(*) over (partition by market_id) as n,
    stddev_samp(d) over (partition by market_id order by bar_ts rows between 15 preceding and 1 preceding) as step_std,
    list(close) over (partition by market_id order by bar_ts rows between 16 preceding and 1 preceding) as win,
    list(d) over (partition by market_id order by bar_ts rows between 15 preceding and 1 preceding) as rets,
    lag(close) over w as last,
    """ + _dot(fw.coefficients(fw.macd_histogram)) + """ as macd_hist
  from steps window w as (partition by market_id order by bar_ts)) where i >= 16 and fwd is not null and step_std >= 1e-4"""
VIEWS["feats"] = """select *, list_aggregate(rets, 'avg') as mean_ret, list_aggregate(rets, 'stddev_samp') as vol, last - win[1] as drift,
  case when list_aggregate(win, 'stddev_samp') > 1e-9 then (last - list_aggregate(win, 'avg')) / list_aggregate(win, 'stddev_samp') else 0 end as band_z,
  list_aggregate(rets[12:15], 'avg') as momentum, list_sum([abs(x) for x in rets]) as activity,
  (select case when sum(c * c) > 1e-12 then greatest(-1, least(1, sum(c * c0) / sum(c * c))) else 0 end from (
     select x - m as c, lag(x - m) over (order by k) as c0 from (select unnest(rets) as x, unnest(range(15)) as k, list_aggregate(rets, 'avg') as m))) as autocorr,
  (select case when sum(abs(x)) > 1e-9 then sum(x) / sum(abs(x)) else 0 end from (select unnest(rets) as x)) as rsi,
  (select case when avg(abs(x - m)) >= 1e-9 then greatest(-5, least(5, (last - any_value(m)) / (0.015 * avg(abs(x - m))) / 100)) else 0 end from (select unnest(win) as x, list_aggregate(win, 'avg') as m)) as cci,
  case when list_max(win) - list_min(win) >= 1e-9 then (last - list_min(win)) / (list_max(win) - list_min(win)) else 0.5 end as stoch_k,
  coalesce(list_aggregate([x for x in rets if x < 0], 'stddev_samp'), 0) as downside_vol, case when fwd > 0 then 1 else 0 end as label from anchors"""
P13 = "last mean_ret vol drift band_z momentum autocorr activity rsi cci macd_hist stoch_k downside_vol"


@query("windows_labelled", "select market_id, bar_ts, case when fwd > 0 then 1 else 0 end as label, fwd, i / n as tfrac, list_sum(win) as window_sum from anchors", "fwd tfrac window_sum")
def _(d):
    s = d.windowed(windows.labelled)
    return s.select("market_id", "bar_ts", "label", "fwd", "tfrac", F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("window_sum"))


@query("feat_price13", f"select market_id, bar_ts, label, fwd, {', '.join(P13.split())} from feats", "fwd " + P13)
def _(d):
    return d.windowed(windows.price13)


for _name, _cols in {"rsi": "rsi", "cci": "cci", "macd_hist": "macd_hist", "downside_vol": "downside_vol"}.items():
    query(_name, f"select market_id, bar_ts, {_cols} from feats", _cols)(lambda d, c=_cols: d.windowed(windows.price13).select("market_id", "bar_ts", c))


@query("triple_barrier_label", """with a as (select *, 1.5 * step_std as barrier, lead1, lead2, lead3, lead4 from anchors join (select market_id, bar_ts,
  lead(close, 1) over w - close as lead1, lead(close, 2) over w - close as lead2, lead(close, 3) over w - close as lead3, lead(close, 4) over w - close as lead4
  from bars window w as (partition by market_id order by bar_ts)) using (market_id, bar_ts)),
b as (select *, case when abs(lead1) >= barrier then sign(lead1) when abs(lead2) >= barrier then sign(lead2) when abs(lead3) >= barrier then sign(lead3) when abs(lead4) >= barrier then sign(lead4) end as touch from a)
select market_id, bar_ts, barrier, case when touch is not null then (touch > 0)::int else (fwd > 0)::int end as label, case when touch is not null then touch * barrier else fwd end as fwd from b""", "barrier fwd")
def _(d):
    return d.windowed(windows.triple_barrier)


_range = """select * from (select market_id, bar_ts, row_number() over w - 1 as i, lag(close) over w as last, avg(tr) over (partition by market_id order by bar_ts rows between 15 preceding and 1 preceding) as tr,
  avg(pk) over f as park, max(high) over f as hi, min(low) over f as lo from (select *, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr,
  case when high > low and low > 0 then ln(high / low) ** 2 end as pk from bars window w as (partition by market_id order by bar_ts))
  window w as (partition by market_id order by bar_ts), f as (partition by market_id order by bar_ts rows between 16 preceding and 1 preceding)) where i >= 16"""


@query("atr", f"select market_id, bar_ts, tr / greatest(last, 1e-3) as atr from ({_range})", "atr")
def _(d):
    return d.windowed(windows.range_features).select("market_id", "bar_ts", "atr")


@query("parkinson_vol", f"select market_id, bar_ts, coalesce(sqrt(park / (4 * ln(2.0::double))), 0) as parkinson_vol from ({_range})", "parkinson_vol")
def _(d):
    return d.windowed(windows.range_features).select("market_id", "bar_ts", "parkinson_vol")


@query("stoch_williams", f"select market_id, bar_ts, case when hi - lo >= 1e-9 then (last - hi) / (hi - lo) else -0.5 end as williams_r, case when hi - lo >= 1e-9 then (last - lo) / (hi - lo) else 0.5 end as stoch_k from ({_range})", "williams_r stoch_k")
def _(d):
    return d.windowed(windows.range_features).select("market_id", "bar_ts", "williams_r", "stoch_k")


@query("oscillator_states", """select market_id, bar_ts, case when (rsi + 1) * 50 >= 70 then 'overbought' when (rsi + 1) * 50 <= 30 then 'oversold' else 'neutral' end as rsi_state,
  case when cci * 100 >= 100 then 'overbought' when cci * 100 <= -100 then 'oversold' else 'neutral' end as cci_state from feats""")
def _(d):
    return windows.oscillator_states(d.windowed(windows.price13)).select("market_id", "bar_ts", "rsi_state", "cci_state")


@query("windows_strided", "select market_id, bar_ts, fwd from (select *, row_number() over (partition by market_id order by bar_ts) - 1 as r from anchors) where r % 3 = 0", "fwd")
def _(d):
    return windows.strided(d.windowed(windows.labelled), 3).select("market_id", "bar_ts", "fwd")


_points = (5, 8, 12, 16)


@query("sg_endpoint", "select market_id, bar_ts, " + ", ".join(f"velocity_{n}, acceleration_{n}" for n in _points) + " from (select market_id, bar_ts, row_number() over w - 1 as i, " + ", ".join(f"{_dot(fw.polynomial_end(1, 2, n))} as velocity_{n}, {_dot(fw.polynomial_end(2, 2, n))} as acceleration_{n}" for n in _points) + " from bars window w as (partition by market_id order by bar_ts)) where i >= 16", " ".join(f"velocity_{n} acceleration_{n}" for n in _points))
def _(d):
    return d.windowed(windows.polynomial).drop("trend_consistency")


@query("trend_consistency", f"""select market_id, bar_ts, sign(v) * case when v > 0 then ups when v < 0 then 15 - ups else 0 end / 15 as trend_consistency from (
  select market_id, bar_ts, row_number() over w - 1 as i, {_dot(fw.polynomial_end(1, 1, 16))} as v, count(*) filter (where d > 0) over f as ups
  from steps window w as (partition by market_id order by bar_ts), f as (partition by market_id order by bar_ts rows between 15 preceding and 1 preceding)) where i >= 16""", "trend_consistency")
def _(d):
    return d.windowed(windows.polynomial).select("market_id", "bar_ts", "trend_consistency")


@query("deriv_estimators", f"select market_id, bar_ts, sg1, sg2, holt, kalman, tvdiff, ewma_ret from (select market_id, bar_ts, row_number() over w - 1 as i, regr_slope(close, rn) over f as sg1, {_dot(fw.polynomial_end(1, 2, 16))} as sg2, {_dot(fw.coefficients(fw.holt))} as holt, {_dot(fw.coefficients(fw.kalman))} as kalman, {_dot(fw.coefficients(fw.smooth_increment))} as tvdiff, {_dot(fw.coefficients(lambda xs: fw.ewma([b - a for a, b in zip(xs, xs[1:])])))} as ewma_ret from (select *, row_number() over (partition by market_id order by bar_ts) as rn from bars) window w as (partition by market_id order by bar_ts), f as (partition by market_id order by bar_ts rows between 16 preceding and 1 preceding)) where i >= 16", "sg1 sg2 holt kalman tvdiff ewma_ret")
def _(d):
    return d.windowed(windows.trend_estimators)


_W = "window w as (partition by market_id order by bar_ts), f as (partition by market_id order by bar_ts rows between 16 preceding and 1 preceding), g as (partition by market_id order by bar_ts rows between 15 preceding and 1 preceding), q as (partition by market_id order by bar_ts rows between 4 preceding and 1 preceding)"
F20 = "last mean_ret vol drift band_z momentum rsi atr parkinson_vol signed_imbalance ofi_last ofi_trend vpin toxicity trade_intensity buy_pressure whale_ratio vol_z extremeness log_volume"


VIEWS["flow20"] = f"""select market_id, bar_ts, last, mean_ret, vol, drift, case when sc > 1e-9 then (last - mc) / sc else 0 end as band_z, momentum, case when ad > 1e-9 then sd / ad else 0 end as rsi,
  tr / greatest(last, 1e-3) as atr, coalesce(sqrt(pk / (4 * ln(2.0::double))), 0) as parkinson_vol, signed_imbalance, ofi_last, ofi_trend, vpin, abs(ofi_trend) * (1 + greatest(vol_z, 0)) as toxicity, trade_intensity, buy_pressure, whale_ratio, vol_z,
  abs(last - 0.5) * 2 as extremeness, log_volume from (
  select market_id, bar_ts, row_number() over w - 1 as i, lag(close) over w as last, avg(d) over g as mean_ret, stddev_pop(d) over g as vol, lag(close) over w - lag(close, 16) over w as drift, avg(close) over f as mc, stddev_pop(close) over f as sc,
  avg(d) over q as momentum, sum(d) over g as sd, sum(abs(d)) over g as ad, avg(tr) over g as tr, avg(pk) over f as pk, sum(signed_vol) over f / (sum(volume) over f + 1e-9) as signed_imbalance, lag(signed_vol) over w / (lag(volume) over w + 1e-9) as ofi_last,
  sum(signed_vol) over q / (sum(volume) over q + 1e-9) as ofi_trend, coalesce(avg(case when buy_vol + sell_vol > 1e-9 then abs(buy_vol - sell_vol) / (buy_vol + sell_vol) end) over f, 0) as vpin,
  (lag(volume) over w - avg(volume) over f) / (stddev_pop(volume) over f + 1e-9) as vol_z, (lag(trades) over w - avg(trades) over f) / (stddev_pop(trades) over f + 1e-9) as trade_intensity, sum(buy_vol) over f / (sum(volume) over f + 1e-9) as buy_pressure,
  sum(whale_vol) over f / (sum(volume) over f + 1e-9) as whale_ratio, ln(1 + sum(volume) over f + 1e-9) as log_volume from (select *, greatest(high - low, abs(high - lag(close) over v), abs(low - lag(close) over v)) as tr,
  case when high > low and low > 0 then ln(high / low) ** 2 end as pk from steps window v as (partition by market_id order by bar_ts)) {_W}) where i >= 16"""


@query("feat_flow20", "select * from flow20", F20)
def _(d):
    return d.windowed(windows.flow_features)


F11 = "signed_imbalance vpin toxicity trade_intensity flow_autocorr whale_ratio buy_pressure last mean_ret vol momentum"
_flow11 = f"""select market_id, bar_ts, greatest(-1, least(1, fl / v)) as signed_imbalance, vpin, toxicity, trade_intensity,
  (select case when sum(c * c) > 1e-12 then greatest(-1, least(1, sum(c * c0) / sum(c * c))) else 0 end from (select x - m as c, lag(x - m) over (order by k) as c0 from (select unnest(flows) as x, unnest(range(16)) as k, list_aggregate(flows, 'avg') as m))) as flow_autocorr,
  list_sum(list_reverse_sort(vols)[1:3]) / v as whale_ratio, (v + fl) / (2 * v) as buy_pressure, last, mean_ret, vol, momentum from (
  select market_id, bar_ts, row_number() over w - 1 as i, sum(signed_vol) over f as fl, sum(volume) over f as v, avg(case when volume > 1e-9 then abs(signed_vol) / volume end) over f as vpin, {_dot([float(k) for k in range(16, 0, -1)], "r")} / 136 as toxicity,
  (lag(trades) over w - avg(trades) over f) / (stddev_samp(trades) over f + 1e-9) as trade_intensity, list(signed_vol) over f as flows, list(volume) over f as vols, lag(close) over w as last, avg(d) over g as mean_ret, stddev_samp(d) over g as vol, avg(d) over q as momentum
  from (select *, case when volume > 1e-9 then abs(signed_vol) / volume else 0 end as r from steps) {_W}) where i >= 16"""


VIEWS["flow11"] = _flow11


@query("feat_flow11", _flow11, F11)
def _(d):
    return d.windowed(windows.flow11)


@query("whale_ratio", f"select market_id, bar_ts, whale_ratio from ({_flow11})", "whale_ratio")
def _(d):
    return d.windowed(windows.flow11).select("market_id", "bar_ts", "whale_ratio")


VIEWS["cross8"] = """with r as (select market_id, basket_id, last as price, neg_risk, count(*) over b as n, sum(last) over b as s, stddev_samp(last) over b as sd,
  (select max(o.last) from market o where o.basket_id = m.basket_id and o.market_id <> m.market_id) as other, (select count(*) from market o where o.basket_id = m.basket_id and o.last > m.last) as higher from market m window b as (partition by basket_id))
select market_id, basket_id, price, case when w then s else price end as basket_sum, case when w then s - 1 else 0 end as residual, case when w then price / s else 1 end as share, n - 1 as sibling_count, case when w then higher / (n - 1) else 0 end as rank,
  case when w then price - other else 0 end as favourite_gap, case when w then sd else 0 end as dispersion, neg_risk::int as neg_risk from (select *, neg_risk and n >= 2 as w from r)"""


@query("feat_crossmarket8", VIEWS["cross8"], "price basket_sum residual share rank favourite_gap dispersion")
def _(d):
    return windows.crossmarket(d.market.withColumnRenamed("last", "price"))


R12 = "at_share price dist_from_half logit_price time_to_resolution age_fraction momentum realized_vol flow_imbalance volume_maturity trade_count_z calib_bucket price_x_time"


VIEWS["resolve12"] = """with s as (select *, row_number() over w - 1 as i, count(*) over (partition by market_id) as n, sum(usd) over (partition by market_id order by t, seq rows unbounded preceding) as vol, sum(usd) over (partition by market_id) as total,
  first_value(price) over l as p0, stddev_samp(d) over (partition by market_id order by t, seq rows between 22 preceding and current row) as sd, sum(case when side = 'BUY' then usd else -usd end) over l as fl, sum(usd) over l as v, count(*) over l as k
  from (select *, price - lag(price) over (partition by market_id order by t, seq) as d from tape) window w as (partition by market_id order by t, seq), l as (partition by market_id order by t, seq rows between 23 preceding and current row)),
x as (select s.*, f as at_share, "end", created, greatest(1e-4, least(0.9999, price)) as q from s join market using (market_id), (values (0.2::double), (0.4), (0.6), (0.8)) v(f) where i = floor(n * f))
select market_id, at_share, t, price, abs(price - 0.5) as dist_from_half, greatest(-1, least(1, ln(q / (1 - q)) / 9.2)) as logit_price, ("end" - t) / ("end" - created) as time_to_resolution, (t - created) / ("end" - created) as age_fraction, price - p0 as momentum,
  coalesce(least(1, sd), 0) as realized_vol, fl / v as flow_imbalance, vol / total as volume_maturity, (k - 50) / (50 + 1e-9) as trade_count_z, 0.5 * (least(floor(price * 10), 9) + 0.5) / 10 + 0.5 * price as calib_bucket, abs(price - 0.5) * ("end" - t) / ("end" - created) as price_x_time from x"""


@query("feat_resolve12", "select * exclude (t) from resolve12", R12)
def _(d):
    return windows.snapshots(d.tape, d.market.select("market_id", "created", "end")).drop("t")


@query("snap_fractions_simple", "select market_id, f as at_share, price from (select *, row_number() over (partition by market_id order by t, seq) - 1 as i, count(*) over (partition by market_id) as n from tape), (values (0.2::double), (0.4), (0.6), (0.8)) v(f) where i = floor(n * f)", "at_share price")
def _(d):
    return windows.snapshots(d.tape, d.market.select("market_id", "created", "end")).select("market_id", "at_share", "price")
