"""Statistics, detectors, scores and baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals, stats
from .registry import VIEWS, query

VIEWS["history"] = """
select market_id, n, case when n >= 3 and span / (n - 1) > 0 then sd * sqrt(86400 / (span / (n - 1))) * 100 else 0 end as realised_vol,
  case when n >= 3 then coalesce(slope, 0) else 0 end as drift_per_day,
  case when n >= 9 and den > 1e-12 then greatest(-1, least(1, num / den)) else 0 end as autocorr,
  case when n >= 12 and tail_std >= 1e-6 then (p_last - tail_mean) / tail_std else 0 end as band_z,
  case when n >= 24 and early >= 1e-9 then late / early else 1 end as vol_compression
from (select market_id, count(*) as n, stddev_samp(d) as sd, max(t) - min(t) as span, regr_slope(p * 100, (t - t0) / 86400) as slope,
    sum(dm * dm0) as num, sum(dm * dm) as den, stddev_samp(d) filter (where i >= n // 2 + 2) as late,
    stddev_samp(d) filter (where i >= 2 and i <= n // 2) as early, avg(p) filter (where i > n - 60) as tail_mean,
    stddev_samp(p) filter (where i > n - 60) as tail_std, arg_max(p, t) as p_last
  from (select *, lag(dm) over (partition by market_id order by t, seq) as dm0 from (
    select *, d - avg(d) over (partition by market_id) as dm from (
      select market_id, t, seq, price as p, price - lag(price) over w as d, row_number() over w as i,
        count(*) over (partition by market_id) as n, min(t) over (partition by market_id) as t0
      from tape window w as (partition by market_id order by t, seq))))
  group by market_id)"""
VIEWS["book_stats"] = """
with lv as (select *, row_number() over (partition by token, side order by case when side = 'bid' then -price else price end) as r from book),
g as (select token, max(price) filter (where side = 'bid') as best_bid, min(price) filter (where side = 'ask') as best_ask,
  max(size) filter (where side = 'bid' and r = 1) as bid_size, max(size) filter (where side = 'ask' and r = 1) as ask_size,
  coalesce(sum(price * size) filter (where side = 'bid' and r <= 10), 0) as bid_notional,
  coalesce(sum((1 - price) * size) filter (where side = 'ask' and r <= 10), 0) as ask_notional from lv group by token),
h as (select *, (best_bid + best_ask) / 2 as mid, best_ask - best_bid as spread from g where best_bid is not null and best_ask is not null),
k as (select h.*, coalesce((select sum(price * size) from book b where b.token = h.token and side = 'ask' and price <= h.mid + 0.01::double), 0) as cost_up,
  coalesce((select sum(price * size) from book b where b.token = h.token and side = 'bid' and price >= h.mid - 0.01::double), 0) as cost_down from h)
select token, best_bid, best_ask, mid, spread, (bid_size * best_ask + ask_size * best_bid) / (bid_size + ask_size) as micro_price,
  ((bid_size * best_ask + ask_size * best_bid) / (bid_size + ask_size) - mid) * 100 as micro_lean,
  (bid_notional - ask_notional) / (bid_notional + ask_notional) as imbalance, bid_notional, ask_notional, cost_up, cost_down,
  case when cost_up <= cost_down then 'offer' else 'bid' end as thin_side,
  (1 - greatest(0, least(1, spread / mid / 0.1::double))) * least(bid_notional, ask_notional) / (least(bid_notional, ask_notional) + 15000) as liquidity_score from k"""
VIEWS["cross_s"] = """select market_id, case when volume1w / 7 > 500 then ln(volume24h / (volume1w / 7)) end as volume_ratio, abs(chg24h) as abs_move from market where volume24h >= 5000"""
VIEWS["pops"] = """select vr.*, am.* from (
  select count(volume_ratio) as vr_n, any_value(m) as vr_median, 1.4826 * median(abs(volume_ratio - m)) as vr_mad, avg(volume_ratio) as vr_mean, stddev_samp(volume_ratio) as vr_std
    from cross_s, (select median(volume_ratio) as m from cross_s)) vr, (
  select count(abs_move) as am_n, any_value(m) as am_median, 1.4826 * median(abs(abs_move - m)) as am_mad, avg(abs_move) as am_mean, stddev_samp(abs_move) as am_std
    from cross_s, (select median(abs_move) as m from cross_s)) am"""
VIEWS["block_flow"] = """select market_id, sum(case when (outcome_index = 0) = (side = 'BUY') then usd else -usd end) as net, count(*) as count, sum(usd) as gross
  from tape where usd >= 5000 group by 1"""


def _z(x: str, p: str) -> str:
    return f"case when {p}n < 4 then 0 when {p}mad > 1e-9 then ({x} - {p}median) / {p}mad when {p}std > 1e-9 then ({x} - {p}mean) / {p}std else 0 end"


def _sat(x: str, h: float) -> str:
    return f"(case when {x} > 0 then ({x}) / (({x}) + {h}) else 0 end)"


VIEWS["wide"] = f"""select m.*, net, f.count, gross, n as n_points, realised_vol, drift_per_day, autocorr, band_z, vol_compression, mid, spread, micro_lean, imbalance,
  bid_notional, ask_notional, liquidity_score, case when volume1w / 7 >= 1000 then volume24h / (volume1w / 7) end as ratio,
  {_z("ln(greatest(volume24h / greatest(volume1w / 7, 1), 1e-6))", "vr_")} as volume_z, {_z("abs(chg24h)", "am_")} as move_z,
  {_z("ln(volume24h / (volume1w / 7))", "vr_")} as surge_z, ("end" - now) / 3600 as hours
  from market m left join block_flow f using (market_id) left join book_stats b on b.token = m.market_id left join history using (market_id), pops, (select max(t) as now from tape)
  where volume24h >= 5000 and accepting and last > 0.015 and last < 0.985"""
_dir = "case when {0} > 0 then 'bullish' else 'bearish' end"
_clamp = "greatest({1}, least({2}, {0}))"
_one = "(abs(net) / gross)"
_sev = f"greatest({_sat('greatest(0, spread / mid - 0.05)', 0.2)}, {_clamp.format('(0.2 - liquidity_score) / 0.2', 0, 1)})"
_lean = "(micro_lean / (spread * 100))"
DETECTOR_SQL = {
    "SURGE": ("ratio >= 1.5 and floor(100 * " + _sat("surge_z", 2.5) + " + 0.5) >= 12", "case when chg24h > 1 then 'bullish' when chg24h < -1 then 'bearish' else 'neutral' end", _sat("surge_z", 2.5), _clamp.format(_sat("volume24h", 50000), 0.3, 1), "surge_z"),
    "MOMENTUM": ("n_points >= 12 and realised_vol >= 1e-6 and abs(drift_per_day / realised_vol) >= 0.35", _dir.format("drift_per_day"), f"{_sat('abs(drift_per_day / realised_vol)', 0.9)} * {_clamp.format('0.5 + autocorr', 0.2, 1)}", _clamp.format(_sat("n_points::double", 60), 0.3, 1), "drift_per_day / realised_vol"),
    "REVERSAL": ("n_points >= 20 and abs(band_z) >= 1.6 and autocorr <= 0.05", _dir.format("-band_z"), _sat("abs(band_z) - 1.4", 1.4), _clamp.format(_sat("0.15 - autocorr", 0.25), 0.25, 0.9), "band_z"),
    "BREAKOUT": ("n_points >= 24 and abs(band_z) >= 1.8 and autocorr > 0.05 and vol_compression >= 1.2", _dir.format("band_z"), f"{_sat('abs(band_z) - 1.5', 1.2)} * {_clamp.format('vol_compression / 2', 0.4, 1)}", _clamp.format(_sat("autocorr", 0.2), 0.3, 0.95), "band_z"),
    "COIL": ("n_points >= 30 and vol_compression <= 0.55 and abs(band_z) <= 1.5", "'neutral'", _sat("0.55 - vol_compression", 0.3), "0.55", "vol_compression"),
    "WHALE": ("abs(net) >= 10000", _dir.format("net"), f"{_sat('abs(net) / greatest(volume24h, 1)', 0.08)} * 0.6 + {_one} * 0.4", _clamp.format(f"{_sat('count::double', 3)} * {_one} + 0.2", 0.2, 1), "null"),
    "IMBALANCE": ("bid_notional + ask_notional >= 5000 and abs(imbalance) >= 0.35", _dir.format("imbalance"), _sat("abs(imbalance) - 0.3", 0.35), _clamp.format(_sat("bid_notional + ask_notional", 40000), 0.25, 1), "imbalance"),
    "LEAN": (f"spread > 0 and abs({_lean}) >= 0.18", _dir.format("micro_lean"), _sat(f"abs({_lean}) - 0.15", 0.3), _clamp.format(_sat("bid_notional + ask_notional", 25000), 0.2, 0.85), _lean),
    "TAIL": ("(last <= 0.06 or last >= 0.94) and volume24h >= 25000", "'neutral'", _sat("volume24h / 25000", 3), "0.5", "null"),
    "EXPIRY": ("hours > 0 and hours <= 72 and last >= 0.12 and last <= 0.88", "'neutral'", _sat("72 - hours", 36), "0.8", "null"),
    "THIN": (f"mid > 0 and spread >= 0.01 and {_sev} >= 0.15", "'neutral'", _sev, "0.7", "spread / mid"),
}
VIEWS["found"] = " union all ".join(f"select market_id, '{k}' as kind, {d} as direction, floor(100 * ({s}) + 0.5)::double as strength, ({c})::double as confidence, ({z})::double as z from wide where {w}" for k, (w, d, s, c, z) in DETECTOR_SQL.items())
VIEWS["weights"] = "select * from (values " + ", ".join(f"('{k}', {w}::double)" for k, w in signals.WEIGHTS.items()) + ") v(kind, weight)"
VIEWS["scored"] = f"""select market_id, n_signals, greatest(0, least(100, floor(100 * {_sat("h", 90)} + 0.5)))::double as heat,
  greatest(-100, least(100, floor(s / 1.5 + 0.5)))::double as bias, case when d > 0 then floor(100 * abs(s / d) + 0.5) else 0 end::double as conviction from (
  select market_id, count(*) as n_signals, sum(strength * weight * confidence) as h,
    sum(strength * weight * confidence * case direction when 'bullish' then 1 when 'bearish' then -1 else 0 end) as s,
    sum(case when direction = 'neutral' then 0 else strength * weight * confidence end) as d from found join weights using (kind) group by 1)"""
#: A model's reading for the blend: the last of one prediction column.
VIEWS["reading"] = "select market_id, arg_max(flow, t) as prob, 2 * abs(arg_max(flow, t) - 0.5) as model_conviction from preds group by 1"
AUC = 0.65


def wide(d):
    flow = signals.block_flow(d.tape, 5000.0)
    return signals.enrich(signals.tradeable(d.market), d.market, flow, stats.book_stats(d.book), stats.history_stats(d.tape), d.now)


def reading(d):
    p = d.preds.groupBy("market_id").agg(F.max_by("flow", "t").alias("prob"))
    return p.withColumn("model_conviction", 2 * F.abs(F.col("prob") - 0.5))


def scored(d):
    return signals.score(signals.detect(wide(d)))


def ranked(d):
    s = scored(d).join(reading(d), "market_id", "left")
    return s.withColumns({"agreement": signals.agreement(), "score": signals.blended(AUC)})


for _kind in signals.KINDS:
    query(f"sig_{_kind.lower()}", f"select * from found where kind = '{_kind}'", "strength confidence z")(lambda d, k=_kind: signals.detect(wide(d), (k,)))


@query("enrich_markets", "select market_id, last, net, n_points, mid, spread, liquidity_score, realised_vol, volume_z, move_z from wide", "last net mid spread liquidity_score realised_vol volume_z move_z")
def _(d):
    return wide(d).select("market_id", "last", "net", "n_points", F.col("b_mid").alias("mid"), F.col("b_spread").alias("spread"), F.col("b_liquidity_score").alias("liquidity_score"), "realised_vol", "volume_z", "move_z")


@query("score_market", "select * from scored", "heat bias conviction")
def _(d):
    return scored(d)


@query("signal_order", "select f.*, row_number() over (partition by market_id order by strength * weight * confidence desc, kind) as rank from found f join weights using (kind)", "strength confidence z")
def _(d):
    return signals.order_signals(signals.detect(wide(d)))


@query("market_stats", "select market_id, realised_vol, drift_per_day, case when realised_vol > 1e-6 then drift_per_day / realised_vol else 0 end as trend_quality, autocorr, band_z, vol_compression, volume_z, move_z from wide", "realised_vol drift_per_day trend_quality autocorr band_z vol_compression volume_z move_z")
def _(d):
    quality = F.when(F.col("realised_vol") > 1e-6, F.col("drift_per_day") / F.col("realised_vol")).otherwise(0.0)
    return wide(d).select("market_id", "realised_vol", "drift_per_day", quality.alias("trend_quality"), "autocorr", "band_z", "vol_compression", "volume_z", "move_z")


VIEWS["ranked"] = f"""select s.*, prob, model_conviction, case when prob is null or model_conviction < 0.08 or abs(bias) < 8 then 'neutral' when (prob - 0.5) * bias > 0 then 'confirms' else 'conflicts' end as agreement,
  case when prob is null then heat else greatest(0, least(100, heat * (1 + {(AUC - 0.5) / 0.2} * model_conviction * greatest(-1, least(1, (prob - 0.5) * 2 * bias / 100)) * 0.3))) end as score
  from scored s left join reading using (market_id)"""


@query("model_agreement", "select market_id, bias, prob, model_conviction, agreement from ranked", "bias prob model_conviction")
def _(d):
    return ranked(d).select("market_id", "bias", "prob", "model_conviction", "agreement")


@query("blended_score", "select market_id, heat, score from ranked", "heat score")
def _(d):
    return ranked(d).select("market_id", "heat", "score")


@query("rank_scan", "select market_id, heat, bias, conviction, agreement, score from ranked order by round(score, 9) desc, market_id limit 60", "heat bias conviction score")
def _(d):
    return ranked(d).orderBy(F.desc(F.round("score", 9)), "market_id").limit(60).select("market_id", "heat", "bias", "conviction", "agreement", "score")


@query("scan_stats", """select (select count(*) from market) as scanned, count(*) as flagged, count(*) filter (where bias > 10) as bullish, count(*) filter (where bias < -10) as bearish,
  count(*) filter (where prob is not null) as modelled, count(*) filter (where agreement = 'confirms') as confirms, count(*) filter (where agreement = 'conflicts') as conflicts from ranked""")
def _(d):
    n = d.market.agg(F.count("*").alias("scanned"))
    r = ranked(d).agg(F.count("*").alias("flagged"), F.count_if(F.col("bias") > 10).alias("bullish"), F.count_if(F.col("bias") < -10).alias("bearish"), F.count("prob").alias("modelled"), F.count_if(F.col("agreement") == "confirms").alias("confirms"), F.count_if(F.col("agreement") == "conflicts").alias("conflicts"))
    return n.crossJoin(r)


_basket = """(select basket_id, count(*) as legs, bool_and(neg_risk and accepting) as ok, sum(best_bid) as sb, sum(best_ask) as sa, max(best_ask) as ta, max(best_ask - best_bid) as w,
  min(liquidity) as tightest_leg_liquidity from quote group by 1)"""


@query("find_arbitrage", f"""select basket_id, case when sb > 1.005 then 'sell-basket' else 'buy-basket' end as side, case when sb > 1.005 then sb else sa end as basket,
  100 * case when sb > 1.005 then sb - 1 else 1 - sa end as edge_points, legs, tightest_leg_liquidity from {_basket} where ok and legs >= 2 and tightest_leg_liquidity > 0 and (sb > 1.005 or (ta < 0.99 and sa < 0.995))""", "basket edge_points tightest_leg_liquidity")
def _(d):
    return signals.arbitrage(d.quote)


@query("find_basket_drift", f"""select * from (select basket_id, (sb + sa) / 2 as basket, (sa - sb) * 50 as noise_points, legs, ((sb + sa) / 2 - 1) * 100 as drift_points,
  abs(((sb + sa) / 2 - 1) * 100) / ((sa - sb) * 50) as ratio from {_basket} where ok and legs >= 2 and ta < 0.99 and w <= 0.1) where abs(drift_points) <= 25 and ratio >= 1 order by ratio desc, basket_id limit 12""", "basket noise_points drift_points ratio")
def _(d):
    return signals.basket_drift(d.quote)


@query("deep_scan", "select market_id, volume24h from market order by volume24h desc, market_id limit 48", "volume24h")
def _(d):
    return signals.deep_scan(d.market).select("market_id", "volume24h")


@query("block_flow", "select * from block_flow", "net gross")
def _(d):
    return signals.block_flow(d.tape, 5000.0)


@query("block_notional", "select sum(usd) as notional from tape where usd >= 5000", "notional")
def _(d):
    return d.tape.where("usd >= 5000").agg(F.sum("usd").alias("notional"))


@query("mean_std_median", "with m as (select market_id, median(price) as md from tape group by 1) select market_id, avg(price) as mean, coalesce(stddev_samp(price), 0) as std, any_value(md) as median, case when count(*) < 2 then 0 else 1.4826 * median(abs(price - md)) end as mad from tape join m using (market_id) group by 1", "mean std median mad")
def _(d):
    return stats.describe(d.tape, "market_id", "price")


@query("mad", "with m as (select market_id, median(usd) as md from tape group by 1) select market_id, case when count(*) < 2 then 0 else 1.4826 * median(abs(usd - md)) end as mad from tape join m using (market_id) group by 1", "mad")
def _(d):
    return stats.describe(d.tape, "market_id", "usd").select("market_id", "mad")


@query("robust_z", f"select market_id, {_z('volume_ratio', 'vr_')} as z from cross_s, pops where volume_ratio is not null", "z")
def _(d):
    cross = stats.cross_section(d.market).where("volume_ratio is not null")
    return cross.crossJoin(F.broadcast(stats.population(cross, "volume_ratio", "vr_"))).select("market_id", stats.robust_z(F.col("volume_ratio"), "vr_").alias("z"))


@query("percentile_of", "select market_id, cume_dist() over (order by abs_move) as share from cross_s", "share")
def _(d):
    cross = stats.cross_section(d.market)
    return stats.percentile_of(cross.select("market_id", "abs_move"), "abs_move").select("market_id", "share")


@query("cross_section", "select * from cross_s", "volume_ratio abs_move")
def _(d):
    return stats.cross_section(d.market)


for _name in ("realised_vol", "drift_per_day", "autocorr", "band_z", "vol_compression"):
    query("autocorr_lag1" if _name == "autocorr" else _name, f"select market_id, n, {_name} from history", _name)(lambda d, c=_name: stats.history_stats(d.tape).select("market_id", "n", c))


@query("book_stats", "select * from book_stats", "best_bid best_ask mid spread micro_price micro_lean imbalance bid_notional ask_notional cost_up cost_down liquidity_score")
def _(d):
    return stats.book_stats(d.book)


@query("pearson", "select market_id, coalesce(corr(price, usd), 0) as r from tape group by 1", "r")
def _(d):
    return d.tape.groupBy("market_id").agg(stats.correlation(F.col("price"), F.col("usd")).alias("r"))


@query("ols_beta", "select market_id, case when var_samp(usd) < 1e-9 then 0 else coalesce(greatest(-10, least(10, regr_slope(price, usd))), 0) end as beta from tape group by 1", "beta")
def _(d):
    return d.tape.groupBy("market_id").agg(stats.ols_beta(F.col("price"), F.col("usd")).alias("beta"))


@query("hhi", "select market_id, sum(w * w) / (sum(w) * sum(w)) as hhi from (select market_id, wallet, sum(usd) as w from tape group by 1, 2) group by 1", "hhi")
def _(d):
    return stats.hhi(d.tape, ["market_id"], "wallet", "usd")


@query("coef_variation", "select market_id, greatest(stddev_pop(usd) / avg(usd), 0) as cv from tape group by 1", "cv")
def _(d):
    return d.tape.groupBy("market_id").agg(stats.coef_variation("usd").alias("cv"))
