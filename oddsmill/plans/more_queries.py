"""Wide families, sequences, and what is fitted on top of them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..operators import ensemble, evaluate, models, windows
from .evaluation_queries import _stats
from .model_queries import FEATURES, _rows, _split60, auc_sql, newton_sql, odds_sql
from .registry import VIEWS, query
from .window_queries import P13, _dot, _range


@query("snap_path7", """with s as (select *, row_number() over w - 1 as i, count(*) over (partition by market_id) as n, sum(volume) over (partition by market_id order by bar_ts rows unbounded preceding) / sum(volume) over (partition by market_id) as volume_maturity,
  avg(d) over (partition by market_id order by bar_ts rows between 3 preceding and current row) as momentum, stddev_samp(d) over e as realized_vol, (count(*) filter (where d > 0) over e - count(*) filter (where d < 0) over e) / count(d) over e as flow_imbalance
  from steps window w as (partition by market_id order by bar_ts), e as (partition by market_id order by bar_ts rows between 7 preceding and current row))
select market_id, bar_ts, close as price, abs(close - 0.5) as dist_from_half, (n - 1 - i) / n as time_to_resolution, momentum, realized_vol, flow_imbalance, volume_maturity from s where i >= 8""", "price dist_from_half time_to_resolution momentum realized_vol flow_imbalance volume_maturity")
def _(d):
    w, whole = W.partitionBy("market_id").orderBy("bar_ts"), W.partitionBy("market_id")
    eight = w.rowsBetween(-7, 0)
    s = d.bars.withColumn("d", F.col("close") - F.lag("close").over(w))
    s = s.withColumns({
        "i": F.row_number().over(w) - 1, "n": F.count("*").over(whole), "volume_maturity": F.sum("volume").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum("volume").over(whole), "momentum": F.avg("d").over(w.rowsBetween(-3, 0)),
        "realized_vol": F.stddev_samp("d").over(eight), "flow_imbalance": F.sum(F.signum("d")).over(eight) / F.count("d").over(eight),
    }).where("i >= 8")
    return s.select("market_id", "bar_ts", F.col("close").alias("price"), F.abs(F.col("close") - 0.5).alias("dist_from_half"), ((F.col("n") - 1 - F.col("i")) / F.col("n")).alias("time_to_resolution"), "momentum", "realized_vol", "flow_imbalance", "volume_maturity")


@query("tape_sequences", """with s as (select *, row_number() over w - 1 as i, count(*) over (partition by market_id) as n, count(*) over e as n_seq, sum(usd) over e as total_usd, sum(case when side = 'BUY' then usd else -usd end) over e as total_flow
  from tape window w as (partition by market_id order by t, seq), e as (partition by market_id order by t, seq rows between 47 preceding and current row)) select market_id, f as at_share, n_seq, total_usd, total_flow from s, (values (0.4::double), (0.6), (0.8), (0.9)) v(f) where i = floor(n * f)""", "at_share total_usd total_flow")
def _(d):
    s = sequences(d)
    total = lambda c: F.aggregate("steps", F.lit(0.0), lambda a, x: a + x[c])
    return s.select("market_id", "at_share", F.size("steps").cast("long").alias("n_seq"), total("usd").alias("total_usd"), total("flow").alias("total_flow"))


def sequences(d, length: int = 48, shares=(0.4, 0.6, 0.8, 0.9)):
    """The trailing trades at shares of each market's tape, as arrays made at the selected rows only."""
    w = W.partitionBy("market_id").orderBy("t", "seq")
    flow = F.when(F.col("side") == "BUY", F.col("usd")).otherwise(-F.col("usd"))
    s = d.tape.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy("market_id")), "step": F.struct("t", "price", "usd", flow.alias("flow"))})
    s = s.withColumn("steps", F.collect_list("step").over(w.rowsBetween(-(length - 1), 0)))
    at = F.array(*[F.struct(F.lit(x).alias("share"), F.floor(F.col("n") * x).alias("i")) for x in shares])
    return s.withColumn("at", F.explode(F.filter(at, lambda x: x["i"] == F.col("i")))).select("market_id", F.col("at.share").alias("at_share"), "steps")


@query("split_end_date", """with e as (select market_id, "end", row_number() over (order by "end", market_id) - 1 as i, count(*) over () as n from market), b as (select max("end") filter (where i = floor(n * 0.6::double)) as b1, max("end") filter (where i = floor(n * 0.75::double)) as b2 from e)
select market_id, case when "end" < b1 then 'train' when "end" < b2 then 'calibrate' else 'test' end as part from e, b""")
def _(d):
    from ..operators import ranks

    e = ranks.row_index(d.market.select("market_id", F.col("end").alias("e")), "e", "market_id")
    cut = lambda q: F.max(F.when(F.col("i") == F.floor(F.col("n") * q), F.col("e")))
    b = e.agg(cut(0.6).alias("b1"), cut(0.75).alias("b2"))
    return e.crossJoin(F.broadcast(b)).select("market_id", F.when(F.col("e") < F.col("b1"), "train").when(F.col("e") < F.col("b2"), "calibrate").otherwise("test").alias("part"))


_bands = (0.0, 0.02, 0.05, 0.1)
VIEWS["split70"] = "select *, row_number() over (order by ts, seq) - 1 < floor(count(*) over () * 0.7::double) as train from records"


@query("band_by_train_sharpe", f"""with g as (select unnest([{', '.join(f'{b!r}::double' for b in _bands)}]) as band), x as (select band, train, case when prob > 0.5 + band then fwd when prob < 0.5 - band then -fwd end - 0.003 as ret from split70, g),
t as (select band, {_stats} from x where train and ret is not null group by 1), best as (select band from t order by sharpe desc, band limit 1)
select band, {_stats} from x where not train and ret is not null and band = (select band from best) group by 1""", "band pnl mean_ret sharpe hit")
def _(d):
    g = d.spark.createDataFrame([(b,) for b in _bands], "band double")
    x = evaluate.by_time(d.records, 0.7).crossJoin(F.broadcast(g))
    side = F.when(F.col("prob") > 0.5 + F.col("band"), 1).when(F.col("prob") < 0.5 - F.col("band"), -1)
    x = x.withColumn("ret", side * F.col("fwd") - 0.003).where("ret is not null")
    best = evaluate.strategy_stats(x.where("train"), "band").orderBy(F.desc("sharpe"), "band").limit(1).select("band")
    return evaluate.strategy_stats(x.where("not train").join(F.broadcast(best), "band"), "band")


@query("estimator_bakeoff", " union all ".join(f"""select '{n}' as feature, (sum(k) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2.0) / (count(*) filter (where label = 1) * count(*) filter (where label = 0)) as auc
  from (select case when fwd > 0 then 1 else 0 end as label, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as k from (select fwd, round(v, 9) as v from anchors join (select market_id, bar_ts, {_dot(c)} as v from bars window w as (partition by market_id order by bar_ts)) using (market_id, bar_ts)))""" for n, c in (("sg2", fw.polynomial_end(1, 2, 16)), ("holt", fw.coefficients(fw.holt)))), "auc", 5)
def _(d):
    t = d.windowed(windows.trend_estimators).join(d.windowed(windows.labelled).select("market_id", "bar_ts", "label", "fwd"), ["market_id", "bar_ts"])
    return models.auc_of(t.select("label", "fwd", F.round("sg2", 9).alias("sg2"), F.round("holt", 9).alias("holt")), ["sg2", "holt"]).select("feature", "auc")


@query("weight_blend_search", """with w as (select k / 20.0 as w from range(21) r(k)), x as (select w, outcome, rank() over (partition by w order by v) + (count(*) over (partition by w, v) - 1) / 2.0 as k from (select w, outcome, round(w * prob + (1 - w) * flow, 9) as v from records, w)),
a as (select w::double as weight, (sum(k) filter (where outcome > 0.5) - count(*) filter (where outcome > 0.5) * (count(*) filter (where outcome > 0.5) + 1) / 2.0) / (count(*) filter (where outcome > 0.5) * count(*) filter (where outcome <= 0.5)) as auc from x group by 1)
select weight, auc from a order by round(auc, 9) desc, weight limit 1""", "weight auc", 5)
def _(d):
    # every blend's distinct scores with their counts, then ranks by weight: 21 orders of counts, none of them of all rows
    w = d.spark.createDataFrame([(k / 20,) for k in range(21)], "weight double")
    v = F.round(F.col("weight") * F.col("prob") + (1 - F.col("weight")) * F.col("flow"), 9)
    c = d.records.crossJoin(F.broadcast(w)).groupBy("weight", v.alias("v")).agg(F.count_if(F.col("outcome") > 0.5).alias("p"), F.count_if(F.col("outcome") <= 0.5).alias("q"))
    below = F.coalesce(F.sum("q").over(W.partitionBy("weight").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    a = c.withColumn("won", F.col("p") * (below + F.col("q") / 2)).groupBy("weight").agg((F.sum("won") / (F.sum("p") * F.sum("q"))).alias("auc"))
    return a.orderBy(F.desc(F.round("auc", 9)), "weight").limit(1)


# fitted networks: no SQL


@query("ablation_pair")
def _(d):
    rows = _rows(d).where("part is not null").persist()
    found = []
    for features in (FEATURES, [f for f in FEATURES if f != "momentum"]):
        scored = models.fit_mlp(rows, features, hidden=8, rounds=20)(rows.where("part = 'val'"))
        found.append(evaluate.auc(scored, "prob", "label").first()[0])
    rows.unpersist()
    return d.spark.range(1).select(F.lit(found[0]).alias("auc_with"), F.lit(found[1]).alias("auc_without"), F.lit(found[0] - found[1]).alias("lift"))


STACK = ["resolve", "flow", "smart"]
_odds = lambda p: f"ln(greatest(1e-6, least(1 - 1e-6, {p})) / (1 - greatest(1e-6, least(1 - 1e-6, {p}))))"
VIEWS["stacked"] = f"""select seq, outcome, case when row_number() over (order by ts, seq) - 1 < floor(count(*) over () * 0.7::double) then 'train' else 'val' end as part, {_odds('prob')} as resolve, {_odds('flow')} as flow, {_odds('smart')} as smart
  from records where smart is not null"""


def _stacked(d):
    cut = evaluate.by_time(d.records.where("smart is not null"), 0.7)
    return cut.select("seq", "outcome", F.when(F.col("train"), "train").otherwise("val").alias("part"), *[ensemble.logit(F.col(c)).alias(n) for n, c in (("resolve", "prob"), ("flow", "flow"), ("smart", "smart"))])


def _fitted(d, features, l2):
    rows = _stacked(d)
    held = rows.where("part = 'train'").persist()
    model = models.fit_logistic(held, features, "outcome", l2)
    held.unpersist()
    return rows, model


@query("stacker_fit", f"with {newton_sql('stacked', STACK, 'outcome')} select avg((1 / (1 + exp(-{odds_sql(STACK)})) - outcome) ** 2) as brier, count(*) as n, any_value(w1 / s1) as w_resolve, any_value(w2 / s2) as w_flow, any_value(w3 / s3) as w_smart from stacked, w, st where part = 'val'", "brier w_resolve w_flow w_smart")
def _(d):
    rows, model = _fitted(d, STACK, 1e-3)
    raw = model.raw()
    out = evaluate.losses(model(rows.where("part = 'val'"))).select("brier", "n")
    return out.withColumns({f"w_{f}": F.lit(w) for f, w in zip(STACK, raw)})


_pair = STACK[:2]


@query("two_model_combiner", f"""with {newton_sql('stacked', _pair, 'outcome', 0.0)}, v as (select outcome, round(1 / (1 + exp(-{odds_sql(_pair)})), 9) as prob, round(resolve, 9) as resolve, round(flow, 9) as flow, 1 / (1 + exp(-resolve)) as p1, 1 / (1 + exp(-flow)) as p2 from stacked, w, st where part = 'val'),
a as (select {auc_sql('v', 'resolve', 'outcome')} as auc_first, {auc_sql('v', 'flow', 'outcome')} as auc_second, {auc_sql('(select outcome, round((p1 + p2) / 2, 9) as mean from v)', 'mean', 'outcome')} as auc_mean, {auc_sql('v', 'prob', 'outcome')} as auc)
select *, auc - auc_first as lift, auc - auc_first >= 0.003 as worth, (select corr(p1, p2) from v) as correlation, (select w1 / s1 from w, st) as w_first, (select w2 / s2 from w, st) as w_second from a""", "auc_first auc_second auc_mean auc lift correlation w_first w_second", 5)
def _(d):
    from ..functions.scalars import logistic

    rows, model = _fitted(d, _pair, 0.0)
    v = model(rows.where("part = 'val'")).withColumns({"p1": logistic("resolve"), "p2": logistic("flow")})
    v = v.select("outcome", F.round("prob", 9).alias("prob"), F.round("resolve", 9).alias("resolve"), F.round("flow", 9).alias("flow"), "p1", "p2", F.round((F.col("p1") + F.col("p2")) / 2, 9).alias("mean"))
    out = v.agg(F.corr("p1", "p2").alias("correlation"))
    for name, score in (("auc_first", "resolve"), ("auc_second", "flow"), ("auc_mean", "mean"), ("auc", "prob")):
        out = out.crossJoin(evaluate.auc(v, score).select(F.col("auc").alias(name)))
    lift = F.col("auc") - F.col("auc_first")
    return out.withColumns({"lift": lift, "worth": lift >= 0.003, "w_first": F.lit(model.raw()[0]), "w_second": F.lit(model.raw()[1])})


FAMILY = {"mean_ret": "move", "drift": "move", "momentum": "move", "vol": "risk", "band_z": "place", "rsi": "place", "stoch_k": "place"}


@query("feature_importance_families", f"""with {newton_sql('learned', FEATURES, 'label')}, l as ({' union all '.join(f"select '{FAMILY[f]}' as family, '{f}' as feature, abs(w{k}) as a from w" for k, f in enumerate(FEATURES, 1))})
select family, sum(a) / ((select sum(a) from l) + 1e-12) as share, sum(a) as abs_weight, arg_max(feature, a) as top_feature, max(a) as top_abs_weight from l group by 1""", "share abs_weight top_abs_weight")
def _(d):
    rows = _rows(d).where("part = 'train'").persist()
    model = models.fit_logistic(rows, FEATURES)
    rows.unpersist()
    return models.family_shares(d.spark, model, FAMILY)


@query("isotonic_apply", "select seq, prob, f as calibrated from applied", "prob calibrated")
def _(d):
    cut = _split60(d)
    return models.fit_isotonic(cut.where("train"), "p3")(cut.where("not train")).select("seq", "prob", "calibrated")


O20 = "last mean_ret vol drift band_z momentum autocorr rsi macd_hist extremeness atr parkinson_vol williams_r stoch_k cci_tp vol_z trade_intensity signed_flow intrabar_pressure platform"
VIEWS["candles"] = """select market_id, bar_ts, vol_z, trade_intensity, signed_flow, intrabar_pressure,
  (select case when avg(abs(x - m)) >= 1e-9 then greatest(-5, least(5, (tps[16] - any_value(m)) / (0.015 * avg(abs(x - m))) / 100)) else 0 end from (select unnest(tps) as x, list_aggregate(tps, 'avg') as m)) as cci_tp from (
  select market_id, bar_ts, row_number() over w - 1 as i, list((high + low + close) / 3) over f as tps, (lag(volume) over w - avg(volume) over f) / (stddev_samp(volume) over f + 1e-9) as vol_z, (lag(trades) over w - avg(trades) over f) / (stddev_samp(trades) over f + 1e-9) as trade_intensity,
  sum(sign(close - open) * volume) over f / (sum(volume) over f + 1e-9) as signed_flow, avg(case when high - low > 1e-9 then (close - open) / (high - low) else 0 end) over f as intrabar_pressure
  from bars window w as (partition by market_id order by bar_ts), f as (partition by market_id order by bar_ts rows between 16 preceding and 1 preceding)) where i >= 16"""


@query("feat_ohlcv20", f"""select market_id, bar_ts, label, f.last, mean_ret, vol, drift, band_z, momentum, autocorr, rsi, macd_hist, abs(f.last - 0.5) * 2 as extremeness, r.tr / greatest(r.last, 1e-3) as atr, coalesce(sqrt(park / (4 * ln(2.0::double))), 0) as parkinson_vol,
  case when hi - lo >= 1e-9 then (r.last - hi) / (hi - lo) else -0.5 end as williams_r, case when hi - lo >= 1e-9 then (r.last - lo) / (hi - lo) else 0.5 end as stoch_k, cci_tp, vol_z, trade_intensity, signed_flow, intrabar_pressure, 0.0::double as platform
  from (select * exclude (stoch_k, i, n) from feats) f join ({_range}) r using (market_id, bar_ts) join candles using (market_id, bar_ts)""", O20)
def _(d):
    return d.windowed(windows.ohlcv20)


R27 = "price signed_dist dist time_rem log_hours momentum vol flow_recent flow_cum maturity log_trades signed_maturity"


@query("snap_fractions12", """with y as (select *, case when outcome_index = 0 then price else 1 - price end as yp, case when (side = 'BUY') = (outcome_index = 0) then usd else -usd end as sg from tape),
s as (select *, row_number() over w as k, count(*) over (partition by market_id) as n, sum(usd) over w as uv, sum(usd) over (partition by market_id) as total, sum(sg) over w as f, sum(sg) over l as rf, sum(usd) over l as ru, first_value(yp) over l as y0,
  coalesce(stddev_samp(d) over (partition by market_id order by t, seq rows between 22 preceding and current row), 0) as vol from (select *, yp - lag(yp) over (partition by market_id order by t, seq) as d from y)
  window w as (partition by market_id order by t, seq rows unbounded preceding), l as (partition by market_id order by t, seq rows between 23 preceding and current row))
select market_id, k, yp as price, yp - 0.5 as signed_dist, abs(yp - 0.5) as dist, 1 - (t - created) / greatest("end" - created, 1) as time_rem, ln(1 + ("end" - t) / 3600) as log_hours, yp - y0 as momentum, vol, rf / (ru + 1e-9) as flow_recent, f / (uv + 1e-9) as flow_cum, uv / (total + 1e-9) as maturity, ln(1 + k::double) as log_trades,
  (yp - 0.5) * (uv / (total + 1e-9)) as signed_maturity from s join market using (market_id) where k >= 2 and k in (floor(n * 0.15::double), floor(n * 0.35::double), floor(n * 0.55::double), floor(n * 0.75::double), floor(n * 0.9::double))""", R27)
def _(d):
    from ..operators import normalize

    return windows.snapshots12(normalize.yes_view(d.tape), d.market.select("market_id", "created", "end"))


B22 = "last mean_ret vol drift band_z momentum rsi atr ofi_window ofi_last ofi_trend vol_z trade_intensity extremeness log_volume cci stoch_k williams_r parkinson_vol log_avg_trade log_trades win_len"


@query("feat_big22", """select market_id, bar_ts, f.* exclude (market_id, bar_ts, signed_imbalance, vpin, toxicity, buy_pressure, whale_ratio, parkinson_vol), f.signed_imbalance as ofi_window,
  (select case when avg(abs(x - m)) > 1e-9 then greatest(-5, least(5, (tps[16] - any_value(m)) / (0.015 * avg(abs(x - m))) / 100)) else 0 end from (select unnest(tps) as x, list_aggregate(tps, 'avg') as m)) as cci,
  case when hi - lo > 1e-9 then (f.last - lo) / (hi - lo) else 0.5 end as stoch_k, case when hi - lo > 1e-9 then (f.last - hi) / (hi - lo) else -0.5 end as williams_r, sqrt(pk / (4 * ln(2.0::double))) as parkinson_vol, ln(1 + v / (n + 1e-9)) as log_avg_trade, ln(1 + n * 16) as log_trades, 16.0::double as win_len
  from flow20 f join (select market_id, bar_ts, list((high + low + close) / 3) over w as tps, max(high) over w as hi, min(low) over w as lo, avg(ln(greatest(high / greatest(low, 1e-6), 1e-9)) ** 2) over w as pk, avg(volume) over w as v, avg(trades) over w as n
    from bars window w as (partition by market_id order by bar_ts rows between 16 preceding and 1 preceding)) x using (market_id, bar_ts)""", B22)
def _(d):
    return d.windowed(windows.big22)
