"""Derivative, event, cohort, snapshot and sequence families, all of them side by side, and given models that score windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as fw
from ..operators import boards, cohorts, derivatives, families, fills, normalize, windows
from .evaluation_queries import _board, _resolved
from .fill_queries import fill_rows
from .registry import VIEWS, query


def _list(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}" for v in values) + "]::double[]"


def _on_window(coefficients: list[float]) -> str:
    """A dot product with the newest of `win`, oldest first; coefficients begin with the newest value's."""
    n = len(coefficients)
    return f"list_dot_product(win[{17 - n}:16], {_list(reversed(coefficients))})"


def _smoothed(k: int):
    """The k-th move of the smoothed window."""
    return lambda xs: fw.ema(xs, 3)[k] - fw.ema(xs, 3)[k - 1]


def _agreeing(moves: str, direction: str, weights: str | None = None) -> str:
    same = f"[case when (r > 1e-12) = ({direction} > 0) then 1.0 else 0.0 end::double for r in {moves}]"
    share = f"list_avg({same})" if weights is None else f"list_dot_product({same}, {weights}) / list_sum({weights})"
    return f"case when {direction} = 0 then 0 else {direction} * {share} end"


_sign = lambda v: f"case when {v} > 1e-12 then 1 when {v} < -1e-12 then -1 else 0 end"
_slopes = ", ".join(f"{_on_window(fw.polynomial_end(k, degree, points))} as {name}" for name, k, degree, points in derivatives.SLOPES)
_moves = "[" + ", ".join(_list(reversed(fw.coefficients(_smoothed(k)))) for k in range(1, 16)) + "]"
VIEWS["deriv"] = f"""select market_id, bar_ts, {_agreeing("rets", "slow")} as trend_consistency, win[16] - win[15] as d1_raw, (win[16] - win[1]) / 15 as d1_avg, win[16] - 2 * win[15] + win[14] as d2_raw,
  vel_sg5, vel_sg8, vel_sg16, vel_sg2_12, acc_sg8, acc_sg12, jerk_sg12, vel_sg8 / scale as vel_z, vel_sg16 / scale as vel_z_slow, acc_sg8 / scale as acc_z,
  vel_sg8 / case when list_max(win) - list_min(win) > 1e-12 then list_max(win) - list_min(win) else 1 end as vel_over_range, {_agreeing("rets[10:15]", "fast")} as vel_persist, acc_sg8 / (abs(vel_sg8) + 1e-12) as curv_ratio,
  {_agreeing("moves", "smooth")} as cons_ema, {_agreeing("rets", "slow", _list(derivatives.RECENT))} as cons_rec, {_agreeing("rets[8:15]", "fast")} as cons8, least(win[16], 1 - win[16]) as extremeness, win[16] as last,
  trend_consistency * 2 * least(win[16], 1 - win[16]) as tc_x_ext, trend_consistency * vel_sg8 / scale as tc_x_amp, cons_rec * 2 * least(win[16], 1 - win[16]) as cons_rec_x_ext
  from (select *, {_sign("vel_sg16")} as slow, {_sign("vel_sg8")} as fast, {_sign("smooth_v")} as smooth,
    case when list_aggregate(rets, 'stddev_samp') > 1e-12 then list_aggregate(rets, 'stddev_samp') else 1 end as scale from (
    select *, {_slopes}, {_on_window(fw.coefficients(derivatives.smoothed_slope))} as smooth_v, [list_dot_product(win, c) for c in {_moves}] as moves from (
      select market_id, bar_ts, row_number() over w - 1 as i, list(close) over (partition by market_id order by bar_ts rows between 16 preceding and 1 preceding) as win,
        list(d) over (partition by market_id order by bar_ts rows between 15 preceding and 1 preceding) as rets from steps window w as (partition by market_id order by bar_ts)) where i >= 16))"""


@query("deriv_family25", "select * from deriv", " ".join(derivatives.NAMES))
def _(d):
    return d.windowed(derivatives.family25)


#: Fixed values of the published linear signal: (mean, deviation, weight) by feature, and the bias.
LINEAR = {
    "last": (0.22519368, 0.26073507, 0.14969868), "cons_rec_x_ext": (-0.08132404, 0.2537719, 0.12195205), "d1_avg": (-7.23e-05, 0.00309997, -0.11053199), "tc_x_ext": (-0.08144775, 0.25266702, -0.11458637),
    "acc_sg12": (1.48e-06, 0.00134685, -0.0117207), "d1_raw": (-5.652e-05, 0.015655, -0.00816332), "trend_consistency": (-0.33801546, 0.57321112, -0.0937658), "cons_rec": (-0.3380089, 0.57663737, 0.26637992),
}
BIAS = -0.85657147


@query("score_logistic_signal", f"select market_id, bar_ts, 1 / (1 + exp(-({BIAS} + " + " + ".join(f"{w!r}::double * (({n} - {m!r}::double) / {s!r}::double)" for n, (m, s, w) in LINEAR.items()) + "))) as prob from deriv", "prob")
def _(d):
    f = d.windowed(derivatives.family25)
    return f.select("market_id", "bar_ts", derivatives.linear_signal(f, LINEAR, BIAS).alias("prob"))


#: A small dump with both comparisons, both default sides and a single leaf.
TREES = [
    {"split_feature": 0, "threshold": 0.2, "decision_type": "<=", "default_left": True, "left_child": {"leaf_value": -0.3}, "right_child": {
        "split_feature": 2, "threshold": 0.5, "decision_type": "<", "default_left": False, "left_child": {"leaf_value": 0.1}, "right_child": {"leaf_value": 0.45}}},
    {"split_feature": 1, "threshold": 0.0, "decision_type": "<=", "default_left": False, "left_child": {"leaf_value": -0.2}, "right_child": {"leaf_value": 0.25}},
    {"leaf_value": 0.05},
]
TREE_FEATURES = ["trend_consistency", "vel_z", "sparse"]


def _tree_sql(node: dict) -> str:
    if "leaf_value" in node:
        return f"{node['leaf_value']}::double"
    x, sign = TREE_FEATURES[node["split_feature"]], node.get("decision_type", "<=")
    return f"(case when case when {x} is null then {str(node.get('default_left', True)).lower()} else {x} {sign} {node['threshold']} end then {_tree_sql(node['left_child'])} else {_tree_sql(node['right_child'])} end)"


@query("score_tree_dump", f"select market_id, bar_ts, 1 / (1 + exp(-({' + '.join(map(_tree_sql, TREES))}))) as prob from (select *, case when last > 0.3 then last end as sparse from deriv)", "prob")
def _(d):
    f = d.windowed(derivatives.family25).withColumn("sparse", F.when(F.col("last") > 0.3, F.col("last")).otherwise(F.when(F.col("bar_ts") % 2 == 0, float("nan"))))
    return f.select("market_id", "bar_ts", derivatives.tree_signal(TREES, TREE_FEATURES).alias("prob"))


NET_FEATURES = ["last", "mean_ret", "vol", "drift", "band_z", "momentum", "autocorr", "activity", "rsi", "cci", "macd_hist", "stoch_k", "downside_vol"]


def _weights(k: int, n_in: int, n_out: int):
    """Weights by a rule: a trained network's are a parameter."""
    return [[((37 * i + 17 * j + 11 * k) % 23 - 11) / 40 for j in range(n_in)] for i in range(n_out)], [((5 * i + 3 * k) % 7 - 3) / 20 for i in range(n_out)]


NETWORK = {"mean": [0.5, 0, 0.05, 0, 0, 0, 0, 0.5, 0, 0, 0, 0.5, 0.05], "std": [0.25, 0.02, 0.05, 0.3, 1, 0.05, 0.3, 0.5, 0.3, 1, 0.05, 0.3, 0.05], "layers": [_weights(0, 13, 32), _weights(1, 32, 32), _weights(2, 32, 1)], "temperature": 0.85634}
_units = lambda k: "[" + ", ".join(f"{{'w': {_list(w)}, 'b': {b!r}::double}}" for w, b in zip(*NETWORK["layers"][k])) + "]"
VIEWS["tails"] = f"""select market_id, win, [win[k + 1] - win[k] for k in range(1, 16)] as rets, win[16] as last, {_on_window(fw.coefficients(fw.macd_histogram))} as macd_hist, null::double as fwd
  from (select market_id, list(close order by bar_ts)[-16:] as win from bars group by 1) where len(win) = 16"""
VIEWS["newest"] = VIEWS["feats"].replace("from anchors", "from tails")
_x = "[" + ", ".join(f"({n} - {m!r}::double) / {float(s or 1)!r}::double" for n, m, s in zip(NET_FEATURES, NETWORK["mean"], NETWORK["std"])) + "]"


SCORE_SQL = f"""with x as (select market_id, {_x} as x from newest), h as (select market_id, [greatest(0, list_dot_product(u.w, x) + u.b) for u in {_units(0)}] as h from x),
g as (select market_id, [greatest(0, list_dot_product(u.w, h) + u.b) for u in {_units(1)}] as g from h), p as (select market_id, 1 / (1 + exp(-([list_dot_product(u.w, g) + u.b for u in {_units(2)}][1]) / {NETWORK["temperature"]})) as prob from g)
select market_id, prob, case when prob > 0.5 then 'bullish' when prob < 0.5 then 'bearish' when prob is not null then 'neutral' end as direction, least(1, abs(prob - 0.5) * 2) as conviction from p"""


@query("score_mlp", f"select market_id, prob, direction, conviction from market left join ({SCORE_SQL}) using (market_id)", "prob conviction")
def _(d):
    scored = derivatives.network_signal(windows.newest13(d.bars), NET_FEATURES, NETWORK)
    return d.market.select("market_id").join(scored.select("market_id", "prob", "direction", "conviction"), "market_id", "left")


VIEWS["event11"] = """select market_id, bar_ts, beta as beta_to_event, drift - beta * event as idio_return, event_momentum, self_momentum - event_momentum as rel_strength, greatest(-1, least(1, lead_ - lag_)) as lead_lag,
  case when np = 0 then 0 else (sum(self_vol) over b - self_vol) / np end as event_vol,
  greatest(-1, least(1, (case when g < 1e-9 then 0 else greatest(-1, least(1, f / g)) end - case when np = 0 or sum(g) over b - g < 1e-9 then 0 else greatest(-1, least(1, (sum(f) over b - f) / (sum(g) over b - g))) end) / 2)) as flow_divergence,
  np::double as peer_count, last, self_momentum, self_vol from (
  select *, case when ev * en < 1e-9 then 0 else greatest(-10, least(10, ec / ev)) end as beta,
    case when ld * pn < 1e-9 or le * pn < 1e-9 then 0 else greatest(-1, least(1, lc / sqrt(ld * le))) end as lead_, case when gd * pn < 1e-9 or ge * pn < 1e-9 then 0 else greatest(-1, least(1, gc / sqrt(gd * ge))) end as lag_ from (
    select basket_id, market_id, bar_ts, i, np, row_number() over m as r, var_pop(e) over s as ev, count(e) over s as en, covar_pop(d, e) over s as ec, sum(d) over s as drift, sum(e) over s as event, avg(e) over q as event_momentum, avg(d) over q as self_momentum,
      stddev_samp(d) over s as self_vol, var_pop(d1) over p as ld, var_pop(e) over p as le, covar_pop(d1, e) over p as lc, var_pop(d) over p as gd, var_pop(e1) over p as ge, covar_pop(e1, d) over p as gc, count(d1) over p as pn,
      sum(flow) over f as f, sum(abs(flow)) over f as g, lag(close) over m as last from (select *, lag(d) over n as d1, lag(e) over n as e1 from (
        select *, case when np = 0 then 0 else (sum(d) over o - d) / np end as e from (
          select *, close - lag(close) over l as d, count(*) over (partition by basket_id, i) - 1 as np from (
            select *, min(n) over (partition by basket_id) as shortest from (
              select basket_id, market_id, bar_ts, close, signed_vol as flow, row_number() over (partition by market_id order by bar_ts) as i, count(*) over (partition by market_id) as n from bars join market using (market_id)))
          where i <= shortest window l as (partition by market_id order by i)) window o as (partition by basket_id, i)) window n as (partition by market_id order by i))
    window m as (partition by market_id order by i), f as (partition by market_id order by i rows between 16 preceding and 1 preceding), s as (partition by market_id order by i rows between 15 preceding and 1 preceding),
      p as (partition by market_id order by i rows between 14 preceding and 1 preceding), q as (partition by market_id order by i rows between 4 preceding and 1 preceding))
  where r > 16) window b as (partition by basket_id, i)"""


def _event(d):
    p = boards.panel(d.bars.withColumn("flow", F.col("signed_vol")), d.market, ("bar_ts", "flow"))
    return families.event11(p).join(p.select("market_id", "i", "bar_ts"), ["market_id", "i"]).select("market_id", "bar_ts", *families.EVENT)


@query("feat_event11", "select * from event11", " ".join(families.EVENT))
def _(d):
    return _event(d)


VIEWS["cut"] = "select t as cutoff from (select t, row_number() over (order by t, seq) - 1 as i, count(*) over () as n from tape) where i = floor(n * 0.5::double)"
VIEWS["early"] = """select wallet, sum(pnl) as pnl, sum(volume) as volume from (select wallet, market_id, sum(token_amount) * any_value(final) - sum(token_amount * price) as pnl, sum(usd) as volume
  from tape join (select t.market_id, case when t.market_id % 3 = 0 then arg_max(t.price, t.t) else any_value((m.last > 0.5)::int) end as final from tape t join market m using (market_id), cut where t.t < cutoff group by 1) using (market_id), cut where t < cutoff group by 1, 2) group by 1"""
VIEWS["camp"] = "select wallet, case when i >= n - k then 'smart' else 'dumb' end as cohort from (select *, least(floor(n * 0.2::double), floor((n - 1) / 2)) as k from (select *, row_number() over (order by pnl, wallet) - 1 as i, count(*) over () as n from early where volume >= 200)) where n >= 5 and (i >= n - k or i < k)"


@query("feat_smart6", """with h as (select *, (floor(t / 3600) * 3600)::bigint as bar_ts from tape), b as (select market_id, bar_ts, arg_max(price, t) as close, min(t) as t0 from h group by 1, 2),
x as (select *, row_number() over w - 1 as b, count(*) over (partition by market_id) as n, stddev_pop(close) over f as sd, min(t0) over f as st, lead(close, 3) over w - close as fwd from b window w as (partition by market_id order by bar_ts), f as (partition by market_id order by bar_ts rows between 12 preceding and 1 preceding)),
a as (select x.* from x, cut where b >= 12 and n >= 17 and fwd is not null and st >= cutoff and sd >= 1e-4),
e as (select a.market_id, a.bar_ts, h.wallet, any_value(cohort) as cohort, sum(usd) as gross, sum(case when token_amount > 0 then usd else -usd end) as net, max((token_amount > 0)::int) as bu, max((not token_amount > 0)::int) as se
  from a join x y on y.market_id = a.market_id and y.b between a.b - 12 and a.b - 1 join h on h.market_id = y.market_id and h.bar_ts = y.bar_ts left join camp on camp.wallet = h.wallet group by 1, 2, 3)
select market_id, bar_ts, coalesce(sum(net) filter (where cohort = 'smart'), 0) / (coalesce(sum(gross) filter (where cohort = 'smart'), 0) + 1e-9) as smart_net_flow, coalesce(sum(gross) filter (where cohort = 'smart'), 0) / (sum(gross) + 1e-9) as smart_share, abs(sum(net)) / (sum(gross) + 1e-9) as herding,
  greatest(sum(bu), sum(se)) / count(*) as crowding, max(gross) / (sum(gross) + 1e-9) as whale_concentration, coalesce(sum(net) filter (where cohort = 'smart'), 0) / (coalesce(sum(gross) filter (where cohort = 'smart'), 0) + 1e-9) - coalesce(sum(net) filter (where cohort = 'dumb'), 0) / (coalesce(sum(gross) filter (where cohort = 'dumb'), 0) + 1e-9) as smart_minus_dumb
from e group by 1, 2""", " ".join(families.SMART6))
def _(d):
    cut = cohorts.time_cutoff(d.tape)
    before = d.tape.crossJoin(F.broadcast(cut)).where(F.col("t") < F.col("cutoff")).drop("cutoff")
    board = cohorts.leaderboard(cohorts.wallet_pnl(before, cohorts.market_final(before, _resolved(d))))
    return families.smart6(d.tape, cohorts.smart_and_dumb(board), cut)


N24 = "yes_price signed_dist dist_half time_remaining_frac log_hours_to_res momentum_recent vol_recent flow_imb_recent flow_imb_cum vol_maturity log_trades price_x_maturity last mean_ret vol drift band_z momentum rsi signed_imbalance ofi_last ofi_trend buy_pressure trade_intensity extremeness log_volume"
VIEWS["yes"] = "select *, case when outcome_index = 0 then price else 1 - price end as yp, case when (side = 'BUY') = (outcome_index = 0) then usd else -usd end as sg from tape"


@query("snap_named24", """with s as (select *, row_number() over w as k, count(*) over (partition by market_id) as n, sum(usd) over w as uv, sum(usd) over (partition by market_id) as total, sum(sg) over w as f, sum(sg) over l as rf, sum(usd) over l as ru, first_value(yp) over l as y0, coalesce(stddev_samp(d) over e, 0) as vol, coalesce(avg(d) over e, 0) as mr,
  avg(yp) over l as m, coalesce(stddev_samp(yp) over l, 0) as sd, sum(d) over e as sum_d, sum(abs(d)) over e as abs_d from (select *, yp - lag(yp) over (partition by market_id order by t, seq) as d from yes)
  window w as (partition by market_id order by t, seq rows unbounded preceding), l as (partition by market_id order by t, seq rows between 23 preceding and current row), e as (partition by market_id order by t, seq rows between 22 preceding and current row))
select market_id, k, yp as yes_price, yp - 0.5 as signed_dist, abs(yp - 0.5) as dist_half, 1 - (t - created) / greatest("end" - created, 1) as time_remaining_frac, ln(1 + ("end" - t) / 3600) as log_hours_to_res, yp - y0 as momentum_recent, vol as vol_recent, rf / (ru + 1e-9) as flow_imb_recent, f / (uv + 1e-9) as flow_imb_cum,
  uv / (total + 1e-9) as vol_maturity, ln(1 + k::double) as log_trades, (yp - 0.5) * (uv / (total + 1e-9)) as price_x_maturity, yp as last, mr as mean_ret, vol, yp - y0 as drift, case when sd > 1e-9 then (yp - m) / sd else 0 end as band_z, yp - y0 as momentum, case when abs_d > 1e-9 then sum_d / abs_d else 0 end as rsi,
  rf / (ru + 1e-9) as signed_imbalance, rf / (ru + 1e-9) as ofi_last, f / (uv + 1e-9) as ofi_trend, (rf / (ru + 1e-9) + 1) / 2 as buy_pressure, ln(1 + k::double) as trade_intensity, abs(yp - 0.5) * 2 as extremeness, ln(1 + uv) as log_volume
  from s join market using (market_id) where k >= 2 and k in (floor(n * 0.15::double), floor(n * 0.35::double), floor(n * 0.55::double), floor(n * 0.75::double), floor(n * 0.9::double))""", N24)
def _(d):
    return families.named_snapshots(normalize.yes_view(d.tape), d.market.select("market_id", "created", "end"))


_fading = lambda n: _list([0.7 ** (n - 1), *[0.3 * 0.7 ** (n - 1 - k) for k in range(1, n)]])
S33 = "last signed_dist dist drift ewma_ret ewma_flow mean_flow ewma_side std_price mean_size"


@query("sequence_summary10", f"""with s as (select *, row_number() over w as k, count(*) over (partition by market_id) as n, list(yp) over e as p, list(sg) over e as f, list(ln(1 + usd)) over e as z, list(case when outcome_index = 0 then 1.0 else -1.0 end::double) over e as o
  from yes window w as (partition by market_id order by t, seq), e as (partition by market_id order by t, seq rows between 47 preceding and current row))
select market_id, k, p[48] as last, p[48] - 0.5 as signed_dist, abs(p[48] - 0.5) as dist, p[48] - p[1] as drift, list_dot_product([p[j + 1] - p[j] for j in range(1, 48)], {_fading(47)}) as ewma_ret, list_dot_product(f, {_fading(48)}) as ewma_flow, list_avg(f) as mean_flow,
  list_dot_product(o, {_fading(48)}) as ewma_side, list_aggregate(p, 'stddev_samp') as std_price, list_avg(z) as mean_size from s where k >= 48 and k + 6 <= n and k in ({', '.join(f'floor(n * {x}::double)' for x in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9))})""", S33)
def _(d):
    return families.sequence_summary(normalize.yes_view(d.tape))


_event_names, _flow_names = families.EVENT, "signed_imbalance vpin toxicity trade_intensity flow_autocorr whale_ratio buy_pressure last mean_ret vol momentum".split()
_resolve_names = "price dist_from_half logit_price time_to_resolution age_fraction momentum realized_vol flow_imbalance volume_maturity trade_count_z calib_bucket price_x_time".split()
_smart_names = "smart_net_flow smart_share smart_minus_dumb herding flow_imbalance crowding maker_taker_ratio whale_concentration last extremeness".split()
_cross_names = "price basket_sum residual share sibling_count rank favourite_gap dispersion neg_risk".split()[1:]
_micro_names = "effective_spread realized_spread fill_size_mean fill_size_cv large_fill_ratio price_impact fee_intensity maker_hhi taker_hhi fill_rate last mean_ret vol momentum".split()
_ALL = {"flow": ("f", _flow_names), "resolve": ("r", _resolve_names), "smart": ("s", _smart_names), "crossmarket": ("c", _cross_names), "event": ("e", _event_names), "micro": ("m", _micro_names)}


@query("feat_all66", f"""with h as (select market_id, (floor(t / 21600) * 21600)::bigint as bar_ts, min(seq) as anchor from (select *, row_number() over (partition by market_id, (floor(t / 21600) * 21600)::bigint order by t, seq) as r from tape) where r = 1 group by 1, 2),
r as (select a.market_id, a.bar_ts, arg_max(at_share, z.t) as at_share from anchors a join resolve12 z on z.market_id = a.market_id and z.t < a.bar_ts group by 1, 2)
select a.market_id, a.bar_ts, a.fwd, {', '.join(f'coalesce({k}.{n}, 0)::double as {family}_{n}' for family, (k, names) in _ALL.items() for n in names)}
from anchors a left join flow11 f using (market_id, bar_ts) left join r ra using (market_id, bar_ts) left join resolve12 r on r.market_id = a.market_id and r.at_share = ra.at_share left join h on h.market_id = a.market_id and h.bar_ts = a.bar_ts
left join smart10 s on s.market_id = a.market_id and s.anchor = h.anchor left join cross8 c on c.market_id = a.market_id left join event11 e on e.market_id = a.market_id and e.bar_ts = a.bar_ts left join micro m on m.market_id = a.market_id and m.bar_ts = a.bar_ts""", "fwd " + " ".join(f"{family}_{n}" for family, (_, names) in _ALL.items() for n in names))
def _(d):
    """Six families, 66 columns, at each labelled bar: those of snapshots are the newest before the bar, those of wallets
    belong to the trades before the bar's first one."""
    keys = ["market_id", "bar_ts"]
    anchors = d.windowed(windows.labelled).select(*keys, "fwd")
    shots = windows.snapshots(d.tape, d.market.select("market_id", "created", "end"))
    shots = anchors.select(*keys).join(shots, "market_id").where(F.col("t") < F.col("bar_ts")).groupBy(*keys).agg(*[F.max_by(c, "t").alias(c) for c in _resolve_names])
    first = d.tape.groupBy("market_id", (F.floor(F.col("t") / 21600) * 21600).cast("long").alias("bar_ts")).agg(F.min_by("seq", F.struct("t", "seq")).alias("anchor"))
    smart = fills.smart10(d.tape, cohorts.top_share(_board(d)), hot=d.hot).join(first, ["market_id", "anchor"])
    cross = windows.crossmarket(d.market.withColumnRenamed("last", "price"))
    parts = {"flow": (d.windowed(windows.flow11), keys), "resolve": (shots, keys), "smart": (smart.select(*keys, *_smart_names), keys), "crossmarket": (cross.select("market_id", *_cross_names), ["market_id"]), "event": (_event(d), keys), "micro": (fills.micro14(fill_rows(d), hot=d.hot).select(*keys, *_micro_names), keys)}
    return families.side_by_side(anchors, {k: (rows.select(*on, *_ALL[k][1]), on) for k, (rows, on) in parts.items()})
