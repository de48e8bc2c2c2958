"""Fill- and wallet-level windows, and the scans they start from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boards, evaluate, fills, ranks, windows
from ..sources import scans
from .board_queries import VIEWS  # the raw fills are among them
from .evaluation_queries import _board
from .registry import query
from .scan_queries import _path


def fill_rows(d):
    return d.tape.select("market_id", "t", "seq", "price", "usd", F.when(F.col("side") == "BUY", 1).otherwise(-1).alias("direction"), (F.col("usd") * 0.001).alias("fee"), F.concat(F.lit("m"), F.col("seq") % 6).alias("maker"), F.col("wallet").alias("taker"))


VIEWS["vw"] = """select *, row_number() over w - 1 as b, close - lag(close) over w as d from (select market_id, (floor(t / 21600) * 21600)::bigint as bar_ts, sum(price * usd) / nullif(sum(usd), 0) as close, count(*)::double as fills from tape group by 1, 2) window w as (partition by market_id order by bar_ts)"""
VIEWS["vwa"] = """select * from (select *, (lag(fills) over w - avg(fills) over f) / (stddev_samp(fills) over f + 1e-9) as fill_rate, lag(close) over w as last, avg(d) over g as mean_ret, stddev_samp(d) over g as vol, avg(d) over q as momentum from vw
  window w as (partition by market_id order by bar_ts), f as (partition by market_id order by bar_ts rows between 16 preceding and 1 preceding), g as (partition by market_id order by bar_ts rows between 15 preceding and 1 preceding), q as (partition by market_id order by bar_ts rows between 4 preceding and 1 preceding)) where b >= 16"""
VIEWS["dealt"] = """select a.market_id, a.b as i, a.bar_ts, t.t, t.seq, t.price, t.usd, case when side = 'BUY' then 1 else -1 end as direction, usd * 0.001 as fee, 'm' || (seq % 6) as maker, wallet as taker
  from tape t join vw v on v.market_id = t.market_id and v.bar_ts = (floor(t.t / 21600) * 21600)::bigint join vwa a on a.market_id = v.market_id and v.b between a.b - 16 and a.b - 1"""
VIEWS["micro"] = """with x as (select *, avg(price) over (partition by market_id, i order by t, seq rows between 5 preceding and 1 preceding) as mid, lead(price) over o as nx, price - lag(price) over o as dp, row_number() over (partition by market_id, i order by usd desc, seq) as r, count(*) over (partition by market_id, i) as n
  from dealt window o as (partition by market_id, i order by t, seq)),
g as (select market_id, i, coalesce(avg(case when mid > 1e-9 then abs(price - mid) / mid end), 0) as effective_spread, coalesce(avg(direction * (price - nx) / nullif(price, 0)), 0) as realized_spread, ln(1 + avg(usd)) as fill_size_mean, coalesce(stddev_samp(usd) / nullif(avg(usd), 0), 0) as fill_size_cv,
  sum(usd) filter (where r <= greatest(1, n // 10)) / nullif(sum(usd), 0) as large_fill_ratio, coalesce(regr_slope(dp, direction * usd / 0.001), 0) as price_impact, sum(fee) / nullif(sum(usd), 0) as fee_intensity from x group by 1, 2),
m as (select market_id, i, sum(w * w) / nullif(sum(w) ** 2, 0) as maker_hhi from (select market_id, i, maker, sum(usd) as w from dealt group by 1, 2, 3) group by 1, 2),
k as (select market_id, i, sum(w * w) / nullif(sum(w) ** 2, 0) as taker_hhi from (select market_id, i, taker, sum(usd) as w from dealt group by 1, 2, 3) group by 1, 2)
select g.* exclude (i), maker_hhi, taker_hhi, bar_ts, fill_rate, last, mean_ret, vol, momentum from g join m using (market_id, i) join k using (market_id, i) join vwa a on a.market_id = g.market_id and a.b = g.i"""
M14 = "effective_spread realized_spread fill_size_mean fill_size_cv large_fill_ratio price_impact fee_intensity maker_hhi taker_hhi fill_rate last mean_ret vol momentum"


@query("feat_micro14", "select * from micro", M14)
def _(d):
    return fills.micro14(fill_rows(d), hot=d.hot)


for _n, _c in {"effective_spread": "effective_spread", "realized_spread": "realized_spread", "large_fill_ratio": "large_fill_ratio", "maker_taker_hhi": "maker_hhi taker_hhi"}.items():
    query(_n, f"select market_id, bar_ts, {', '.join(_c.split())} from micro", _c)(lambda d, c=_c: fills.micro14(fill_rows(d), hot=d.hot).select("market_id", "bar_ts", *c.split()))


@query("price_impact", "select market_id, bar_ts, price_impact * 1e6 as price_impact from micro", "price_impact")
def _(d):
    return fills.micro14(fill_rows(d), hot=d.hot).select("market_id", "bar_ts", (F.col("price_impact") * 1e6).alias("price_impact"))


S10 = "smart_net_flow smart_share smart_minus_dumb herding flow_imbalance crowding maker_taker_ratio whale_concentration last extremeness"
VIEWS["sidx"] = "select *, row_number() over (partition by market_id order by t, seq) - 1 as b from tape"
VIEWS["cohort"] = "select wallet from (select *, row_number() over (order by pnl desc, wallet) - 1 as i, count(*) over () as n from wallets) where i < ceil(n * 0.2::double)"


VIEWS["smart10"] = """with s as (select *, min(b) over (partition by market_id, wallet) as fb from sidx),
x as (select a.market_id, a.seq as anchor, s.wallet, sum(case when s.side = 'BUY' then s.usd else -s.usd end) as net, sum(s.usd) as gross, sum(case when s.role = 'maker' then s.usd else 0 end) as maker, s.wallet in (select wallet from cohort) as smart, min(s.fb) >= any_value(a.b) - 16 as fresh,
  max(s.b) as eb, arg_max(s.price, s.b) as ep from sidx a join s on s.market_id = a.market_id and s.b between a.b - 16 and a.b - 1 where a.b >= 16 group by 1, 2, 3)
select market_id, anchor, coalesce(sum(net) filter (where smart), 0) / (sum(gross) + 1e-9) as smart_net_flow, coalesce(sum(gross) filter (where smart), 0) / (sum(gross) + 1e-9) as smart_share, (2 * coalesce(sum(net) filter (where smart), 0) - sum(net)) / (sum(gross) + 1e-9) as smart_minus_dumb,
  abs(sum(net)) / (sum(gross) + 1e-9) as herding, sum(net) / (sum(gross) + 1e-9) as flow_imbalance, avg(fresh::int) as crowding, sum(maker) / (sum(gross) + 1e-9) as maker_taker_ratio, max(gross) / (sum(gross) + 1e-9) as whale_concentration, arg_max(ep, eb) as last, abs(arg_max(ep, eb) - 0.5) * 2 as extremeness from x group by 1, 2"""


@query("feat_smart10", "select * from smart10", S10)
def _(d):
    from ..operators import cohorts

    return fills.smart10(d.tape, cohorts.top_share(_board(d)), hot=d.hot)


L12 = "last mean_p drift vol momentum band_z rsi autocorr stoch_k range extremeness activity"


@query("snap_latest12", """with n as (select *, row_number() over (partition by market_id order by t desc, seq desc) as r from tape), s as (select *, price - lag(price) over (partition by market_id order by t, seq) as d from n where r <= 16),
c as (select *, d - avg(d) over (partition by market_id) as dm from s), e as (select *, lag(dm) over (partition by market_id order by t, seq) as dm0 from c)
select market_id, arg_max(price, t) as last, avg(price) as mean_p, arg_max(price, t) - arg_min(price, t) as drift, stddev_samp(d) as vol, avg(d) filter (where r <= 4) as momentum, (arg_max(price, t) - avg(price)) / stddev_samp(price) as band_z, sum(d) / sum(abs(d)) as rsi,
  greatest(-1, least(1, sum(dm * dm0) / sum(dm * dm))) as autocorr, (arg_max(price, t) - min(price)) / (max(price) - min(price)) as stoch_k, max(price) - min(price) as range, abs(arg_max(price, t) - 0.5) * 2 as extremeness, sum(abs(d)) as activity from e group by 1 having count(*) >= 8""", L12)
def _(d):
    return fills.latest12(d.tape)


for _n in ("stoch_k", "williams_r"):
    query(_n, f"select market_id, bar_ts, {_n} from (select market_id, bar_ts, case when hi - lo >= 1e-9 then (last - hi) / (hi - lo) else -0.5 end as williams_r, case when hi - lo >= 1e-9 then (last - lo) / (hi - lo) else 0.5 end as stoch_k from (select market_id, bar_ts, row_number() over w - 1 as i, lag(close) over w as last, max(high) over f as hi, min(low) over f as lo from bars window w as (partition by market_id order by bar_ts), f as (partition by market_id order by bar_ts rows between 16 preceding and 1 preceding)) where i >= 16)", _n)(lambda d, c=_n: d.windowed(windows.range_features).select("market_id", "bar_ts", c))


@query("scan_monthly_files", "select year(ts) * 100 + month(ts) as month, count(*) as n from events where year(ts) * 100 + month(ts) in (select distinct year(ts) * 100 + month(ts) as m from events order by m limit 2) group by 1")
def _(d):
    path, e = _path(d, "monthly"), d.table("events")
    month = F.year("ts") * 100 + F.month("ts")
    e.select("event_id", "value", month.cast("long").alias("month"), month.alias("folder")).write.partitionBy("folder").parquet(path)
    months = sorted(r.folder for r in d.spark.read.parquet(path).select("folder").distinct().collect())
    return scans.monthly(d.spark, path, [f"folder={m}" for m in months], 2, "event_id long, value double, month long").groupBy("month").agg(F.count("*").alias("n"))


@query("scan_user_parquet", "select market_id, count(*) as n from tape where seq % 9 <> 0 and token_amount is not null group by 1")
def _(d):
    path, bad = _path(d, "users"), F.col("seq") % 9 == 0
    d.tape.select(F.col("t").cast("long").cast("string").alias("timestamp"), "market_id", F.col("wallet").alias("user"), "role", F.when(bad, "n/a").otherwise(F.col("price").cast("string")).alias("price"), F.col("usd").alias("usd_amount"), "token_amount").write.parquet(path)
    return scans.users(d.spark, path).groupBy("market_id").agg(F.count("*").alias("n"))


@query("search_union_dedupe_join", "select market_id from hits union select market_id from market where basket_id in (select basket_id from market where last > 0.6)")
def _(d):
    m = d.market.select("market_id", "basket_id")
    hits = m.where("last > 0.6")
    return boards.search(hits, m.join(hits.select("basket_id"), "basket_id", "left_semi").select(*m.columns)).select("market_id")


@query("selective_short_ledger", """with t as (select quantile_cont(flow, 0.7) as threshold from (select flow, row_number() over (order by ts, seq) - 1 < floor(count(*) over () * 0.7::double) as train from records) where train)
select seq, -fwd - 0.003 as net, sum(-fwd - 0.003) over (order by ts, seq rows unbounded preceding) as equity from (select *, row_number() over (order by ts, seq) - 1 < floor(count(*) over () * 0.7::double) as train from records), t where not train and flow >= threshold""", "net equity")
def _(d):
    from pyspark.sql import Window as W

    cut = evaluate.by_time(d.records, 0.7)
    t = ranks.quantiles(cut.where("train"), "flow", {"threshold": 0.7})
    rows = cut.where("not train").crossJoin(F.broadcast(t)).where("flow >= threshold").withColumn("net", -F.col("fwd") - 0.003)
    # equity within days, then what the days before left: no task holds all rows
    day = rows.withColumn("day", F.floor(F.col("ts") / 86400))
    sums = day.groupBy("day").agg(F.sum("net").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    within = F.sum("net").over(W.partitionBy("day").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0))
    return day.join(F.broadcast(sums.select("day", "before")), "day").select("seq", "net", (F.col("before") + within).alias("equity"))
