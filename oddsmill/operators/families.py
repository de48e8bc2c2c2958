"""Feature families that join several views of a market: its event's other legs, snapshots, sequences, cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..functions.windows import WINDOW
from .windows import order

#: Fixed values of the event family: least variance, and the bound of the slope.
FLAT, MOST_BETA = 1e-9, 10.0

EVENT = ["beta_to_event", "idio_return", "event_momentum", "rel_strength", "lead_lag", "event_vol", "flow_divergence", "peer_count", "last", "self_momentum", "self_vol"]


def _correlation(a: str, b: str, frame) -> object:
    n = F.count(F.col(a) + F.col(b)).over(frame)
    va, vb = F.var_pop(a).over(frame), F.var_pop(b).over(frame)
    return F.when((va * n < FLAT) | (vb * n < FLAT), 0.0).otherwise(clamp(F.covar_pop(a, b).over(frame) / F.sqrt(va * vb), -1, 1))


def event11(panel: DataFrame, basket: str = "basket_id", key: str = "market_id") -> DataFrame:
    """Eleven features of a market's window of 16 rows against the mean of its event's other legs.

    panel: basket, key, i (position, the same for all legs), close, flow. The others' means are the event's sums less
    the leg's own, so legs are never paired. A leg without others has zeros but for its own figures.
    """
    w, together = order(key, ("i",)), W.partitionBy(basket, "i")
    d = panel.withColumn("_d", F.col("close") - F.lag("close").over(w)).withColumn("_n", F.count("*").over(together) - 1)
    alone = F.col("_n") == 0
    others = lambda c: F.when(alone, 0.0).otherwise(F.sum(c).over(together) - F.col(c))
    d = d.withColumn("_e", F.when(alone, 0.0).otherwise(others("_d") / F.col("_n")))
    frame, steps, pairs, late = w.rowsBetween(-WINDOW, -1), w.rowsBetween(-(WINDOW - 1), -1), w.rowsBetween(-(WINDOW - 2), -1), w.rowsBetween(-4, -1)
    d = d.withColumns({"_d1": F.lag("_d").over(w), "_e1": F.lag("_e").over(w)})
    var = F.var_pop("_e").over(steps)
    d = d.withColumns({
        "beta_to_event": F.when(var * F.count("_e").over(steps) < FLAT, 0.0).otherwise(clamp(F.covar_pop("_d", "_e").over(steps) / var, -MOST_BETA, MOST_BETA)),
        "_drift": F.sum("_d").over(steps), "_event": F.sum("_e").over(steps), "event_momentum": F.avg("_e").over(late), "self_momentum": F.avg("_d").over(late), "self_vol": F.stddev_samp("_d").over(steps),
        "_lead": _correlation("_d1", "_e", pairs), "_lag": _correlation("_e1", "_d", pairs), "_f": F.sum("flow").over(frame), "_g": F.sum(F.abs("flow")).over(frame), "last": F.lag("close").over(w), "_r": F.row_number().over(w),
    }).where(F.col("_r") > WINDOW)
    share = lambda f, g: F.when(g < FLAT, 0.0).otherwise(clamp(f / g, -1, 1))
    d = d.withColumns({"_of": others("_f"), "_og": others("_g"), "_ov": others("self_vol")})
    return d.select(
        key, "i", "beta_to_event", (F.col("_drift") - F.col("beta_to_event") * F.col("_event")).alias("idio_return"), "event_momentum", (F.col("self_momentum") - F.col("event_momentum")).alias("rel_strength"),
        clamp(F.col("_lead") - F.col("_lag"), -1, 1).alias("lead_lag"), F.when(alone, 0.0).otherwise(F.col("_ov") / F.col("_n")).alias("event_vol"),
        clamp((share(F.col("_f"), F.col("_g")) - share(F.col("_of"), F.col("_og"))) / 2, -1, 1).alias("flow_divergence"), F.col("_n").cast("double").alias("peer_count"), "last", "self_momentum", "self_vol",
    )


SMART6 = ["smart_net_flow", "smart_share", "herding", "crowding", "whale_concentration", "smart_minus_dumb"]


def smart6(tape: DataFrame, cohort: DataFrame, cutoff: DataFrame, seconds: int = 3600, window: int = 12, horizon: int = 3, key: str = "market_id") -> DataFrame:
    """Six features of who traded in the 12 bars before a bar, all of them after the cohorts' cutoff.

    tape: key, t, seq, price, usd, token_amount, wallet; cohort: wallet, cohort ('smart' or 'dumb'); cutoff: one row.
    Trades are summed by bar and wallet before a bar is dealt to the 12 windows that hold it.
    """
    w = order(key)
    t = tape.withColumn("bar_ts", (F.floor(F.col("t") / seconds) * seconds).cast("long"))
    bars = t.groupBy(key, "bar_ts").agg(F.max_by("price", F.struct("t", "seq")).alias("close"), F.min("t").alias("_t0"))
    frame = w.rowsBetween(-window, -1)
    bars = bars.withColumns({
        "b": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy(key)), "_std": F.stddev_pop("close").over(frame), "_start": F.min("_t0").over(frame), "fwd": F.lead("close", horizon).over(w) - F.col("close"),
    })
    anchors = bars.crossJoin(F.broadcast(cutoff.select("cutoff"))).where((F.col("b") >= window) & (F.col("n") >= window + horizon + 2) & F.col("fwd").isNotNull() & (F.col("_start") >= F.col("cutoff")) & (F.col("_std") >= 1e-4))
    buys, usd = F.col("token_amount") > 0, F.abs("usd")
    by_wallet = t.groupBy(key, "bar_ts", "wallet").agg(F.sum(usd).alias("gross"), F.sum(F.when(buys, usd).otherwise(-usd)).alias("net"), F.max(buys).alias("buys"), F.max(~buys).alias("sells"))
    dealt = by_wallet.join(bars.select(key, "bar_ts", "b"), [key, "bar_ts"]).withColumn("i", F.explode(F.sequence(F.col("b") + 1, F.col("b") + window)))
    dealt = dealt.join(anchors.select(key, F.col("b").alias("i"), F.col("bar_ts").alias("anchor_ts")), [key, "i"]).join(cohort, "wallet", "left")
    each = dealt.groupBy(key, "anchor_ts", "wallet").agg(F.sum("gross").alias("gross"), F.sum("net").alias("net"), F.max("buys").alias("buys"), F.max("sells").alias("sells"), F.max("cohort").alias("cohort"))
    of = lambda c, who: F.sum(F.when(F.col("cohort") == who, F.col(c)).otherwise(0.0))
    total = F.sum("gross") + 1e-9
    smart, dumb = (of("net", who) / (of("gross", who) + 1e-9) for who in ("smart", "dumb"))
    return each.groupBy(key, F.col("anchor_ts").alias("bar_ts")).agg(
        smart.alias("smart_net_flow"), (of("gross", "smart") / total).alias("smart_share"), (F.abs(F.sum("net")) / total).alias("herding"),
        (F.greatest(F.count_if("buys"), F.count_if("sells")) / F.count("*")).alias("crowding"), (F.max("gross") / total).alias("whale_concentration"), (smart - dumb).alias("smart_minus_dumb"),
    )


def named_snapshots(tape: DataFrame, ends: DataFrame, shares: tuple[float, ...] = (0.15, 0.35, 0.55, 0.75, 0.9), recent: int = 24, key: str = "market_id") -> DataFrame:
    """The twelve snapshot features under the names that the base models use, and what the flow and cohort models call
    the same notions or need besides. tape has yes_price and yes_flow."""
    from .windows import snapshots12

    w = order(key, ("t", "seq"))
    late, steps = w.rowsBetween(-(recent - 1), 0), w.rowsBetween(-(recent - 2), 0)
    d = F.col("_d")
    s = tape.withColumn("_d", F.col("yes_price") - F.lag("yes_price").over(w)).select(
        key, F.row_number().over(w).alias("k"), F.coalesce(F.avg(d).over(steps), F.lit(0.0)).alias("mean_ret"), F.avg("yes_price").over(late).alias("_m"), F.coalesce(F.stddev_samp("yes_price").over(late), F.lit(0.0)).alias("_s"),
        F.sum(F.when(d > 0, d).otherwise(0.0)).over(steps).alias("_g"), F.sum(F.when(d < 0, -d).otherwise(0.0)).over(steps).alias("_l"), F.sum("usd").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_uv"),
    )
    base = snapshots12(tape, ends, shares, recent, key)
    j, moved, c = base.join(s, [key, "k"]), F.col("_g") + F.col("_l"), F.col
    return j.select(
        key, "k", c("price").alias("yes_price"), "signed_dist", c("dist").alias("dist_half"), c("time_rem").alias("time_remaining_frac"), c("log_hours").alias("log_hours_to_res"), c("momentum").alias("momentum_recent"), c("vol").alias("vol_recent"),
        c("flow_recent").alias("flow_imb_recent"), c("flow_cum").alias("flow_imb_cum"), c("maturity").alias("vol_maturity"), "log_trades", c("signed_maturity").alias("price_x_maturity"),
        c("price").alias("last"), "mean_ret", "vol", c("momentum").alias("drift"), F.when(c("_s") > 1e-9, (c("price") - c("_m")) / c("_s")).otherwise(0.0).alias("band_z"), "momentum", F.when(moved > 1e-9, (c("_g") - c("_l")) / moved).otherwise(0.0).alias("rsi"),
        c("flow_recent").alias("signed_imbalance"), c("flow_recent").alias("ofi_last"), c("flow_cum").alias("ofi_trend"), ((c("flow_recent") + 1) / 2).alias("buy_pressure"), c("log_trades").alias("trade_intensity"), (c("dist") * 2).alias("extremeness"), F.log1p("_uv").alias("log_volume"),
    )


def sequence_summary(tape: DataFrame, shares: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9), length: int = 48, horizon: int = 6, key: str = "market_id") -> DataFrame:
    """Ten figures of the `length` trades before the k-th, k the whole part of each share of a market's trades: levels,
    exponential means of moves, flow and side, plain means and the deviation. tape has yes_price, yes_flow, usd and
    outcome_index. Windows without a full past or `horizon` trades after them are left out; arrays are made at the
    selected rows only, after the others are gone."""
    w = order(key, ("t", "seq"))
    step = F.struct(F.col("yes_price").alias("p"), F.col("yes_flow").alias("f"), F.log1p(F.greatest(F.col("usd"), F.lit(0.0))).alias("s"), F.when(F.col("outcome_index") == 0, 1.0).otherwise(-1.0).alias("side"))
    s = tape.select(key, F.row_number().over(w).alias("k"), F.count("*").over(W.partitionBy(key)).alias("n"), step.alias("_step"))
    ends = s.groupBy(key).agg(F.max("n").alias("n")).select(key, "n", F.explode(F.array_distinct(F.array(*[F.floor(F.col("n") * x) for x in shares]))).alias("end")).where((F.col("end") >= length) & (F.col("end") + horizon <= F.col("n")))
    rows = s.drop("n").join(ends.drop("n"), key).where((F.col("k") <= F.col("end")) & (F.col("k") > F.col("end") - length))
    g = rows.groupBy(key, "end").agg(F.sort_array(F.collect_list(F.struct("k", "_step"))).alias("_q"))
    column = lambda c: F.transform("_q", lambda x: x["_step"][c])
    g = g.select(key, F.col("end").cast("long").alias("k"), *[column(c).alias(c) for c in ("p", "f", "s", "side")])
    g = g.withColumn("r", F.transform(F.slice("p", 2, length - 1), lambda x, k: x - F.get("p", k)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    fading = lambda c: F.aggregate(F.slice(c, 2, length), F.get(c, 0), lambda a, x: a + 0.3 * (x - a))
    last, mean = F.get("p", length - 1), total("p") / length
    spread = F.aggregate(F.transform("p", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return g.select(
        key, "k", last.alias("last"), (last - 0.5).alias("signed_dist"), F.abs(last - 0.5).alias("dist"), (last - F.get("p", 0)).alias("drift"), fading("r").alias("ewma_ret"), fading("f").alias("ewma_flow"), (total("f") / length).alias("mean_flow"),
        fading("side").alias("ewma_side"), F.sqrt(spread / (length - 1)).alias("std_price"), (total("s") / length).alias("mean_size"),
    )


def side_by_side(anchors: DataFrame, families: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """The families' features beside each anchor, named family_feature; zero where a family has no row or a null."""
    out, names = anchors, []
    for family, (rows, keys) in families.items():
        features = [c for c in rows.columns if c not in keys]
        names += [f"{family}_{c}" for c in features]
        out = out.join(rows.select(*keys, *[F.col(c).cast("double").alias(f"{family}_{c}") for c in features]), keys, "left")
    return out.select(*anchors.columns, *[F.coalesce(F.nanvl(n, F.lit(0.0)), F.lit(0.0)).alias(n) for n in names])
