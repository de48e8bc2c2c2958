"""Features over the fills or the trades of a window, not over its bars.

Fills are folded to parts by bar (sums, sums of products, sizes, what the window's first and last rows would add), and
frames of 16 bars add the parts up; wallets are followed by what enters and leaves their windows. A fill is in one row
of one shuffle, not in one for each window that holds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from .windows import WINDOW, order, over_stretches

#: Fixed values of the fill features.
ROLLING_FILLS, IMPACT_UNIT, EPS = 5, 1e-3, 1e-9


def _fill_rows(fills: DataFrame, key: str, impact_unit: float) -> DataFrame:
    """What each fill adds to every window that holds it, and what a window that begins or ends at it has otherwise.

    The first fills of a window have fewer fills before them than they have on the tape: `fix_*`, on the first fill of a
    bar, changes the sums of a window that begins there.
    """
    o = order(key, ("t", "seq"))
    p = F.col("price")
    mid = F.avg("price").over(o.rowsBetween(-ROLLING_FILLS, -1))
    f = fills.withColumns({
        "gap": F.when(mid > EPS, F.abs(p - mid) / mid), "back": F.try_divide(F.col("direction") * (p - F.lead("price").over(o)), p), "dp": p - F.lag("price").over(o), "x": F.col("direction") * F.col("usd") / impact_unit,
        "begins": ~F.coalesce(F.lag("bar_ts").over(o) == F.col("bar_ts"), F.lit(False)), "ends": ~F.coalesce(F.lead("bar_ts").over(o) == F.col("bar_ts"), F.lit(False)), **{f"_p{j}": F.lead("price", j).over(o) for j in range(ROLLING_FILLS)},
    })
    short = []
    for j in range(1, ROLLING_FILLS):
        m = sum((F.col(f"_p{k}") for k in range(1, j)), F.col("_p0")) / j
        short.append(F.when(m > EPS, F.abs(F.col(f"_p{j}") - m) / m))
    own = [F.lead("gap", j).over(o) for j in range(ROLLING_FILLS)]
    total = lambda xs: sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
    known = lambda xs: sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int"))
    f = f.withColumns({"fix_gap": F.when(F.col("begins"), total(short) - total(own)), "fix_n": F.when(F.col("begins"), known(short) - known(own))})
    return f.drop(*[f"_p{j}" for j in range(ROLLING_FILLS)])


def _shares_squared(fills: DataFrame, bars: DataFrame, member: str, key: str) -> DataFrame:
    """(key, i, squares): the sum over members of the square of what each traded in the 16 bars before bar i.

    A bar's sum enters its member's window one bar later and leaves it 16 bars after that; each change of a member's sum
    changes the squares by a known amount, so running sums over the changes give every window.
    """
    m = fills.groupBy(key, "bar_ts", member).agg(F.sum("usd").alias("w")).join(bars.select(key, "bar_ts", "b"), [key, "bar_ts"])
    moves = F.array(F.struct((F.col("b") + 1).alias("i"), F.col("w").alias("w")), F.struct((F.col("b") + 1 + WINDOW).alias("i"), (-F.col("w")).alias("w")))
    m = m.select(key, member, F.explode(moves).alias("m")).groupBy(key, member, F.col("m.i").alias("i")).agg(F.sum("m.w").alias("w"))
    after = F.sum("w").over(W.partitionBy(key, member).orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    m = m.withColumn("_after", after).groupBy(key, "i").agg(F.sum(F.col("w") * (2 * F.col("_after") - F.col("w"))).alias("_change"))
    return m.select(key, "i", F.sum("_change").over(W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, 0)).alias("squares"))


def micro14(fills: DataFrame, seconds: int = 21600, key: str = "market_id", impact_unit: float = IMPACT_UNIT, hot: Sequence = ()) -> DataFrame:
    """Ten features of the fills in a window of 16 bars, and four of its volume-weighted prices.

    fills: key, t, seq, price, usd, direction, fee, maker, taker. `hot` has the keys whose fills are cut in stretches; their
    bars are as many as the time they cover has.
    """
    f = fills.withColumn("bar_ts", (F.floor(F.col("t") / seconds) * seconds).cast("long"))
    rows = over_stretches(lambda s, k: _fill_rows(s, k, impact_unit), f, list(hot), key, ("t", "seq"), before=2 * ROLLING_FILLS, after=2 * ROLLING_FILLS)
    usd, x, y = F.col("usd"), F.when(F.col("dp").isNotNull(), F.col("x")), F.col("dp")
    first, last = (lambda c: F.max(F.when(F.col("begins"), c))), (lambda c: F.max(F.when(F.col("ends"), c)))
    products = {"n": x.isNotNull().cast("double"), "x": x, "y": F.when(x.isNotNull(), y), "xy": x * y, "xx": x * x}
    parts = rows.groupBy(key, "bar_ts").agg(
        F.try_divide(F.sum(F.col("price") * usd), F.sum("usd")).alias("close"), F.count("*").cast("double").alias("fills"), F.sum("usd").alias("su"), F.sum(usd * usd).alias("suu"), F.sum("fee").alias("fee"), F.collect_list("usd").alias("sizes"),
        F.sum("gap").alias("gap"), F.count("gap").alias("n_gap"), first(F.col("fix_gap")).alias("fix_gap"), first(F.col("fix_n")).alias("fix_n"), F.sum("back").alias("back"), F.count("back").alias("n_back"), last(F.col("back")).alias("last_back"),
        *[F.sum(c).alias(f"s_{k}") for k, c in products.items()], *[first(c).alias(f"f_{k}") for k, c in products.items()],
    )
    w = order(key)
    frame, steps = w.rowsBetween(-WINDOW, -1), w.rowsBetween(-(WINDOW - 1), -1)
    bars = parts.withColumns({"b": F.row_number().over(w) - 1, "_d": F.col("close") - F.lag("close").over(w)})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    over = lambda c: zero(F.sum(c).over(frame))
    at = lambda c, k: zero(F.lag(c, k).over(w))
    a = bars.withColumns({
        "fill_rate": (F.lag("fills").over(w) - F.avg("fills").over(frame)) / (F.stddev_samp("fills").over(frame) + EPS), "last": F.lag("close").over(w), "mean_ret": F.avg("_d").over(steps), "vol": F.stddev_samp("_d").over(steps), "momentum": F.avg("_d").over(w.rowsBetween(-4, -1)),
        "_n": over("fills"), "_u": over("su"), "_uu": over("suu"), "_fee": over("fee"), "_sizes": F.flatten(F.collect_list("sizes").over(frame)), "_gap": over("gap") + at("fix_gap", WINDOW), "_ng": over("n_gap") + at("fix_n", WINDOW),
        "_back": over("back") - at("last_back", 1), "_nb": over("n_back") - F.lag("last_back").over(w).isNotNull().cast("int"), **{f"_{k}": over(f"s_{k}") - at(f"f_{k}", WINDOW) for k in products if k != "n"}, "_k": over("s_n") - at("f_n", WINDOW),
    }).where(F.col("b") >= WINDOW)
    mean = F.col("_u") / F.col("_n")
    deviation = F.sqrt(F.greatest(F.col("_uu") - F.col("_u") * mean, F.lit(0.0)) / (F.col("_n") - 1))
    top = F.aggregate(F.slice(F.sort_array("_sizes", False), 1, F.greatest(F.lit(1), F.floor(F.col("_n") / 10)).cast("int")), F.lit(0.0), lambda s, v: s + v)
    spread = F.col("_xx") - F.try_divide(F.col("_x") * F.col("_x"), F.col("_k"))
    a = a.select(
        key, "bar_ts", F.col("b").alias("i"), "fill_rate", "last", "mean_ret", "vol", "momentum", "_u",
        zero(F.try_divide("_gap", "_ng")).alias("effective_spread"), zero(F.try_divide("_back", "_nb")).alias("realized_spread"), F.log1p(mean).alias("fill_size_mean"), zero(F.try_divide(deviation, mean)).alias("fill_size_cv"), F.try_divide(top, F.col("_u")).alias("large_fill_ratio"),
        F.when(spread < EPS, 0.0).otherwise(zero(F.try_divide(F.col("_xy") - F.try_divide(F.col("_x") * F.col("_y"), F.col("_k")), spread))).alias("price_impact"), F.try_divide("_fee", "_u").alias("fee_intensity"),
    )
    for member in ("maker", "taker"):
        share = clamp(F.try_divide(F.col("squares"), F.col("_u") * F.col("_u")), 0, 1)
        a = a.join(_shares_squared(f, bars, member, key), [key, "i"]).withColumn(f"{member}_hhi", share).drop("squares")
    return a.drop("i", "_u")


def smart10(tape: DataFrame, smart: DataFrame, key: str = "market_id", hot: Sequence = ()) -> DataFrame:
    """Ten features of who traded in the window of 16 trades; `smart` has the wallets of the cohort.

    tape: key, t, seq, price, usd, wallet, role, side. A wallet's first trade in a market is found once; all else is frames of
    one order, and the two features that need whole wallets look at the frame's 16 trades as an array.
    """
    s = tape.join(smart.select("wallet").distinct().withColumn("is_smart", F.lit(True)), "wallet", "left")
    at = F.struct("t", "seq")
    s = s.withColumn("fresh", (F.min(at).over(W.partitionBy(key, "wallet")) == at).cast("double"))

    def features(d: DataFrame, k: str) -> DataFrame:
        w = order(k, ("t", "seq"))
        frame = w.rowsBetween(-WINDOW, -1)
        signed, known, usd = F.when(F.col("side") == "BUY", F.col("usd")).otherwise(-F.col("usd")), F.coalesce("is_smart", F.lit(False)), F.col("usd")
        over = lambda c: F.sum(c).over(frame)
        d = d.withColumns({
            "_n": F.count("*").over(frame), "_net": over(signed), "_smart_net": over(F.when(known, signed).otherwise(0.0)), "_smart": over(F.when(known, usd).otherwise(0.0)), "_total": over(usd) + EPS,
            "_maker": over(F.when(F.col("role") == "maker", usd).otherwise(0.0)), "_fresh": over("fresh"), "last": F.lag("price").over(w), "_trades": F.collect_list(F.struct("wallet", "usd")).over(frame),
        }).where(F.col("_n") == WINDOW)
        traded = F.transform("_trades", lambda x: F.aggregate(F.filter("_trades", lambda y: y["wallet"].eqNullSafe(x["wallet"])), F.lit(0.0), lambda t, y: t + y["usd"]))
        total = F.col("_total")
        return d.select(
            k, "t", "seq", (F.col("_smart_net") / total).alias("smart_net_flow"), (F.col("_smart") / total).alias("smart_share"), ((2 * F.col("_smart_net") - F.col("_net")) / total).alias("smart_minus_dumb"), (F.abs("_net") / total).alias("herding"), (F.col("_net") / total).alias("flow_imbalance"),
            (F.col("_fresh") / F.size(F.array_distinct("_trades.wallet"))).alias("crowding"), (F.col("_maker") / total).alias("maker_taker_ratio"), (F.array_max(traded) / total).alias("whale_concentration"), "last", (F.abs(F.col("last") - 0.5) * 2).alias("extremeness"),
        )

    return over_stretches(features, s, list(hot), key, ("t", "seq"), before=WINDOW + 1, after=0).withColumnRenamed("seq", "anchor").drop("t")


def latest12(series: DataFrame, key: str = "market_id", least: int = 8) -> DataFrame:
    """Twelve features of each series' last 16 points."""
    newest = series.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("t"), F.desc("seq")))).where(F.col("_r") <= WINDOW)
    w = order(key, ("t", "seq"))
    s = newest.withColumns({"d": F.col("price") - F.lag("price").over(w)}).withColumn("dm", F.col("d") - F.avg("d").over(W.partitionBy(key)))
    s = s.withColumn("dm0", F.lag("dm").over(w))
    p, d = F.col("price"), F.col("d")
    at = F.struct("t", "seq")
    g = s.groupBy(key).agg(
        F.count("*").alias("n"), F.max_by("price", at).alias("last"), F.avg(p).alias("mean_p"), F.min_by("price", at).alias("first"), F.stddev_samp(d).alias("vol"), F.avg(F.when(F.col("_r") <= 4, d)).alias("momentum"), F.stddev_samp(p).alias("sp"),
        F.sum(d).alias("sd"), F.sum(F.abs(d)).alias("activity"), F.sum(F.col("dm") * F.col("dm0")).alias("num"), F.sum(F.col("dm") * F.col("dm")).alias("den"), F.min(p).alias("lo"), F.max(p).alias("hi"),
    ).where(F.col("n") >= least)
    span = F.col("hi") - F.col("lo")
    return g.select(
        key, "last", "mean_p", (F.col("last") - F.col("first")).alias("drift"), "vol", "momentum", F.when(F.col("sp") > 1e-9, (F.col("last") - F.col("mean_p")) / F.col("sp")).otherwise(0.0).alias("band_z"),
        F.when(F.col("activity") > EPS, F.col("sd") / F.col("activity")).otherwise(0.0).alias("rsi"), F.when(F.col("den") > 1e-12, clamp(F.col("num") / F.col("den"), -1, 1)).otherwise(0.0).alias("autocorr"),
        F.when(span >= EPS, (F.col("last") - F.col("lo")) / span).otherwise(0.5).alias("stoch_k"), span.alias("range"), (F.abs(F.col("last") - 0.5) * 2).alias("extremeness"), "activity",
    )
