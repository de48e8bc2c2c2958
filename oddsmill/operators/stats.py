"""Statistics of series, books and cross-sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranks
from ..functions.scalars import clamp, saturate


def describe(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, sample deviation (0 below two rows), median and scaled median absolute deviation by key."""
    med = df.withColumn("_m", F.median(value).over(W.partitionBy(key)))
    return med.groupBy(key).agg(
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.coalesce(F.median(value), F.lit(0.0)).alias("median"),
        F.when(F.count(value) < 2, 0.0).otherwise(1.4826 * F.median(F.abs(F.col(value) - F.col("_m")))).alias("mad"),
    )


def populations(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row of what robust z scores need of several columns: n, median, mad, mean, std, each with its prefix.

    Medians are selected over ranges (see ranks.quantiles), all columns in one pass, their deviations in a second.
    """
    x = df.select(F.explode(F.array(*[F.struct(F.lit(p).alias("g"), F.col(c).cast("double").alias("x")) for p, c in columns.items()])).alias("s")).select("s.g", "s.x").where("x is not null")
    medians = ranks.quantiles(x, "x", {"median": 0.5}, "g")
    away = x.join(F.broadcast(medians), "g").select("g", F.abs(F.col("x") - F.col("median")).alias("x"))
    mads = ranks.quantiles(away, "x", {"mad": 0.5}, "g")
    m = x.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")).join(F.broadcast(medians), "g").join(F.broadcast(mads), "g")
    m = m.withColumn("mad", 1.4826 * F.col("mad"))
    one = lambda p, c: F.max(F.when(F.col("g") == p, F.col(c)))
    return m.agg(*[(F.coalesce(one(p, c), F.lit(0)) if c == "n" else one(p, c)).alias(p + c) for p in columns for c in ("n", "median", "mad", "mean", "std")])


def population(df: DataFrame, value: str, prefix: str = "") -> DataFrame:
    """populations of one column."""
    return populations(df, {prefix: value})


def robust_z(x: Column, prefix: str = "") -> Column:
    """(x - median) / mad against a joined population row, or (x - mean) / std where the mad is flat; 0 below four rows."""
    c = lambda n: F.col(prefix + n)
    z = F.when(c("mad") > 1e-9, (x - c("median")) / c("mad")).when(c("std") > 1e-9, (x - c("mean")) / c("std"))
    return F.when(c("n") < 4, 0.0).otherwise(F.coalesce(z, F.lit(0.0)))


def volume_ratio(markets: DataFrame) -> Column:
    """Log of a day's turnover over the week's daily mean, null where the mean is 500 or less."""
    base = F.col("volume1w") / 7
    return F.when(base > 500, F.log(F.col("volume24h") / base))


def cross_section(markets: DataFrame, least: float = 5000.0) -> DataFrame:
    m = markets.where(F.col("volume24h") >= least)
    return m.select("market_id", volume_ratio(m).alias("volume_ratio"), F.abs("chg24h").alias("abs_move"))


def history_stats(series: DataFrame, key: str = "market_id") -> DataFrame:
    """Volatility and drift a day, lag-1 autocorrelation, place in the band of the last 60, volatility late over early."""
    w, whole = W.partitionBy(key).orderBy("t", "seq"), W.partitionBy(key)
    s = series.select(key, "t", "seq", F.col("price").alias("p"))
    s = s.withColumns({"d": F.col("p") - F.lag("p").over(w), "i": F.row_number().over(w), "n": F.count("*").over(whole), "t0": F.min("t").over(whole)})
    s = s.withColumn("dm", F.col("d") - F.avg("d").over(whole)).withColumn("dm0", F.lag("dm").over(w))
    cut = F.floor(F.col("n") / 2)
    late, early = F.when(F.col("i") >= cut + 2, F.col("d")), F.when((F.col("i") >= 2) & (F.col("i") <= cut), F.col("d"))
    tail = F.when(F.col("i") > F.col("n") - 60, F.col("p"))
    g = s.groupBy(key).agg(
        F.count("*").alias("n"),
        F.stddev_samp("d").alias("sd"),
        (F.max("t") - F.min("t")).alias("span"),
        F.regr_slope(F.col("p") * 100, (F.col("t") - F.col("t0")) / 86400).alias("slope"),
        F.sum(F.col("dm") * F.col("dm0")).alias("num"),
        F.sum(F.col("dm") * F.col("dm")).alias("den"),
        F.stddev_samp(late).alias("late"),
        F.stddev_samp(early).alias("early"),
        F.avg(tail).alias("tail_mean"),
        F.stddev_samp(tail).alias("tail_std"),
        F.max_by("p", F.struct("t", "seq")).alias("p_last"),
    )
    spacing = F.col("span") / (F.col("n") - 1)
    n = F.col("n")
    return g.select(
        key, "n",
        F.when((n >= 3) & (spacing > 0), F.col("sd") * F.sqrt(86400 / spacing) * 100).otherwise(0.0).alias("realised_vol"),
        F.when(n >= 3, F.coalesce("slope", F.lit(0.0))).otherwise(0.0).alias("drift_per_day"),
        F.when((n >= 9) & (F.col("den") > 1e-12), clamp(F.col("num") / F.col("den"), -1, 1)).otherwise(0.0).alias("autocorr"),
        F.when((n >= 12) & (F.col("tail_std") >= 1e-6), (F.col("p_last") - F.col("tail_mean")) / F.col("tail_std")).otherwise(0.0).alias("band_z"),
        F.when((n >= 24) & (F.col("early") >= 1e-9), F.col("late") / F.col("early")).otherwise(1.0).alias("vol_compression"),
    )


def book_stats(levels: DataFrame, depth: int = 10) -> DataFrame:
    """Quotes, lean, imbalance and depth of each two-sided book from (token, side, price, size)."""
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    lv = levels.withColumn("r", F.row_number().over(W.partitionBy("token", "side").orderBy(best)))
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    top = lambda side, c: F.max(F.when(side & (F.col("r") == 1), F.col(c)))
    deep = lambda side, v: F.sum(F.when(side & (F.col("r") <= depth), v * F.col("size")).otherwise(0.0))
    g = lv.groupBy("token").agg(
        top(bid, "price").alias("best_bid"), top(ask, "price").alias("best_ask"), top(bid, "size").alias("bid_size"), top(ask, "size").alias("ask_size"),
        deep(bid, F.col("price")).alias("bid_notional"), deep(ask, 1 - F.col("price")).alias("ask_notional"),
        F.collect_list(F.struct("side", "price", "size")).alias("levels"),
    ).where("best_bid is not null and best_ask is not null")
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    within = lambda side, ok: F.aggregate(F.filter("levels", lambda x: (x["side"] == side) & ok(x["price"])), F.lit(0.0), lambda s, x: s + x["price"] * x["size"])
    g = g.withColumn("mid", mid).withColumn("spread", F.col("best_ask") - F.col("best_bid"))
    g = g.withColumns({"cost_up": within("ask", lambda p: p <= F.col("mid") + 0.01), "cost_down": within("bid", lambda p: p >= F.col("mid") - 0.01)})
    sizes, total = F.col("bid_size") + F.col("ask_size"), F.col("bid_notional") + F.col("ask_notional")
    micro = F.when(sizes > 0, (F.col("bid_size") * F.col("best_ask") + F.col("ask_size") * F.col("best_bid")) / sizes).otherwise(F.col("mid"))
    tight = 1 - clamp(F.when(F.col("mid") > 0, F.col("spread") / F.col("mid")).otherwise(1.0) / 0.1, 0, 1)
    return g.select(
        "token", "best_bid", "best_ask", "mid", "spread", micro.alias("micro_price"), ((micro - F.col("mid")) * 100).alias("micro_lean"),
        F.when(total > 0, (F.col("bid_notional") - F.col("ask_notional")) / total).otherwise(0.0).alias("imbalance"),
        "bid_notional", "ask_notional", "cost_up", "cost_down",
        F.when(F.col("cost_up") <= F.col("cost_down"), "offer").otherwise("bid").alias("thin_side"),
        (tight * saturate(F.least("bid_notional", "ask_notional"), 15000)).alias("liquidity_score"),
    )


def percentile_of(values: DataFrame, value: str) -> DataFrame:
    """Adds `share`, the part of the population at or below each member; nulls count as the lowest."""
    return ranks.share_at_or_below(values, value)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, 0 where either side is flat."""
    c = F.corr(x, y)
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)


def ols_beta(y: Column, x: Column) -> Column:
    """Slope of y on x within -10..10, 0 where x is flat."""
    return F.when(F.var_samp(x) < 1e-9, 0.0).otherwise(F.coalesce(clamp(F.regr_slope(y, x), -10, 10), F.lit(0.0)))


def hhi(df: DataFrame, keys: list[str], member: str, weight: str) -> DataFrame:
    """Sum of squared shares of non-negative weights. Two aggregates: members, then keys."""
    m = df.groupBy(*keys, member).agg(F.sum(F.greatest(F.col(weight), F.lit(0.0))).alias("w"))
    total = F.sum("w")
    return m.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col("w") * F.col("w")) / (total * total)).otherwise(0.0).alias("hhi"))


def coef_variation(x: str) -> Column:
    """Population deviation over the mean, never below 0."""
    mean = F.avg(x)
    return F.when(F.abs(mean) > 1e-12, F.greatest(F.stddev_pop(x) / mean, F.lit(0.0))).otherwise(0.0)
