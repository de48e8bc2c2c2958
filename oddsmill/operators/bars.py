"""Bars from a trade tape. All are plain aggregates, so Spark combines them map-side and in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WHALE_USD = 1000.0


def _start(seconds: int) -> Column:
    return (F.floor(F.col("t") / seconds) * seconds).cast("long")


def _sides(whale: float) -> dict[str, Column]:
    usd, buy = F.col("usd"), F.col("side") == "BUY"
    return {
        "signed_vol": F.sum(F.when(buy, usd).otherwise(-usd)),
        "buy_vol": F.sum(F.when(buy, usd).otherwise(0.0)),
        "sell_vol": F.sum(F.when(buy, 0.0).otherwise(usd)),
        "whale_vol": F.sum(F.when(usd >= whale, usd).otherwise(0.0)),
    }


def ohlcv_flow(tape: DataFrame, seconds: int = 3600, key: str = "market_id", whale: float = WHALE_USD) -> DataFrame:
    """Open, high, low, close by (t, seq), volume, count and signed, buy, sell and large-print volume of each bar."""
    at = F.struct("t", "seq")
    aggs = {"open": F.min_by("price", at), "high": F.max("price"), "low": F.min("price"), "close": F.max_by("price", at), "volume": F.sum("usd"), "trades": F.count("*")} | _sides(whale)
    return tape.groupBy(key, _start(seconds).alias("bar_ts")).agg(*[c.alias(n) for n, c in aggs.items()])


def ohlcv_simple(tape: DataFrame, seconds: int = 3600, min_bars: int = 40, key: str = "market_id") -> DataFrame:
    """Bars of keys that have min_bars of them or more; the count is a window over bars, not over trades."""
    b = ohlcv_flow(tape, seconds, key).select(key, "bar_ts", "open", "high", "low", "close", "volume", "trades", F.col("signed_vol").alias("signed_flow"))
    return b.withColumn("n_bars", F.count("*").over(W.partitionBy(key))).where(F.col("n_bars") >= min_bars)


def partial_bars(tape: DataFrame, seconds: int, key: str = "market_id") -> DataFrame:
    """Bars that can be merged with others of the same key and time: they keep their first and last moments."""
    at = F.struct("t", "seq")
    aggs = {"first_at": F.min(at), "last_at": F.max(at), "open": F.min_by("price", at), "high": F.max("price"), "low": F.min("price"), "close": F.max_by("price", at), "volume": F.sum("usd"), "trades": F.count("*")} | _sides(WHALE_USD)
    return tape.groupBy(key, _start(seconds).alias("bar_ts")).agg(*[c.alias(n) for n, c in aggs.items()])


def merge_partial(parts: DataFrame, key: str = "market_id") -> DataFrame:
    """One bar of several partial ones."""
    sums = [F.sum(c).alias(c) for c in ("volume", "trades", "signed_vol", "buy_vol", "sell_vol", "whale_vol")]
    return parts.groupBy(key, "bar_ts").agg(F.min_by("open", "first_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_at").alias("close"), *sums)


def vwap(tape: DataFrame, seconds: int = 3600, key: str = "market_id") -> DataFrame:
    """Volume-weighted close (the last price without volume) and fills of each bar."""
    total = F.sum("usd")
    mean = F.when(total > 0, F.sum(F.col("price") * F.col("usd")) / total).otherwise(F.max_by("price", F.struct("t", "seq")))
    return tape.groupBy(key, _start(seconds).alias("bar_ts")).agg(mean.alias("close"), total.alias("volume"), F.count("*").alias("fills"))


def last_price(tape: DataFrame, seconds: int = 3600, key: str = "market_id") -> DataFrame:
    return tape.groupBy(key, _start(seconds).alias("bar_ts")).agg(F.max_by("price", F.struct("t", "seq")).alias("close"))


def multi_resolution(tape: DataFrame, resolutions: dict[int, int], key: str = "market_id") -> DataFrame:
    """Bars at several lengths from one scan, each for its own number of busiest keys (ties by key)."""
    busy = tape.groupBy(key).agg(F.count("*").alias("n"))
    keep = None
    for seconds, top in resolutions.items():
        part = busy.orderBy(F.desc("n"), key).limit(top).select(F.lit(seconds).alias("seconds"), key)
        keep = part if keep is None else keep.unionByName(part)
    at = F.struct("t", "seq")
    rows = tape.join(keep, key).withColumn("bar_ts", (F.floor(F.col("t") / F.col("seconds")) * F.col("seconds")).cast("long"))
    return rows.groupBy("seconds", key, "bar_ts").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("usd").alias("volume"), F.count("*").alias("trades"))


def channels(bars: DataFrame, key: str = "market_id") -> DataFrame:
    """Per bar: return on the close before (0 for the first), range and body over the close, log volume, flow share, log trades."""
    c = F.col("close")
    before = F.coalesce(F.lag("close").over(W.partitionBy(key).orderBy("bar_ts")), c)
    over = F.greatest(c, F.lit(1e-6))
    return bars.select(
        key, "bar_ts", ((c - before) / F.greatest(before, F.lit(1e-6))).alias("ret"), ((F.col("high") - F.col("low")) / over).alias("range"), ((c - F.col("open")) / over).alias("body"),
        F.log1p("volume").alias("log_volume"), (F.col("signed_vol") / (F.col("volume") + 1e-9)).alias("flow"), F.log1p(F.col("trades").cast("double")).alias("log_trades"),
    )
