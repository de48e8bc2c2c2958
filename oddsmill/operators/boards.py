"""Boards: what is ranked, summed and cut to a few rows for a screen. A top-k is one TakeOrdered, never a full sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(df: DataFrame, k: int, by: str | Column, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def breadth(markets: DataFrame, k: int = 200) -> DataFrame:
    m = top(markets, k, "volume24h", "market_id")
    up, down = F.col("chg24h") > 0.05, F.col("chg24h") < -0.05
    return m.agg(F.sum("volume24h").alias("volume24h"), F.sum("volume").alias("liquidity"), F.count("*").alias("n"), F.count_if(up).alias("advancers"), F.count_if(down).alias("decliners"), F.count_if(~up & ~down).alias("unchanged"))


def ticker(markets: DataFrame, least: float = 1000.0, k: int = 60) -> DataFrame:
    return top(markets.where(F.col("volume24h") > least), k, F.abs("chg24h"), "market_id").select("market_id", "last", "chg24h")


def sector_top(markets: DataFrame, k: int = 80, sector: str = "sector", value: str = "volume24h") -> DataFrame:
    """The k largest markets of each sector, with their rank (ties by id)."""
    w = W.partitionBy(sector).orderBy(F.desc(value), "market_id")
    return markets.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)  # a limit by rank: each task sends on k rows of a sector at most


def movers(markets: DataFrame, k: int = 25) -> DataFrame:
    """The k largest gainers and losers, with the numbers of each. Each side is a top-k of its own, so only 2 k rows are ranked."""
    m = markets.where("chg24h <> 0").withColumn("side", F.when(F.col("chg24h") > 0, "gainer").otherwise("loser"))
    n = m.groupBy("side").agg(F.count("*").alias("n_side"))
    best = [top(m.where(F.col("side") == side), k, F.abs("chg24h"), "market_id") for side in ("gainer", "loser")]
    w = W.partitionBy("side").orderBy(F.desc(F.abs("chg24h")), "market_id")
    return best[0].unionByName(best[1]).withColumn("rank", F.row_number().over(w)).join(F.broadcast(n), "side").select("side", "rank", "market_id", "chg24h", "n_side")


def tape_flow(tape: DataFrame) -> DataFrame:
    usd, buy = F.col("usd"), F.col("side") == "BUY"
    total = F.coalesce(F.sum("usd"), F.lit(0.0))
    bought = F.coalesce(F.sum(F.when(buy, usd).otherwise(0.0)), F.lit(0.0))
    return tape.agg(bought.alias("buy"), (total - bought).alias("sell"), total.alias("total"), F.count("*").alias("n"), F.coalesce(F.avg("usd"), F.lit(0.0)).alias("average"), F.max("usd").alias("largest"), F.max_by("market_id", F.struct("usd", "seq")).alias("largest_market"), F.when(total > 0, 100 * bought / total).otherwise(50.0).alias("buy_percent"))


def most_active(tape: DataFrame, k: int = 10) -> DataFrame:
    return top(tape.groupBy("market_id").agg(F.count("*").alias("n"), F.sum("usd").alias("notional")), k, "n", "market_id")


def portfolio(positions: DataFrame) -> DataFrame:
    value, cost = F.sum(F.col("size") * F.col("cur")), F.sum(F.abs("size") * F.col("avg"))
    pnl = F.sum(F.col("size") * (F.col("cur") - F.col("avg")))
    return positions.groupBy("wallet").agg(value.alias("value"), cost.alias("cost"), pnl.alias("pnl"), F.count_if(F.col("cur") > 0.985).alias("redeemable"), F.when(cost > 0, 100 * pnl / cost).otherwise(0.0).alias("return_percent"))


def holders(positions: DataFrame, k: int = 20) -> DataFrame:
    h = top(positions.where("size > 0"), k, "size", "wallet", "market_id")
    return h.select("wallet", "market_id", "size", (F.col("size") / F.max("size").over(W.partitionBy())).alias("share_of_max"))


def legs_by_turnover(markets: DataFrame, k: int = 8) -> DataFrame:
    w = W.partitionBy("basket_id").orderBy(F.desc("volume24h"), "market_id")
    return markets.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("basket_id", "rank", "market_id", "volume24h")


def ladder(levels: DataFrame, depth: int = 10) -> DataFrame:
    """Cumulative size of each side from the best level, over the larger side's."""
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = W.partitionBy("token", "side").orderBy(best)
    lv = levels.withColumns({"level": F.row_number().over(w), "cumulative": F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0))}).where(F.col("level") <= depth)
    return lv.withColumn("scaled", F.col("cumulative") / F.max("cumulative").over(W.partitionBy("token")))


def decimate(series: DataFrame, k: int, key: str = "market_id") -> DataFrame:
    """k points of each series at an even stride, both ends kept; shorter series stay whole."""
    w = W.partitionBy(key)
    s = series.withColumns({"i": F.row_number().over(w.orderBy("t", "seq")) - 1, "n": F.count("*").over(w)})
    # row i is the round of j * (n - 1) / (k - 1) for some whole j
    step = (F.col("n") - 1) / (k - 1)
    j = F.ceil((F.col("i") - 0.5) / step)
    return s.where((F.col("n") <= k) | ((F.floor(j * step + 0.5) == F.col("i")) & (j <= k - 1))).drop("n")


def intensity(markets: DataFrame, value: str = "chg24h") -> DataFrame:
    top_value = markets.agg(F.max(F.abs(value)).alias("_top"))
    v = F.col(value)
    return markets.crossJoin(F.broadcast(top_value)).select("market_id", F.when(F.col("_top") > 0, F.signum(v) * F.sqrt(F.least(F.lit(1.0), F.abs(v) / F.col("_top")))).otherwise(0.0).alias("intensity"))


def extent(series: DataFrame, key: str = "market_id", share: float = 0.08, least: float = 0.02) -> DataFrame:
    g = series.groupBy(key).agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.min("price").alias("p_min"), F.max("price").alias("p_max"))
    pad = F.greatest((F.col("p_max") - F.col("p_min")) * share, F.lit(least))
    return g.withColumns({"band_low": F.col("p_min") - pad, "band_high": F.col("p_max") + pad})


def latest_alerts(alerts: DataFrame) -> DataFrame:
    """The newest alert of each token, direction and target."""
    w = W.partitionBy("token", "op", "target").orderBy(F.desc("created"), F.desc("id"))
    return alerts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def watchlist(pins: DataFrame, markets: DataFrame) -> DataFrame:
    return pins.join(markets, "market_id").orderBy("added_at")


def alerts_with_quotes(alerts: DataFrame, quotes: DataFrame, near: float = 2.0) -> DataFrame:
    q = quotes.select("market_id", "last", ((F.col("best_bid") + F.col("best_ask")) / 2).alias("mid"))
    live = F.coalesce("last", "mid")
    gap = F.abs(live - F.col("target")) * 100
    return alerts.join(q, "market_id", "left").select("market_id", "op", "target", live.alias("live"), gap.alias("gap"), (gap <= near).alias("near"))


def search(direct: DataFrame, legs: DataFrame) -> DataFrame:
    """Direct hits and, of the events' legs, those that aren't among them; by turnover."""
    return direct.unionByName(legs.join(direct.select("market_id"), "market_id", "left_anti"))


def nearest(samples: DataFrame, points: DataFrame, key: str = "market_id") -> DataFrame:
    """For each sample the point of its series nearest in time, the earlier of equals: one union, one sort by key."""
    both = points.select(key, "t", F.col("price").alias("p"), F.lit(None).cast("long").alias("sample")).unionByName(samples.select(key, "t", F.lit(None).cast("double").alias("p"), "sample"))
    w = W.partitionBy(key).orderBy("t", F.col("sample").isNotNull())
    at = F.when(F.col("p").isNotNull(), F.struct("t", "p"))
    b = both.withColumns({"before": F.last(at, True).over(w.rowsBetween(W.unboundedPreceding, 0)), "after": F.first(at, True).over(w.rowsBetween(0, W.unboundedFollowing))})
    early = F.coalesce(F.col("t") - F.col("before.t") <= F.col("after.t") - F.col("t"), F.col("before").isNotNull())
    return b.where("sample is not null").select(key, "sample", "t", F.when(early, F.col("before.t")).otherwise(F.col("after.t")).alias("near_t"), F.when(early, F.col("before.p")).otherwise(F.col("after.p")).alias("near_price"))


def yes_price_asof(tape: DataFrame) -> DataFrame:
    """The last YES price at or before each trade, one half before the first."""
    w = W.partitionBy("market_id").orderBy("t", "seq").rowsBetween(W.unboundedPreceding, 0)
    return tape.withColumn("yes_price", F.coalesce(F.last(F.when(F.col("outcome_index") == 0, F.col("price")), True).over(w), F.lit(0.5)))


def siblings(markets: DataFrame) -> DataFrame:
    """Each leg with the number and prices of its siblings; windows over the basket, no self-join."""
    w = W.partitionBy(F.coalesce("basket_id", "market_id"))
    n = F.count("*").over(w)
    return markets.select("market_id", "basket_id", (n - 1).alias("n_siblings"), (F.sum("last").over(w) - F.col("last")).alias("siblings_sum"), F.max("last").over(w).alias("favourite"))


def panel(bars: DataFrame, legs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Bars of each basket by position, cut to its shortest leg, with the mean of the other legs."""
    b = bars.join(legs.select("market_id", "basket_id"), "market_id").withColumns({"i": F.row_number().over(W.partitionBy("market_id").orderBy("bar_ts")), "n": F.count("*").over(W.partitionBy("market_id"))})
    short = b.groupBy("basket_id").agg(F.min("n").alias("shortest"))
    b = b.join(short, "basket_id").where(F.col("i") <= F.col("shortest"))
    w = W.partitionBy("basket_id", "i")
    n = F.count("*").over(w)
    return b.select("basket_id", "market_id", "i", *carry, "close", (n - 1).alias("n_peers"), F.when(n > 1, (F.sum("close").over(w) - F.col("close")) / (n - 1)).otherwise(F.col("close")).alias("peer_mean"))


def first_time_wallets(tape: DataFrame) -> DataFrame:
    """Whether a trade is its wallet's first in the market."""
    w = W.partitionBy("market_id", "wallet").orderBy("t", "seq")
    return tape.withColumn("first_time", F.row_number().over(w) == 1)
