"""Scores against outcomes: discrimination, calibration, deciles, and trading on the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from . import ranks


def auc(df: DataFrame, score: str = "prob", label: str = "outcome") -> DataFrame:
    """Area under the curve from average ranks; one half if a class is missing."""
    pos = F.col(label) > 0.5
    g = ranks.average_rank(df.select(score, label), score).agg(F.sum(F.when(pos, F.col("rank"))).alias("r"), F.count_if(pos).alias("p"), F.count_if(~pos).alias("q"))
    return g.select(F.when((F.col("p") == 0) | (F.col("q") == 0), 0.5).otherwise((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def losses(df: DataFrame, score: str = "prob", label: str = "outcome", eps: float = 1e-12, *keys: str) -> DataFrame:
    p, y = clamp(score, eps, 1 - eps), F.col(label)
    up, right = y > 0.5, (F.col(score) > 0.5) == (y > 0.5)
    rate = lambda which: F.coalesce(F.avg(F.when(which, right.cast("double"))), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.avg(F.pow(F.col(score) - y, 2)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
        F.avg(right.cast("double")).alias("accuracy"), ((rate(up) + rate(~up)) / 2).alias("balanced_accuracy"), F.count("*").alias("n"),
    )


def bins(df: DataFrame, score: str = "prob", label: str = "outcome", n: int = 10, *keys: str) -> DataFrame:
    """Equal-width bins of a score that hold rows: bounds, count, mean score and mean outcome."""
    b = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col(score) * n))).cast("int")
    g = df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("count"), F.avg(score).alias("mean_pred"), F.avg(label).alias("mean_outcome"))
    return g.withColumns({"lo": F.col("bin") / n, "hi": (F.col("bin") + 1) / n})


def calibration_error(df: DataFrame, score: str = "prob", label: str = "outcome", n: int = 10) -> DataFrame:
    return bins(df, score, label, n).agg((F.sum(F.col("count") * F.abs(F.col("mean_pred") - F.col("mean_outcome"))) / F.sum("count")).alias("ece"))


def extremes(df: DataFrame, score: str = "prob", value: str = "fwd", tie: str = "seq", q: float = 0.2) -> DataFrame:
    """Up-rates and medians of the top and the bottom q by score, and their spread."""
    d = ranks.row_index(df.select(score, value, tie), score, tie)
    k = F.greatest(F.lit(1), F.floor(F.col("n") * q))
    d = d.where((F.col("i") < k) | (F.col("i") >= F.col("n") - k)).withColumn("top", F.col("i") >= F.col("n") - k).withColumn("k", k)
    rate = lambda top: F.avg(F.when(F.col("top") == top, (F.col(value) > 0).cast("double")))
    g = d.agg(rate(True).alias("top_up_rate"), rate(False).alias("bottom_up_rate"), F.max("k").alias("k"))
    mid = ranks.quantiles(d, value, {"median": 0.5}, "top")
    mid = mid.agg(F.max(F.when(F.col("top"), F.col("median"))).alias("top_median"), F.max(F.when(~F.col("top"), F.col("median"))).alias("bottom_median"))
    return g.crossJoin(F.broadcast(mid)).withColumn("spread", F.col("top_up_rate") - F.col("bottom_up_rate"))


def deciles(df: DataFrame, score: str = "prob", value: str = "fwd", tie: str = "seq") -> DataFrame:
    """Ten slices by score, cut at the whole part of n * d / 10: up-rate, mean score and mean value."""
    d = ranks.row_index(df.select(score, value, tie), score, tie)
    # the slice of row i is the largest d with floor(n * d / 10) <= i
    slice_ = F.floor(((F.col("i") + 1) * 10 - 1) / F.col("n"))
    return d.groupBy(slice_.cast("int").alias("decile")).agg(F.avg((F.col(value) > 0).cast("double")).alias("up_rate"), F.avg(score).alias("mean_score"), F.avg(value).alias("mean_value"), F.count("*").alias("count"))


def trades(records: DataFrame, threshold: Column | float = 0.0, fee: Column | float = 0.01) -> DataFrame:
    """The edge trade that each record opens: YES if the model is above the price by the threshold, NO if below."""
    t, f = (x if isinstance(x, Column) else F.lit(x) for x in (threshold, fee))
    edge, y, price = F.col("prob") - F.col("market_price"), F.col("outcome"), F.col("market_price")
    d = records.where(F.abs(edge) > t).withColumn("edge", F.abs(edge))
    gross = F.when(edge > 0, y - price).otherwise(price - y)
    return d.withColumns({"gross": gross, "net": gross - f, "won": F.when(edge > 0, y > 0.5).otherwise(y <= 0.5)})


def results(traded: DataFrame, *keys: str) -> DataFrame:
    std = F.stddev_pop("net")
    return traded.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.sum("net").alias("pnl"), F.avg("net").alias("mean_return"), F.avg(F.col("won").cast("double")).alias("hit_rate"),
        F.avg("gross").alias("avg_edge"), F.avg("edge").alias("avg_model_edge"), F.when(std > 1e-12, F.avg("net") / std).otherwise(0.0).alias("sharpe"),
    )


def drawdown(traded: DataFrame, *keys: str) -> DataFrame:
    """Deepest fall of the summed net from its peak, the peak starting at 0, by time within each key."""
    w = W.partitionBy(*keys).orderBy("ts", "seq")
    e = traded.withColumn("equity", F.sum("net").over(w.rowsBetween(W.unboundedPreceding, 0)))
    e = e.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0))))
    return e.groupBy(*keys).agg(F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"))


def drawdown_blocks(traded: DataFrame, seconds: float) -> DataFrame:
    """The same over all rows, by blocks of time: each block gives its sum, extremes and own fall, and only those few
    rows are put in order."""
    b = F.floor(F.col("ts") / seconds)
    w = W.partitionBy("_b").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    e = traded.withColumn("_b", b).withColumn("s", F.sum("net").over(w))
    e = e.withColumn("top", F.max("s").over(w))
    blocks = e.groupBy("_b").agg(F.sum("net").alias("total"), F.max("top").alias("high"), F.min("s").alias("low"), F.max(F.greatest(F.lit(0.0), F.col("top")) - F.col("s")).alias("own"))
    o = W.orderBy("_b")
    before = F.coalesce(F.sum("total").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    blocks = blocks.withColumn("start", before)
    peak = F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("start") + F.col("high")).over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    return blocks.withColumn("fall", F.greatest(F.col("own"), peak - (F.col("start") + F.col("low")))).agg(F.max("fall").alias("max_drawdown"))


def sweep(records: DataFrame, thresholds: list[float], fee: float = 0.01) -> DataFrame:
    """Results at each threshold: every record is read once and joined to the few thresholds it passes."""
    t = records.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold double")
    return results(trades(records.crossJoin(F.broadcast(t)), F.col("threshold"), fee), "threshold")


def by_time(records: DataFrame, share: float, at: str = "ts", tie: str = "seq") -> DataFrame:
    """`train` for the first share of rows by time."""
    return ranks.row_index(records, at, tie).withColumn("train", F.col("i") < F.floor(F.col("n") * share)).drop("i", "n")


def chosen(records: DataFrame, thresholds: list[float], share: float = 0.7, fee: float = 0.01) -> DataFrame:
    """The threshold with the best (Sharpe, mean, number) on the earlier share, and its results on the later rows."""
    d = by_time(records, share)
    found = sweep(d.where("train"), thresholds, fee)
    best = found.agg(F.max(F.struct("sharpe", "mean_return", "n_trades", (-F.col("threshold")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"))
    test = d.where(~F.col("train")).crossJoin(F.broadcast(best))
    return results(trades(test, F.col("threshold"), fee), "threshold")


def directional(df: DataFrame, band: float, fee: float, score: str = "prob", value: str = "fwd") -> DataFrame:
    side = F.when(F.col(score) > 0.5 + band, 1).when(F.col(score) < 0.5 - band, -1)
    return df.withColumn("side", side).where("side is not null").withColumn("ret", F.col("side") * F.col(value) - fee)


def long_short(df: DataFrame, q: float, fee: float, score: str = "prob", value: str = "fwd", tie: str = "seq") -> DataFrame:
    d = ranks.row_index(df, score, tie)
    k = F.floor(F.col("n") * q)
    side = F.when(F.col("i") >= F.col("n") - k, 1).when(F.col("i") < k, -1)
    return d.withColumn("side", side).where("side is not null").withColumn("ret", F.col("side") * F.col(value) - fee)


def strategy_stats(rets: DataFrame, *keys: str) -> DataFrame:
    sd, n = F.stddev_pop("ret"), F.count("*")
    return rets.groupBy(*keys).agg(F.sum("ret").alias("pnl"), F.avg("ret").alias("mean_ret"), F.when(sd > 0, F.avg("ret") / sd * F.sqrt(n.cast("double"))).otherwise(0.0).alias("sharpe"), F.avg((F.col("ret") > 0).cast("double")).alias("hit"), n.alias("n"))
