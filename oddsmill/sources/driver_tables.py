"""The domain's tables as views of the driver's: tape, markets, quotes, books, fills, bars, predictions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bars, windows


#: Seconds since 1970, whether the column has a time zone or not.
SECONDS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6D"


class Domain:
    """Views are built when first asked for, each from pruned columns of one table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tape(self) -> DataFrame:
        e = self.table("events").select("event_id", "user_id", "event_type", "value", "ts", F.get_json_object("props", "$.k").alias("k"))
        buy = F.col("event_type").isin("purchase", "signup", "click")
        e = e.select(
            F.col("event_id").alias("seq"),
            F.col("user_id").alias("market_id"),
            F.floor(F.col("user_id") / 5).alias("basket_id"),
            F.expr(SECONDS).alias("t"),
            (F.col("value") / (F.col("value") + 50)).alias("price"),
            (F.col("value") * 100).alias("usd"),
            F.when(buy, "BUY").otherwise("SELL").alias("side"),
            F.when(F.col("event_type").isin("signup", "error"), 1).otherwise(0).alias("outcome_index"),
            F.concat(F.lit("w"), "k").alias("wallet"),
            F.when(F.col("event_id") % 5 < 2, "maker").otherwise("taker").alias("role"),
        )
        return e.withColumn("token_amount", F.try_divide(F.when(F.col("side") == "BUY", 1).otherwise(-1) * F.col("usd"), "price"))

    @cached_property
    def now(self) -> float:
        """The last time on the tape; scans never read a clock."""
        return float(self.table("events").agg(F.max("ts").alias("ts")).select(F.expr(SECONDS)).first()[0] or 0.0)

    @cached_property
    def market(self) -> DataFrame:
        now, usd = self.now, F.col("usd")
        since = lambda days: F.sum(F.when(F.col("t") > now - 86400.0 * days, usd).otherwise(0.0))
        old = F.col("t") <= now - 86400.0
        m = self.tape.groupBy("market_id", "basket_id").agg(
            F.max_by("price", "seq").alias("last"),
            F.max_by(F.when(old, F.col("price")), F.when(old, F.col("seq"))).alias("before"),
            since(1).alias("volume24h"),
            since(7).alias("volume1w"),
            F.sum("usd").alias("volume"),
            F.min("t").alias("created"),
            F.max("t").alias("newest"),
        )
        return m.select(
            "market_id", "basket_id", "last", "volume24h", "volume1w", "volume", "created",
            (100 * (F.col("last") - F.coalesce("before", "last"))).alias("chg24h"),
            (F.col("newest") + 86400).alias("end"),
            F.when(F.col("last") > 0.5, "['1', '0']").otherwise("['0', '1']").alias("outcome_prices"),
            F.lit(True).alias("accepting"),
            (F.col("basket_id") % 4 != 3).alias("neg_risk"),
        )

    @cached_property
    def quote(self) -> DataFrame:
        m = self.market.withColumn("q", F.try_divide("last", F.sum("last").over(W.partitionBy("basket_id"))))
        k, h = 1 + (F.col("basket_id") % 7 - 3) * 0.01, 0.001 * (1 + F.col("market_id") % 4)
        return m.withColumns({"best_bid": F.col("q") * k - h, "best_ask": F.col("q") * k + h, "liquidity": F.col("volume")}).drop("q")

    @cached_property
    def book(self) -> DataFrame:
        """(token, side, price, size), one row a level."""
        mid, bid = 0.2 + 0.1 * (F.col("l_suppkey") % 7), F.col("l_linestatus") == "O"
        li = self.table("lineitem").select(
            F.col("l_suppkey").alias("token"),
            F.when(bid, "bid").otherwise("ask").alias("side"),
            F.round(F.when(bid, mid - 0.005 - F.col("l_discount") * 0.5).otherwise(mid + 0.005 + F.col("l_tax") * 0.5), 4).alias("price"),
            "l_quantity",
        )
        return li.groupBy("token", "side", "price").agg(F.sum("l_quantity").alias("size"))

    @cached_property
    def bars(self) -> DataFrame:
        return bars.ohlcv_flow(self.tape, 21600)

    @cached_property
    def hot(self) -> list:
        """Markets whose rows are cut in stretches: one count of one column of the tape."""
        return windows.hot_keys(self.table("events").select(F.col("user_id").alias("market_id")))

    def windowed(self, f, *args, **kw) -> DataFrame:
        """A function of 16-bar windows over the bars, hot markets in stretches."""
        return windows.over_stretches(lambda b, key: f(b, *args, key=key, **kw), self.bars, self.hot)

    @cached_property
    def preds(self) -> DataFrame:
        w = W.partitionBy("market_id").orderBy("t", "seq").rowsBetween(-15, 0)
        signed = F.sum(F.when(F.col("side") == "BUY", F.col("usd")).otherwise(-F.col("usd"))).over(w)
        return self.tape.select(
            "seq", "market_id", "t", "price",
            F.avg("price").over(w).alias("resolve"),
            (0.5 + F.try_divide(0.4 * signed, F.sum("usd").over(w))).alias("flow"),
            F.when(F.col("seq") % 10 != 0, (F.col("seq") * 7919 % 1000) / 1000).alias("smart"),
        )

    @cached_property
    def preds_long(self) -> DataFrame:
        p = self.preds.select("seq", "market_id", "t", "price", F.expr("stack(3, 'resolve', resolve, 'flow', flow, 'smart', smart) as (model, prob)"))
        return p.where("prob is not null")

    @cached_property
    def records(self) -> DataFrame:
        later = F.lead("price", 4).over(W.partitionBy("market_id").orderBy("t", "seq"))
        p = self.preds.withColumn("later", later).where("later is not null")
        return p.select("seq", "market_id", F.col("t").alias("ts"), F.col("resolve").alias("prob"), F.col("price").alias("market_price"), F.when(F.col("later") > F.col("price"), 1.0).otherwise(0.0).alias("outcome"), (F.col("later") - F.col("price")).alias("fwd"), "smart", "flow")

    @cached_property
    def positions(self) -> DataFrame:
        last = self.market.select("market_id", F.col("last").alias("cur"))
        p = self.tape.groupBy("wallet", "market_id").agg(F.sum("token_amount").alias("size"), F.try_divide(F.sum("usd"), F.sum(F.abs("token_amount"))).alias("avg"))
        return p.join(last, "market_id")

    @cached_property
    def alerts(self) -> DataFrame:
        return self.tape.groupBy("market_id").agg(F.avg("price").alias("target")).withColumn("op", F.when(F.col("market_id") % 2 == 0, "gte").otherwise("lte"))
