"""A ranked scan at each trigger: the batch is folded into stored market state, and the scan reads that state alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bars, signals
from . import state

HOUR, DAY = 3600, 86400
#: Detectors that need neither a book nor a history.
KINDS = ("SURGE", "WHALE", "TAIL", "EXPIRY")
NO_BOOK = "token long, bid_notional double, ask_notional double, spread double, mid double, micro_lean double, imbalance double, liquidity_score double"
NO_HISTORY = "market_id long, n long, realised_vol double, drift_per_day double, autocorr double, band_z double, vol_compression double"


class LiveScan:
    """Hourly bars and large prints of each market, kept as tables by batch number under `path`.

    Batch k reads the state of batch k - 1 and writes that of k, with overwrite: a batch that runs again after a failure
    gives the same tables, so every row counts once. Turnover of a day or a week is that of the whole hours in it; hours
    older than a week are folded to one row a market.
    """

    def __init__(self, path: str, whale: float = signals.WHALE_USD, top: int = 30):
        self.path, self.whale, self.top = path, whale, top

    def _stored(self, spark: SparkSession, name: str, batch: int, like: DataFrame) -> DataFrame:
        # batches are numbered without gaps; the first finds nothing
        return like.limit(0) if batch == 0 else spark.read.schema(like.schema).parquet(f"{self.path}/{name}/batch={batch - 1}")

    def fold(self, tape: DataFrame, batch: int) -> None:
        """State and scan of one batch."""
        spark = tape.sparkSession
        hours = bars.partial_bars(tape, HOUR).withColumn("old_volume", F.lit(0.0)).withColumn("created", F.col("first_at.t"))
        merged = self._merged(self._stored(spark, "hours", batch, hours).unionByName(hours))
        merged.write.mode("overwrite").parquet(f"{self.path}/hours/batch={batch}")
        flow = signals.block_flow(tape, self.whale)
        sums = [F.sum(c).alias(c) for c in ("net", "count", "gross")]
        self._stored(spark, "flow", batch, flow).unionByName(flow).groupBy("market_id").agg(*sums).write.mode("overwrite").parquet(f"{self.path}/flow/batch={batch}")
        self.scan(spark, batch).write.mode("overwrite").parquet(f"{self.path}/scan/batch={batch}")

    def _merged(self, hours: DataFrame) -> DataFrame:
        """One row an hour and market; of the hours before the last week, the newest stays, with the volume of the others."""
        at = [F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min_by("open", "first_at").alias("open"), F.max_by("close", "last_at").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.min("created").alias("created")]
        sums = [F.sum(c).alias(c) for c in ("volume", "trades", "signed_vol", "buy_vol", "sell_vol", "whale_vol", "old_volume")]
        one = hours.groupBy("market_id", "bar_ts").agg(*at, *sums)
        now = hours.agg((F.max("bar_ts") - 7 * DAY - DAY).alias("_edge"))
        old = one.crossJoin(F.broadcast(now)).withColumn("_old", F.col("bar_ts") < F.col("_edge"))
        w = W.partitionBy("market_id", "_old")
        old = old.withColumn("_last", F.max("bar_ts").over(w)).withColumn("_sum", F.sum(F.col("volume") + F.col("old_volume")).over(w)).withColumn("_first", F.min("created").over(w))
        kept = old.where(~F.col("_old") | (F.col("bar_ts") == F.col("_last")))
        kept = kept.withColumns({"old_volume": F.when(F.col("_old"), F.col("_sum") - F.col("volume")).otherwise(F.col("old_volume")), "created": F.when(F.col("_old"), F.col("_first")).otherwise(F.col("created"))})
        return kept.select(*hours.columns)

    def board(self, spark: SparkSession, batch: int) -> tuple[DataFrame, float]:
        """Markets as of a batch, and the time of its newest row."""
        hours = spark.read.parquet(f"{self.path}/hours/batch={batch}")
        now = float(hours.agg(F.max("last_at.t")).first()[0] or 0.0)
        edge = now // HOUR * HOUR
        since = lambda days: F.sum(F.when(F.col("bar_ts") > edge - days * DAY, F.col("volume")).otherwise(0.0))
        before = F.when(F.col("bar_ts") <= edge - DAY, F.struct("bar_ts"))
        m = hours.groupBy("market_id").agg(F.max_by("close", "last_at").alias("last"), F.max_by(F.when(F.col("bar_ts") <= edge - DAY, F.col("close")), before).alias("before"), since(1).alias("volume24h"), since(7).alias("volume1w"), F.max("last_at.t").alias("newest"))
        return m.select("market_id", "last", "volume24h", "volume1w", (100 * (F.col("last") - F.coalesce("before", "last"))).alias("chg24h"), (F.col("newest") + DAY).alias("end"), F.lit(True).alias("accepting")), now

    def scan(self, spark: SparkSession, batch: int) -> DataFrame:
        """The best markets of a batch by heat (ties by id), each row with the counters of the whole scan."""
        board, now = self.board(spark, batch)
        flow = spark.read.parquet(f"{self.path}/flow/batch={batch}")
        books, history = spark.createDataFrame([], NO_BOOK), spark.createDataFrame([], NO_HISTORY)
        s = signals.score(signals.detect(signals.enrich(signals.tradeable(board), board, flow, books, history, now), KINDS))
        counters = s.agg(F.count("*").alias("flagged"), F.count_if(F.col("bias") > 10).alias("bullish"), F.count_if(F.col("bias") < -10).alias("bearish"))
        best = s.orderBy(F.desc("heat"), "market_id").limit(self.top)
        rank = F.row_number().over(W.orderBy(F.desc("heat"), "market_id")).cast("long")  # of at most `top` rows
        return best.select("market_id", "heat", "bias", "conviction", rank.alias("rank")).crossJoin(F.broadcast(counters))


def run(tape: DataFrame, path: str, whale: float = signals.WHALE_USD, top: int = 30) -> LiveScan:
    """Scans a stream of trades to its end; the scans lie in `path`/scan by batch."""
    live = LiveScan(path, whale, top)
    state.run(tape, path, live.fold, "append")
    return live
