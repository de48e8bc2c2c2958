"""Wallets by what they earned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def market_final(tape: DataFrame, resolved: DataFrame, order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """The resolution of each market, else its last price in `order`."""
    last = tape.groupBy("market_id").agg(F.max_by("price", F.struct(*order)).alias("last"))
    return last.join(resolved, "market_id", "left").select("market_id", F.coalesce("final", "last").alias("final"))


def wallet_pnl(tape: DataFrame, final: DataFrame) -> DataFrame:
    """Summed before the join: a wallet's position in a market is two numbers."""
    p = tape.groupBy("wallet", "market_id").agg(F.sum("token_amount").alias("tokens"), F.sum(F.col("token_amount") * F.col("price")).alias("paid"), F.sum("usd").alias("volume"))
    return p.join(final, "market_id").select("wallet", "market_id", (F.col("tokens") * F.col("final") - F.col("paid")).alias("pnl"), "volume")


def leaderboard(pnl: DataFrame) -> DataFrame:
    return pnl.groupBy("wallet").agg(F.sum("pnl").alias("pnl"), F.sum("volume").alias("volume"), F.count("*").alias("n_markets"))


def settled(board: DataFrame) -> DataFrame:
    """The board as first computed, a row for each wallet, in the checkpoint folder or else on the executors. Ranks read
    their rows more than once, and sums of doubles that are made again can differ in their last digits."""
    return board.checkpoint() if board.sparkSession.sparkContext.getCheckpointDir() else board.localCheckpoint()


def top_share(board: DataFrame, share: float = 0.2) -> DataFrame:
    """The best ceil(share * N) wallets; those whose pnl is not known come last."""
    d = ranks.row_index(settled(board).withColumn("_v", F.coalesce(-F.col("pnl"), F.lit(float("inf")))), "_v", "wallet")
    return d.where(F.col("i") < F.ceil(F.col("n") * share)).drop("_v", "i", "n")


def smart_and_dumb(board: DataFrame, share: float = 0.2, least_volume: float = 200.0, least: int = 5) -> DataFrame:
    """The best and the worst k wallets with volume, k never over half; none below `least` wallets."""
    d = ranks.row_index(settled(board.where(F.col("volume") >= least_volume)), "pnl", "wallet")
    k = F.least(F.floor(F.col("n") * share), F.floor((F.col("n") - 1) / 2))
    d = d.withColumn("cohort", F.when(F.col("i") >= F.col("n") - k, "smart").when(F.col("i") < k, "dumb"))
    return d.where(F.col("cohort").isNotNull() & (F.col("n") >= least)).select("wallet", "cohort")


def time_cutoff(tape: DataFrame, share: float = 0.5) -> DataFrame:
    d = ranks.row_index(tape.select("t", "seq"), "t", "seq")
    return d.where(F.col("i") == F.floor(F.col("n") * share)).select(F.col("t").alias("cutoff"))
