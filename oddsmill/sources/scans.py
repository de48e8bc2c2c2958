"""Readers with explicit schemas, and the shapes in which scans are asked for. Filters and columns reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRADES = "timestamp long, market_id long, condition_id string, price double, usd_amount double, taker_direction string, nonusdc_side string, asset_id long"
USERS = "timestamp long, market_id string, condition_id string, event_id string, user string, role string, price double, usd_amount double, token_amount double"
MARKETS = "id long, question string, condition_id string, token1 long, token2 long, closed int, outcome_prices string, volume double, end_date string"

#: Minutes of a bucket for each interval of history.
BUCKET_MINUTES = {"1h": 1, "6h": 5, "1d": 10, "1w": 60, "1m": 240, "max": 720}
INTERVAL_SECONDS = {"1h": 3600, "6h": 21600, "1d": 86400, "1w": 604800, "1m": 2592000, "max": None}


def trades(spark: SparkSession, *paths: str, cap: int | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """The trade tape, only the columns asked for; `cap` is a sample for a look, not for results."""
    df = spark.read.schema(TRADES).parquet(*paths)
    df = df.select(*columns) if columns else df
    return df if cap is None else df.limit(cap)


def users(spark: SparkSession, *paths: str) -> DataFrame:
    """The user tape in time order within files; rows whose numbers can't be read are dropped."""
    df = spark.read.parquet(*paths)
    good = [F.col(c).try_cast("double").alias(c) for c in ("price", "usd_amount", "token_amount")]
    return df.select(F.col("timestamp").try_cast("long").alias("timestamp"), "market_id", "user", "role", *good).dropna()


def monthly(spark: SparkSession, root: str, months: list[str], most: int | None = None, schema: str = TRADES) -> DataFrame:
    """The first `most` monthly folders, in order of their names."""
    return spark.read.schema(schema).parquet(*[f"{root}/{m}" for m in sorted(months)[:most]])


def markets(df: DataFrame, limit: int = 100, offset: int = 0, order: str = "volume24h", ascending: bool = False, ids: list | None = None) -> DataFrame:
    """A page of open markets, or the named ones whatever their state."""
    df = df.where(F.col("market_id").isin(ids)) if ids is not None else df.where("accepting")
    return df.orderBy(F.asc(order) if ascending else F.desc(order), "market_id").offset(offset).limit(limit)


def prints(tape: DataFrame, least: float = 0.0, market: int | None = None, wallet: str | None = None, limit: int = 500) -> DataFrame:
    for name, value in (("market_id", market), ("wallet", wallet)):
        tape = tape if value is None else tape.where(F.col(name) == value)
    return tape.where(F.col("usd") >= least).orderBy(F.desc("t"), F.desc("seq")).limit(limit)


def books(levels: DataFrame, tokens: DataFrame) -> DataFrame:
    return levels.join(tokens, "token", "left_semi")


def history(series: DataFrame, interval: str, now: float, key: str = "market_id") -> DataFrame:
    """The last price of each bucket of the interval that ends now."""
    span, step = INTERVAL_SECONDS[interval], BUCKET_MINUTES[interval] * 60
    recent = series if span is None else series.where((F.col("t") > now - span) & (F.col("t") <= now))
    return recent.groupBy(key, (F.floor(F.col("t") / step) * step).cast("long").alias("bucket")).agg(F.max_by("price", F.struct("t", "seq")).alias("price"))


def positions(df: DataFrame, wallet: str, least: float = 1.0) -> DataFrame:
    value = F.abs(F.col("size") * F.col("cur"))
    return df.where((F.col("wallet") == wallet) & (F.abs("size") >= least)).withColumn("value", value).orderBy(F.desc("value"), "market_id")


def is_address(c: str):
    return F.col(c).rlike("^0x[0-9a-fA-F]{40}$")


def universe(markets: DataFrame, series: DataFrame, limit: int, least_points: int = 24) -> DataFrame:
    """The most traded markets that have a history."""
    long = series.groupBy("market_id").agg(F.count("*").alias("n_points")).where(F.col("n_points") >= least_points)
    return markets.join(long, "market_id").orderBy(F.desc("volume"), "market_id").limit(limit).select("market_id", "volume", "n_points")


def candles(df: DataFrame, least: int, key: str = "market_id") -> DataFrame:
    return df.withColumn("n_candles", F.count("*").over(W.partitionBy(key))).where(F.col("n_candles") >= least)
