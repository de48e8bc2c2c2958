"""Tables that runs leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def series(df: DataFrame, path: str, key: str = "market_id", parts: int = 64) -> None:
    """Series by key, in time order within files; keys share folders by hash, so many keys aren't many folders."""
    d = df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    d.repartition("part").sortWithinPartitions(key, "t").write.partitionBy("part").mode("overwrite").parquet(path)


def scan_snapshot(ranked: DataFrame, stats: DataFrame, at: float, top: int = 30) -> DataFrame:
    """One row a scan: its counters and its `top` markets as an array."""
    best = ranked.orderBy(F.desc("score"), "market_id").limit(top)
    rows = best.agg(F.sort_array(F.collect_list(F.struct(F.round(-F.col("score"), 9).alias("order"), "market_id", "heat", "bias"))).alias("top"))
    return stats.crossJoin(rows).withColumn("at", F.lit(at))


def append(df: DataFrame, path: str, run: int | str) -> None:
    """Adds what one run gives, in a folder of its own: a run that is repeated replaces its rows."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}")


def event_log(rows: DataFrame, path: str, run: int | str) -> None:
    """(at, level, event, context): the event cut to 160 characters, the context as JSON. Repeated runs as in append."""
    append(rows.select("at", "level", F.substring("event", 1, 160).alias("event"), F.to_json("context").alias("context")), path, run)


def leaderboard(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
