"""Splits that keep the future out of training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HORIZON = 4


def out_of_time(rows: DataFrame, key: str = "market_id", at: str = "bar_ts", share: float = 0.2, purge: int = HORIZON) -> DataFrame:
    """`part`: the first rows of each series train, the last validate, and the rows whose labels reach over are null.
    Series under five rows all train."""
    w = W.partitionBy(key)
    d = rows.withColumns({"_i": F.row_number().over(w.orderBy(at)) - 1, "_n": F.count("*").over(w)})
    cut = F.floor(F.col("_n") * (1 - share))
    part = F.when(F.col("_n") < 5, "train").when(F.col("_i") < cut - purge, "train").when(F.col("_i") >= cut, "val")
    return d.withColumn("part", part).drop("_i", "_n")


def walk_forward(rows: DataFrame, folds: int = 4, key: str = "market_id", at: str = "bar_ts", purge: int = HORIZON) -> DataFrame:
    """(fold, part) rows: fold k trains on its first k blocks and validates on the next."""
    w, blocks = W.partitionBy(key), folds + 1
    d = rows.withColumns({"_i": F.row_number().over(w.orderBy(at)) - 1, "_n": F.count("*").over(w)}).where(F.col("_n") >= blocks)
    d = d.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(1, blocks)])))
    end, stop = F.floor(F.col("_n") / blocks * F.col("fold")), F.floor(F.col("_n") / blocks * (F.col("fold") + 1))
    part = F.when(F.col("_i") < end - purge, "train").when((F.col("_i") >= end) & (F.col("_i") < stop), "val")
    return d.withColumn("part", part).where("part is not null").drop("_i", "_n")


def embargo(rows: DataFrame, train: float = 0.78, val: float = 0.8) -> DataFrame:
    return rows.withColumn("part", F.when(F.col("tfrac") >= val, "val").when(F.col("tfrac") < train, "train"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    p = F.avg(F.col(label).cast("double"))
    return rows.agg((0.5 / p).alias("positive"), (0.5 / (1 - p)).alias("negative"))


def train_stats(rows: DataFrame, features: list[str], floor: float = 1e-9) -> DataFrame:
    """Mean and deviation of each feature over the training rows only."""
    t = rows.where("part = 'train'")
    one = t.agg(*[F.avg(f).alias(f"{f}_m") for f in features], *[F.greatest(F.coalesce(F.stddev_pop(f), F.lit(0.0)), F.lit(floor)).alias(f"{f}_s") for f in features])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_m").alias("mean"), F.col(f"{f}_s").alias("std")) for f in features])).alias("x")).select("x.*")
