"""Exact global ranks without one task that holds all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges at most, so that the counts of all ranges and their bounds stay small.
MAX_PARTS = 1 << 14


def _parts(df: DataFrame) -> int:
    """Ranges to cut to: as many as the shuffle has partitions, which a user sets by the size of the data."""
    return max(64, min(MAX_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _doubles(values) -> str:
    return f"array({', '.join(f"double('{float(v)!r}')" for v in values)})" if values else "cast(array() as array<double>)"


def _range(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Rows with `_b`, how many of the rising bounds lie under the value, by way of groups of about a root of them."""
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)] + [[]]
    under = lambda xs: F.size(F.filter(xs, lambda x: x < F.col(value)))
    df = df.withColumn("_whole", under(F.expr(_doubles([g[-1] for g in groups[:-1]]))))
    group = F.element_at(F.expr(f"array({', '.join(_doubles(g) for g in groups)})"), F.col("_whole") + 1)
    # groups that lie under the value as a whole are full ones, but for the last
    return df.withColumn("_b", F.least(F.col("_whole") * step + under(group), F.lit(len(bounds)))).drop("_whole")


def _cut(df: DataFrame, value: str, parts: int | None) -> DataFrame:
    """Rows with `_b`, their range of values, and `_before`, the rows of all lower ranges.

    The ranges come from approximate quantiles, so they hold about equal numbers; any bounds would give right ranks.
    Equal values share a range.
    """
    parts = parts or _parts(df)
    shares = F.expr(_doubles([k / parts for k in range(1, parts)] or [0.5]))
    bounds = df.agg(F.percentile_approx(value, shares, max(10_000, 8 * parts)).alias("b")).first()["b"] or []
    df = _range(df, value, sorted({float(b) for b in bounds}, key=lambda b: (b != b, b)))
    counts = df.groupBy("_b").agg(F.count("*").alias("_n"))  # at most `parts` rows
    before = F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.join(F.broadcast(counts.select("_b", before.alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_total"))), "_b")


def row_index(df: DataFrame, value: str, tie: str, parts: int | None = None) -> DataFrame:
    """`i`, the place of each row by (value, tie) from 0, and `n`, the number of rows."""
    d = _cut(df, value, parts)
    return d.withColumns({"i": F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy(value, tie)) - 1, "n": F.col("_total")}).drop("_b", "_before", "_total")


def average_rank(df: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """`rank` from 1, the mean of the places of equal values."""
    d = _cut(df, value, parts)
    ties = F.count("*").over(W.partitionBy("_b", value))
    return d.withColumn("rank", F.col("_before") + F.rank().over(W.partitionBy("_b").orderBy(value)) + (ties - 1) / 2).drop("_b", "_before", "_total")


def share_at_or_below(df: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """`share`, the part of all rows whose value is at most the row's own."""
    d = _cut(df, value, parts)
    ties = F.count("*").over(W.partitionBy("_b", value))
    below = F.col("_before") + F.rank().over(W.partitionBy("_b").orderBy(value)) - 1
    return d.withColumn("share", (below + ties) / F.col("_total")).drop("_b", "_before", "_total")


#: Bins of the histogram that narrows the search for a rank.
BINS = 1 << 16


def quantiles(df: DataFrame, value: str, shares: dict[str, float], group: str | None = None, bins: int = BINS) -> DataFrame:
    """Exact quantiles (linear between neighbours) of each group, one column for each share; nulls don't count.

    A distributed selection: distinct values are counted, a histogram of equal widths (a constant number of rows) tells
    which bin holds each wanted rank, and only that bin's values are put in order. No task holds a whole group. There
    are few groups; a group without values has no row, and a table without groups has one at least.
    """
    g = group or "_all"
    d = df.select(*([F.col(group)] if group else [F.lit(0).alias(g)]), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    counts = d.groupBy(g, "_v").agg(F.count("*").alias("_n"))
    place = lambda x: F.lit(float(x)) * (F.col("_total") - 1)
    whole = counts.groupBy(g).agg(F.sum("_n").alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), end(place(x)).cast("long").alias("k")) for name, x in shares.items() for end in (F.floor, F.ceil)])
    # a row for each group and rank: two for each share at most
    aims = whole.select(g, "_lo", "_hi", F.explode(F.array_distinct(wanted)).alias("_w")).select(F.col(g).alias("_g"), "_lo", "_hi", "_w.name", "_w.k")
    bin_ = F.when(F.col("_hi") > F.col("_lo"), F.width_bucket("_v", "_lo", "_hi", F.lit(bins))).otherwise(0)
    held = counts.join(F.broadcast(aims), F.col(g) == F.col("_g")).groupBy("_g", "name", "k", bin_.alias("_bin")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w = W.partitionBy("_g", "name", "k")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    narrow = held.withColumn("_before", before).where((F.col("_before") <= F.col("k")) & (F.col("k") < F.col("_before") + F.col("_n"))).drop("_n", "_bin")
    some = counts.join(F.broadcast(narrow), (F.col(g) == F.col("_g")) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    upto = F.col("_before") + F.sum("_n").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    found = some.withColumn("_upto", upto).where(F.col("_upto") > F.col("k")).groupBy("_g", "name", "k").agg(F.min("_v").alias("v"))
    found = found.join(F.broadcast(whole.select(F.col(g).alias("_g2"), "_total")), F.col("_g") == F.col("_g2"))
    out = []
    for name, x in shares.items():
        low, high = (F.max(F.when((F.col("name") == name) & (F.col("k") == end(place(x))), F.col("v"))) for end in (F.floor, F.ceil))
        part = F.max(place(x) - F.floor(place(x)))
        out.append((low + part * (high - low)).alias(name))
    return found.groupBy(F.col("_g").alias(g)).agg(*out) if group else found.agg(*out)
