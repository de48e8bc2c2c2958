"""Detectors over single markets and baskets, and the scores they roll up to.

A detector is a projection of one wide row (market, flow, book, history, cross-section): the wide row is joined once
and every detector reads it, so nothing is computed twice. Missing sides are null and silence their detectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clamp, half_up, saturate
from . import stats

LEAST_VOLUME, WHALE_USD, SETTLED = 5000.0, 10000.0, 0.015
#: The weight of each kind of signal.
WEIGHTS = {
    "ARB": 1.0, "DRIFT": 0.8, "SURGE": 0.9, "WHALE": 0.85, "MOMENTUM": 0.75, "BREAKOUT": 0.75, "REVERSAL": 0.7,
    "IMBALANCE": 0.6, "LEAN": 0.55, "COIL": 0.5, "EXPIRY": 0.5, "TAIL": 0.4, "THIN": 0.2,
}


def weight(kind: str = "kind") -> Column:
    return F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col(kind)]


def block_flow(tape: DataFrame, least: float = WHALE_USD, key: str = "market_id") -> DataFrame:
    """Large prints by market: net towards YES, number, gross. Buying YES and selling NO are one direction."""
    up = (F.col("outcome_index") == 0) == (F.col("side") == "BUY")
    return tape.where(F.col("usd") >= least).groupBy(key).agg(F.sum(F.when(up, F.col("usd")).otherwise(-F.col("usd"))).alias("net"), F.count("*").alias("count"), F.sum("usd").alias("gross"))


def tradeable(markets: DataFrame, least: float = LEAST_VOLUME) -> DataFrame:
    return markets.where((F.col("volume24h") >= least) & F.col("accepting") & (F.col("last") > SETTLED) & (F.col("last") < 1 - SETTLED))


def enrich(markets: DataFrame, board: DataFrame, flow: DataFrame, books: DataFrame, history: DataFrame, now: float) -> DataFrame:
    """Markets with what is known of them, and the cross-section of the whole board as one broadcast row."""
    cross = stats.cross_section(board)
    h = history.withColumnRenamed("n", "n_points")
    b = books.select(F.col("token").alias("market_id"), *[F.col(c).alias(f"b_{c}") for c in books.columns if c != "token"])
    m = markets.join(flow, "market_id", "left").join(b, "market_id", "left").join(h, "market_id", "left")
    m = m.crossJoin(F.broadcast(stats.populations(cross, {"vr_": "volume_ratio", "am_": "abs_move"})))
    base = F.greatest(F.col("volume1w") / 7, F.lit(1.0))
    return m.withColumns({
        "ratio": F.when(F.col("volume1w") / 7 >= 1000, F.col("volume24h") / (F.col("volume1w") / 7)),
        "volume_z": stats.robust_z(F.log(F.greatest(F.col("volume24h") / base, F.lit(1e-6))), "vr_"),
        "move_z": stats.robust_z(F.abs("chg24h"), "am_"),
        "hours": (F.col("end") - now) / 3600,
    })


def _detectors() -> dict[str, tuple[Column, Column, Column, Column, Column]]:
    """kind: fires when, direction, strength before rounding, confidence, z."""
    c, sign = F.col, lambda x: F.when(x > 0, "bullish").otherwise("bearish")
    vol, drift, ac, bz, comp, n = c("realised_vol"), c("drift_per_day"), c("autocorr"), c("band_z"), c("vol_compression"), c("n_points")
    quality = F.when(vol >= 1e-6, drift / vol)
    surge_z = stats.robust_z(F.log("ratio"), "vr_")
    one_sided = F.when(c("gross") > 0, F.abs("net") / c("gross")).otherwise(0.0)
    resting = c("b_bid_notional") + c("b_ask_notional")
    lean = F.when(c("b_spread") > 0, c("b_micro_lean") / (c("b_spread") * 100))
    wide = c("b_spread") / c("b_mid")
    severity = F.greatest(saturate(F.greatest(F.lit(0.0), wide - 0.05), 0.2), clamp((0.2 - c("b_liquidity_score")) / 0.2, 0, 1))
    none, neutral = F.lit(None).cast("double"), F.lit("neutral")
    return {
        "SURGE": ((c("ratio") >= 1.5) & (half_up(100 * saturate(surge_z, 2.5)) >= 12), F.when(c("chg24h") > 1, "bullish").when(c("chg24h") < -1, "bearish").otherwise("neutral"), saturate(surge_z, 2.5), clamp(saturate("volume24h", 50000), 0.3, 1), surge_z),
        "MOMENTUM": ((n >= 12) & (F.abs(quality) >= 0.35), sign(drift), saturate(F.abs(quality), 0.9) * clamp(0.5 + ac, 0.2, 1), clamp(saturate(n, 60), 0.3, 1), quality),
        "REVERSAL": ((n >= 20) & (F.abs(bz) >= 1.6) & (ac <= 0.05), sign(-bz), saturate(F.abs(bz) - 1.4, 1.4), clamp(saturate(0.15 - ac, 0.25), 0.25, 0.9), bz),
        "BREAKOUT": ((n >= 24) & (F.abs(bz) >= 1.8) & (ac > 0.05) & (comp >= 1.2), sign(bz), saturate(F.abs(bz) - 1.5, 1.2) * clamp(comp / 2, 0.4, 1), clamp(saturate(ac, 0.2), 0.3, 0.95), bz),
        "COIL": ((n >= 30) & (comp <= 0.55) & (F.abs(bz) <= 1.5), neutral, saturate(0.55 - comp, 0.3), F.lit(0.55), comp),
        "WHALE": (F.abs("net") >= WHALE_USD, sign(c("net")), saturate(F.abs("net") / F.greatest(c("volume24h"), F.lit(1.0)), 0.08) * 0.6 + one_sided * 0.4, clamp(saturate("count", 3) * one_sided + 0.2, 0.2, 1), none),
        "IMBALANCE": ((resting >= 5000) & (F.abs("b_imbalance") >= 0.35), sign(c("b_imbalance")), saturate(F.abs("b_imbalance") - 0.3, 0.35), clamp(saturate(resting, 40000), 0.25, 1), c("b_imbalance")),
        "LEAN": (F.abs(lean) >= 0.18, sign(c("b_micro_lean")), saturate(F.abs(lean) - 0.15, 0.3), clamp(saturate(resting, 25000), 0.2, 0.85), lean),
        "TAIL": (((c("last") <= 0.06) | (c("last") >= 0.94)) & (c("last") > SETTLED) & (c("last") < 1 - SETTLED) & (c("volume24h") >= 25000), neutral, saturate(c("volume24h") / 25000, 3), F.lit(0.5), none),
        "EXPIRY": ((c("hours") > 0) & (c("hours") <= 72) & (c("last") >= 0.12) & (c("last") <= 0.88), neutral, saturate(72 - c("hours"), 36), F.lit(0.8), none),
        "THIN": ((c("b_mid") > 0) & (c("b_spread") >= 0.01) & (severity >= 0.15), neutral, severity, F.lit(0.7), wide),
    }


KINDS = ("SURGE", "MOMENTUM", "REVERSAL", "BREAKOUT", "COIL", "WHALE", "IMBALANCE", "LEAN", "TAIL", "EXPIRY", "THIN")


def detect(wide: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(market_id, kind, direction, strength, confidence, z), one row for each detector that fires."""
    found = _detectors()
    rows = F.array(*[F.when(found[k][0], F.struct(F.lit(k).alias("kind"), found[k][1].alias("direction"), half_up(100 * found[k][2]).cast("double").alias("strength"), found[k][3].cast("double").alias("confidence"), found[k][4].cast("double").alias("z"))) for k in kinds])
    return wide.select("market_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("s")).select("market_id", "s.*")


def score(signals: DataFrame) -> DataFrame:
    """Heat, bias and conviction of each market with a signal."""
    w = F.col("strength") * weight() * F.col("confidence")
    side = F.when(F.col("direction") == "bullish", 1).when(F.col("direction") == "bearish", -1).otherwise(0)
    g = signals.groupBy("market_id").agg(F.sum(w).alias("heat"), F.sum(w * side).alias("signed"), F.sum(F.when(side != 0, w).otherwise(0.0)).alias("directed"), F.count("*").alias("n_signals"))
    return g.select(
        "market_id", "n_signals",
        clamp(half_up(100 * saturate("heat", 90)), 0, 100).alias("heat"),
        clamp(half_up(F.col("signed") / 1.5), -100, 100).alias("bias"),
        F.when(F.col("directed") > 0, half_up(100 * F.abs(F.col("signed") / F.col("directed")))).otherwise(F.lit(0)).cast("double").alias("conviction"),
    )


def order_signals(signals: DataFrame) -> DataFrame:
    """Each market's signals by strength, weight and confidence together, the strongest first (ties by kind)."""
    w = W.partitionBy("market_id").orderBy(F.desc(F.col("strength") * weight() * F.col("confidence")), "kind")
    return signals.withColumn("rank", F.row_number().over(w))


def agreement(prob: str = "prob", conviction: str = "model_conviction", bias: str = "bias") -> Column:
    p, b = F.col(prob), F.col(bias)
    silent = p.isNull() | (F.col(conviction) < 0.08) | (F.abs(b) < 8)
    return F.when(silent, "neutral").when((p - 0.5) * b > 0, "confirms").otherwise("conflicts")


def blended(auc: float, prob: str = "prob", conviction: str = "model_conviction") -> Column:
    """Heat moved up or down by a model that agrees or not, as far as it is trusted and commits."""
    trust = max(0.0, min(1.0, (auc - 0.5) / 0.2))
    agree = clamp((F.col(prob) - 0.5) * 2 * F.col("bias") / 100, -1, 1)
    return F.when(F.col(prob).isNull(), F.col("heat")).otherwise(clamp(F.col("heat") * (1 + trust * F.col(conviction) * agree * 0.3), 0, 100))


def _baskets(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("basket_id").agg(
        F.count("*").alias("legs"), F.bool_and(F.col("neg_risk") & F.col("accepting") & F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull()).alias("ok"),
        F.sum("best_bid").alias("sum_bid"), F.sum("best_ask").alias("sum_ask"), F.max("best_ask").alias("top_ask"), F.max(F.col("best_ask") - F.col("best_bid")).alias("widest"),
        F.min("liquidity").alias("tightest_leg_liquidity"),
    ).where("ok and legs >= 2")


def arbitrage(quotes: DataFrame) -> DataFrame:
    """Baskets whose legs can be sold for more or bought for less than they pay."""
    b = _baskets(quotes).where("tightest_leg_liquidity > 0")
    sell = F.col("sum_bid") > 1.005
    b = b.where(sell | ((F.col("top_ask") < 0.99) & (F.col("sum_ask") < 0.995)))
    return b.select("basket_id", F.when(sell, "sell-basket").otherwise("buy-basket").alias("side"), F.when(sell, F.col("sum_bid")).otherwise(F.col("sum_ask")).alias("basket"), (100 * F.when(sell, F.col("sum_bid") - 1).otherwise(1 - F.col("sum_ask"))).alias("edge_points"), "legs", "tightest_leg_liquidity")


def basket_drift(quotes: DataFrame, top: int | None = 12) -> DataFrame:
    """Baskets whose mids have left 1 by more than their own spreads explain; the `top` by that ratio, to nine digits, since
    ratios of sums that are equal differ beyond those. Equal ones go by their number."""
    b = _baskets(quotes).where("top_ask < 0.99 and widest <= 0.1")
    b = b.select("basket_id", ((F.col("sum_bid") + F.col("sum_ask")) / 2).alias("basket"), ((F.col("sum_ask") - F.col("sum_bid")) * 50).alias("noise_points"), "legs")
    b = b.withColumn("drift_points", (F.col("basket") - 1) * 100)
    b = b.withColumn("ratio", F.when(F.col("noise_points") > 1e-6, F.abs("drift_points") / F.col("noise_points")).otherwise(0.0)).where("abs(drift_points) <= 25 and ratio >= 1")
    return b if top is None else b.orderBy(F.desc(F.round("ratio", 9)), "basket_id").limit(top)


def deep_scan(markets: DataFrame, top: int = 48) -> DataFrame:
    """The markets worth their books and histories: the largest by turnover, chosen before anything is joined."""
    return markets.orderBy(F.desc("volume24h"), "market_id").limit(top)
