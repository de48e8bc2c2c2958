"""Blends of model probabilities, and the decision to trade on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, logistic

MODELS = ("resolve", "flow", "smart")
LEAST_EDGE, LEAST_CONFIDENCE = 0.02, 0.15


def parsed(preds: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Long predictions of known models within 0..1, with a confidence: what is given, else the distance from one half."""
    p = F.col("prob")
    given = F.col("confidence") if "confidence" in preds.columns else F.lit(None).cast("double")
    good = F.when(~F.isnan(given) & (F.abs(given) < float("inf")), given)
    return preds.where(F.col("model").isin(*models) & (p >= 0) & (p <= 1) & ~F.isnan(p)).withColumn("confidence", clamp(F.coalesce(good, 2 * F.abs(p - 0.5)), 0, 1))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def blend(preds: DataFrame, key: str = "seq", weights: dict[str, float] | None = None) -> DataFrame:
    """One row a key: probability from confidence-weighted log odds, agreement, and confidence gated by both and coverage."""
    weights = weights or dict.fromkeys(MODELS, 1.0)
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("model")]
    d = preds.withColumns({"w": F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0)), "l": logit(F.col("prob"))})
    total = lambda x: F.sum(x)
    g = d.groupBy(key).agg(
        total(F.col("w") * F.col("confidence") * F.col("l")).alias("ecl"), total(F.col("w") * F.col("confidence")).alias("ec"), total(F.col("w") * F.col("l")).alias("wl"), total("w").alias("ws"),
        total(F.col("confidence") * F.col("l")).alias("cl"), total("confidence").alias("cs"), total("l").alias("ls"), F.count("*").alias("n_models"), F.stddev_pop("prob").alias("sd"), F.avg("confidence").alias("mean_conf"),
    )
    flat = F.when(F.col("cs") > 1e-9, F.col("cl") / F.col("cs")).otherwise(F.col("ls") / F.col("n_models"))
    z = F.when(F.col("ws") <= 1e-9, flat).when(F.col("ec") > 1e-9, F.col("ecl") / F.col("ec")).otherwise(F.col("wl") / F.col("ws"))
    agreement = F.when(F.col("n_models") <= 1, 1.0).otherwise(clamp(1 - F.col("sd") / 0.5, 0, 1))
    coverage = F.col("n_models") / len(MODELS)
    return g.select(key, logistic(z).alias("prob"), clamp(agreement * F.col("mean_conf") * (0.5 + 0.5 * coverage), 0, 1).alias("confidence"), agreement.alias("agreement"), "n_models")


def decide(signals: DataFrame, price: str = "price") -> DataFrame:
    """BUY_YES, BUY_NO or HOLD with its reason, and the score to rank by. Keys without a model have prob one half."""
    edge = F.col("prob") - F.col(price)
    side = F.when(F.col("n_models") == 0, "HOLD").when(edge > LEAST_EDGE, "BUY_YES").when(edge < -LEAST_EDGE, "BUY_NO").otherwise("HOLD")
    weak = (side != "HOLD") & (F.col("confidence") < LEAST_CONFIDENCE)
    reason = F.when(F.col("n_models") == 0, "no_models").when(side == "HOLD", "low_edge").when(weak, "low_confidence")
    d = signals.withColumns({"edge": edge, "direction": F.when(weak, "HOLD").otherwise(side), "hold_reason": reason})
    return d.withColumn("score", F.when(F.col("direction") == "HOLD", 0.0).otherwise(F.abs("edge") * F.col("confidence")))


def fused(confidence: Column, reliability: Column, share: float = 0.5) -> Column:
    """Geometric mean of confidence and track record; the confidence alone where there is no record."""
    c = clamp(confidence, 0, 1)
    return F.when(reliability.isNull(), c).otherwise(clamp(F.pow(c, 1 - share) * F.pow(clamp(reliability, 0, 1), share), 0, 1))


def reliability(results: DataFrame, scale: float = 1.0) -> DataFrame:
    """Half the hit rate, half the squashed Sharpe; null without trades."""
    r = 0.5 * clamp("hit_rate", 0, 1) + 0.5 * logistic("sharpe", scale)
    return results.withColumn("reliability", F.when(F.col("n_trades") > 0, clamp(r, 0, 1)))
