"""Derivatives of the price window, and small given models that score a window: linear, trees, a network."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fir, logistic
from ..functions.windows import WINDOW, coefficients, ema, polynomial_end
from .windows import _lags, order

#: Moves under this are none: equal prices may differ by rounding once they are smoothed.
STILL, TINY = 1e-12, 1e-12

NAMES = [
    "trend_consistency", "d1_raw", "d1_avg", "d2_raw", "vel_sg5", "vel_sg8", "vel_sg16", "vel_sg2_12", "acc_sg8", "acc_sg12", "jerk_sg12", "vel_z", "vel_z_slow",
    "acc_z", "vel_over_range", "vel_persist", "curv_ratio", "cons_ema", "cons_rec", "cons8", "extremeness", "last", "tc_x_ext", "tc_x_amp", "cons_rec_x_ext",
]

#: (name, derivative, degree, points) of the polynomials through the newest points.
SLOPES = [
    ("vel_sg5", 1, 1, 5), ("vel_sg8", 1, 1, 8), ("vel_sg16", 1, 1, 16), ("vel_sg2_12", 1, 2, 12), ("acc_sg8", 2, 2, 8), ("acc_sg12", 2, 2, 12), ("jerk_sg12", 3, 3, 12),
]

#: Weights by which newer moves count for more.
RECENT = [2.718281828459045 ** (0.15 * k) for k in range(WINDOW - 1)]


def smoothed_slope(xs: list[float]) -> float:
    """Slope of a line through the smoothed window: linear in the window."""
    s = ema(xs, 3)
    return sum(c * x for c, x in zip(polynomial_end(1, 1, len(s)), reversed(s)))


def _direction(v: Column) -> Column:
    return F.when(v > STILL, 1.0).when(v < -STILL, -1.0).otherwise(0.0)


def _agreeing(moves: Column, direction: Column, weights: Sequence[float] | None = None) -> Column:
    """The direction times the share of moves that go its way; a move of nothing goes down."""
    up = direction > 0
    if weights is None:
        share = F.size(F.filter(moves, lambda r: (r > STILL) == up)) / F.size(moves)
    else:
        each = F.zip_with(moves, F.array(*[F.lit(w) for w in weights]), lambda r, w: F.when((r > STILL) == up, w).otherwise(0.0))
        share = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / sum(weights)
    return F.when(direction == 0, 0.0).otherwise(direction * share)


def family25(series: DataFrame, price: str = "close", key: str = "market_id", at: tuple[str, ...] = ("bar_ts",)) -> DataFrame:
    """Twenty-five derivatives of the 16 values before each row: differences, polynomial slopes, shares of moves that
    agree with the trend, and their products. A flat window has zeros but for its level and its room to move."""
    w = order(key, at)
    steps = w.rowsBetween(-(WINDOW - 1), -1)
    s = series.withColumn("_d", F.col(price) - F.lag(price).over(w)).withColumns({
        "i": F.row_number().over(w) - 1, "_w": _lags(price, w), "_r": _lags("_d", w, WINDOW - 1), "_vol": F.stddev_samp("_d").over(steps), "last": F.lag(price, 1).over(w),
        **{name: fir(price, [0.0, *polynomial_end(k, degree, points)], w) for name, k, degree, points in SLOPES},
        "_smooth": fir(price, [0.0, *coefficients(smoothed_slope)], w),
    }).where(F.col("i") >= WINDOW)
    start = F.array(F.get("_w", 0))
    smooth = F.aggregate(F.slice("_w", 2, WINDOW - 1), start, lambda s, x: F.concat(s, F.array((x + F.element_at(s, -1)) / 2)))
    s = s.withColumn("_s", smooth).withColumns({
        "_m": F.transform(F.slice("_s", 2, WINDOW - 1), lambda x, k: x - F.get("_s", k)),
        "_scale": F.when(F.col("_vol") > TINY, F.col("_vol")).otherwise(1.0), "_span": F.array_max("_w") - F.array_min("_w"), "extremeness": F.least(F.col("last"), 1 - F.col("last")),
    })
    slow, fast = _direction(F.col("vel_sg16")), _direction(F.col("vel_sg8"))
    back = lambda k: F.get("_w", WINDOW - k)
    s = s.withColumns({
        "trend_consistency": _agreeing(F.col("_r"), slow), "cons_rec": _agreeing(F.col("_r"), slow, RECENT), "cons_ema": _agreeing(F.col("_m"), _direction(F.col("_smooth"))),
        "cons8": _agreeing(F.slice("_r", -8, 8), fast), "vel_persist": _agreeing(F.slice("_r", -6, 6), fast),
        "d1_raw": back(1) - back(2), "d1_avg": (back(1) - back(WINDOW)) / (WINDOW - 1), "d2_raw": back(1) - 2 * back(2) + back(3),
        "vel_z": F.col("vel_sg8") / F.col("_scale"), "vel_z_slow": F.col("vel_sg16") / F.col("_scale"), "acc_z": F.col("acc_sg8") / F.col("_scale"),
        "vel_over_range": F.col("vel_sg8") / F.when(F.col("_span") > TINY, F.col("_span")).otherwise(1.0), "curv_ratio": F.col("acc_sg8") / (F.abs("vel_sg8") + TINY),
    })
    s = s.withColumns({
        "tc_x_ext": F.col("trend_consistency") * 2 * F.col("extremeness"), "tc_x_amp": F.col("trend_consistency") * F.col("vel_z"), "cons_rec_x_ext": F.col("cons_rec") * 2 * F.col("extremeness"),
    })
    return s.select(key, *at, *NAMES)


def linear_signal(features: DataFrame, weights: dict[str, tuple[float, float, float]], bias: float) -> Column:
    """Probability from (mean, deviation, weight) by feature; a deviation of nothing counts as one."""
    z = F.lit(float(bias))
    for name, (mean, std, weight) in weights.items():
        z = z + weight * ((F.col(name) - mean) / (std if std > 1e-12 else 1.0))
    return logistic(z)


def tree_value(node: dict, names: Sequence[str]) -> Column:
    """Leaf of a dumped tree: a missing value takes the default side; the others by `<=` or `<`."""
    if "leaf_value" in node:
        return F.lit(float(node["leaf_value"]))
    x = F.col(names[node["split_feature"]])
    left, right = (tree_value(node[side], names) for side in ("left_child", "right_child"))
    goes_left = x <= node["threshold"] if node.get("decision_type", "<=") == "<=" else x < node["threshold"]
    missing = F.when(x.isNull() | F.isnan(x), F.lit(bool(node.get("default_left", True)))).otherwise(goes_left)
    return F.when(missing, left).otherwise(right)


def tree_signal(trees: Sequence[dict], names: Sequence[str]) -> Column:
    """Probability from the sum of the leaves of all trees."""
    total = F.lit(0.0)
    for tree in trees:
        total = total + tree_value(tree, names)
    return logistic(total)


def _dense(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    rows = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in row]).alias("w"), F.lit(float(b)).alias("b")) for row, b in zip(weights, bias)])
    return F.transform(rows, lambda r: F.aggregate(F.zip_with(r["w"], x, lambda a, b: a * b), r["b"], lambda s, v: s + v))


def network_signal(features: DataFrame, names: Sequence[str], model: dict) -> DataFrame:
    """Adds `prob`, `direction` and `conviction` of a network of rectified layers over standardised features.

    model: mean, std (one a feature), layers (weights, bias), the last with one unit, and temperature. Arithmetic on
    arrays in the engine; a row with a null feature has null results.
    """
    some = F.lit(True)
    for n in names:
        some = some & F.col(n).isNotNull()
    x = F.array(*[(F.col(n) - float(m)) / float(s or 1.0) for n, m, s in zip(names, model["mean"], model["std"])])
    d = features.withColumn("_x", F.when(some, x))
    for k, (weights, bias) in enumerate(model["layers"]):
        h = _dense(F.col("_x"), weights, bias)
        d = d.withColumn("_x", h if k == len(model["layers"]) - 1 else F.transform(h, lambda v: F.greatest(v, F.lit(0.0))))
    d = d.withColumn("prob", logistic(F.get("_x", 0) / float(model.get("temperature", 1.0)))).drop("_x")
    side = F.when(F.col("prob") > 0.5, "bullish").when(F.col("prob") < 0.5, "bearish").when(F.col("prob").isNotNull(), "neutral")
    return d.withColumns({"direction": side, "conviction": F.least(F.lit(1.0), F.abs(F.col("prob") - 0.5) * 2)})
