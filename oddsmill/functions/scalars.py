"""Column functions: every one has a defined value on short, missing or degenerate input, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), _c(x)))


def saturate(x, half: float) -> Column:
    """0..1 with diminishing returns; one half at `half`, 0 for values that aren't positive and finite."""
    x = _c(x)
    good = (x > 0) & (x < float("inf")) & ~F.isnan(x)
    return F.when(good, x / (x + half)).otherwise(0.0)


def logistic(z, steepness: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-steepness * _c(z)))


def half_up(x) -> Column:
    """Rounds halves upwards, towards plus infinity."""
    return F.floor(_c(x) + 0.5)


def finite_or(x, default: float = 0.0) -> Column:
    """A number, from text too, or the default where it is missing, malformed or not finite."""
    v = _c(x).try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def json_strings(x) -> Column:
    """An array of strings from JSON text, also with single quotes; empty where it can't be read."""
    return F.coalesce(F.from_json(F.regexp_replace(_c(x), "'", '"'), "array<string>"), F.array().cast("array<string>"))


def outcome_label(x, rule: str = "yes_ge_no") -> Column:
    """1 or 0 from a list of two outcome prices, null where it can't be told.

    Rules: yes_ge_no, yes_gt_no, max_90 (decisive if the larger is 0.9 or more), max_90_min_10 (and the other 0.1 or less).
    """
    a = F.from_json(F.regexp_replace(_c(x), "'", '"'), "array<string>")
    yes, no = F.get(a, 0).try_cast("double"), F.get(a, 1).try_cast("double")
    label = (yes > no if rule == "yes_gt_no" else yes >= no).cast("int")
    good = F.size(a) >= 2
    if rule.startswith("max_90"):
        good = good & (F.greatest(yes, no) >= 0.9)
    if rule == "max_90_min_10":
        good = good & (F.least(yes, no) <= 0.1)
    return F.when(good, label)


def logit_scaled(p) -> Column:
    """Log odds over 9.2, of a price kept off its ends, within -1..1."""
    q = clamp(p, 1e-4, 1 - 1e-4)
    return clamp(F.log(q / (1 - q)) / 9.2, -1, 1)


def soft_bucket(p, n: int = 10) -> Column:
    """Half the centre of the price's band and half the price."""
    q = clamp(p, 0, 1)
    return 0.5 * (F.least(F.floor(q * n), F.lit(n - 1)) + 0.5) / n + 0.5 * q


def fir(value, coefficients: list[float], order) -> Column:
    """Sum of c[k] times the value k rows ago, for windows whose features are linear in their values."""
    terms = [float(c) * F.lag(_c(value), k).over(order) for k, c in enumerate(coefficients) if c]
    return sum(terms[1:], terms[0])
