"""Features over the 16 rows before an anchor row, and labels after it.

The window of anchor i is rows i-16 .. i-1; the label compares row i+4 with row i. Frames and lags over one ordering
by key share a single sort. A key with very many rows is cut into stretches that overlap (over_stretches).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clamp, fir
from ..functions.windows import WINDOW, coefficients, macd_histogram

HORIZON, LEAST_STD = 4, 1e-4


def order(key: str = "market_id", at: tuple[str, ...] = ("bar_ts",)):
    return W.partitionBy(key).orderBy(*at)


def _lags(p: str, w, n: int = WINDOW) -> Column:
    """The window as an array, oldest first."""
    return F.array(*[F.lag(p, k).over(w) for k in range(n, 0, -1)])


def labelled(series: DataFrame, price: str = "close", key: str = "market_id", at: tuple[str, ...] = ("bar_ts",), window: int = WINDOW, horizon: int = HORIZON, least_std: float = LEAST_STD) -> DataFrame:
    """Anchor rows that have a full window and a future, and whose window moves: `label`, `fwd`, `tfrac`, `window`."""
    w = order(key, at)
    s = series.withColumns({
        "i": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy(key)), "window": _lags(price, w, window),
        "fwd": F.lead(price, horizon).over(w) - F.col(price), "step": F.col(price) - F.lag(price).over(w),
    })
    s = s.withColumn("step_std", F.stddev_samp("step").over(w.rowsBetween(-(window - 1), -1)))
    s = s.where((F.col("i") >= window) & F.col("fwd").isNotNull() & (F.col("step_std") >= least_std))
    return s.withColumns({"label": (F.col("fwd") > 0).cast("int"), "tfrac": F.col("i") / F.col("n")}).drop("step")


#: Rows of a key from which it may be cut, and rows of a stretch.
HOT_ROWS, STRETCH_ROWS = 1_000_000, 250_000


def hot_keys(rows: DataFrame, key: str = "market_id", least: int = HOT_ROWS) -> list:
    """Keys with more rows than `least` and than a task's fair share: fewer of them than there are shuffle partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in n.where(F.col("n") > max(least, total / parts)).select(key).collect()] if total > least else []


def over_stretches(f: Callable[[DataFrame, str], DataFrame], series: DataFrame, hot: list, key: str = "market_id", at: tuple[str, ...] = ("bar_ts",), rows: int = STRETCH_ROWS, before: int = WINDOW + 1, after: int = HORIZON + 1) -> DataFrame:
    """f(series, key), with the hot keys cut in stretches of `rows` rows, so that a key with much of the tape is many tasks.

    A stretch also holds the `before` rows ahead of it and the `after` rows behind it, and gives its own rows only: f may
    look that far and no further. `at` orders a key's rows without ties, its first column is a number. f gets a struct in
    place of the key, which its result must keep, beside `at`; `i`, `n` and `tfrac` are put right where it returns them.
    """
    if not hot:
        return f(series, key)
    lead, place = at[0], F.struct(*at)
    some = series.where(F.col(key).isin(hot))
    # places within a key: from its count of rows in ranges by approximate quantiles, and the place within a range
    shares = F.array(*[F.lit(k / 256) for k in range(1, 256)])
    cuts = some.groupBy(key).agg(F.percentile_approx(lead, shares, 10_000).alias("_cuts"))  # a row for each hot key
    some = some.join(F.broadcast(cuts), key).withColumn("_cell", F.size(F.filter("_cuts", lambda x: x < F.col(lead)))).drop("_cuts")
    held = some.groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    w = W.partitionBy(key)
    held = held.select(key, "_cell", F.coalesce(F.sum("_n").over(w.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_total"))
    some = some.join(F.broadcast(held), [key, "_cell"])
    some = some.withColumn("_i", F.col("_before") + F.row_number().over(W.partitionBy(key, "_cell").orderBy(*at)) - 1).drop("_cell", "_before")
    own = F.floor(F.col("_i") / rows).cast("long")
    ends = some.groupBy(key, own.alias("_s")).agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    reach = F.array(own, F.when(F.col("_i") % rows >= rows - before, own + 1), F.when((F.col("_i") % rows < after) & (own > 0), own - 1))
    some = some.withColumn("_s", F.explode(F.array_compact(reach))).join(ends, [key, "_s"])
    start = F.greatest(F.col("_s") * rows - before, F.lit(0))
    part = lambda s, lo, hi, a, n: F.struct(F.col(key).alias("key"), s.alias("s"), lo.alias("lo"), hi.alias("hi"), a.cast("long").alias("start"), n.cast("long").alias("n"))
    kind = some.schema["_lo"].dataType
    none = F.lit(None)
    cut = some.withColumn("_key", part(F.col("_s"), F.col("_lo"), F.col("_hi"), start, F.col("_total"))).drop("_s", "_lo", "_hi", "_total", "_i")
    rest = series.where(~F.coalesce(F.col(key).isin(hot), F.lit(False))).withColumn("_key", F.when(F.col(key).isNotNull(), part(F.lit(-1).cast("long"), none.cast(kind), none.cast(kind), F.lit(0), none)))
    out = f(rest.unionByName(cut.select(*rest.columns)), "_key")
    k = F.col("_key")
    out = out.where(k["lo"].isNull() | ((place >= k["lo"]) & (place <= k["hi"])))
    right = {}
    shifted = F.col("i") + F.coalesce(k["start"], F.lit(0))  # rows of a null key have no struct
    if "i" in out.columns:
        right["i"] = shifted
    if "n" in out.columns:
        right["n"] = F.coalesce(k["n"], F.col("n"))
    if "tfrac" in out.columns:
        right["tfrac"] = shifted / F.coalesce(k["n"], F.col("n"))
    names = [c for c in out.columns if c != key]
    return out.withColumns(right).select(*[k["key"].alias(key) if c == "_key" else F.col(c) for c in names])


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def price13(series: DataFrame, price: str = "close", key: str = "market_id", at: tuple[str, ...] = ("bar_ts",), least_std: float = LEAST_STD) -> DataFrame:
    """Thirteen features of the price window of each labelled anchor."""
    w = order(key, at)
    frame, steps = w.rowsBetween(-WINDOW, -1), w.rowsBetween(-(WINDOW - 1), -1)
    p, d = F.col(price), F.col("_d")
    s = series.withColumn("_d", p - F.lag(p).over(w))
    s = s.withColumns({
        "last": F.lag(p, 1).over(w), "first": F.lag(p, WINDOW).over(w), "mean_ret": F.avg(d).over(steps), "vol": F.stddev_samp(d).over(steps),
        "mean_p": F.avg(p).over(frame), "std_p": F.stddev_samp(p).over(frame), "low_p": F.min(p).over(frame), "high_p": F.max(p).over(frame),
        "momentum": F.avg(d).over(w.rowsBetween(-4, -1)), "activity": F.sum(F.abs(d)).over(steps),
        "gains": F.sum(F.when(d > 0, d).otherwise(0.0)).over(steps), "losses": F.sum(F.when(d < 0, -d).otherwise(0.0)).over(steps),
        "downside": F.stddev_samp(F.when(d < 0, d)).over(steps), "macd_hist": fir(p, [0.0, *coefficients(macd_histogram)], w),
        "rets": _lags("_d", w, WINDOW - 1),
    })
    s = labelled(s, price, key, at, least_std=least_std)
    centred = F.transform("rets", lambda x: x - F.col("mean_ret"))
    num = F.aggregate(F.zip_with(F.slice(centred, 1, WINDOW - 2), F.slice(centred, 2, WINDOW - 2), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    den = F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x)
    mad = _mean(F.transform("window", lambda x: F.abs(x - F.col("mean_p"))))
    moved, span = F.col("gains") + F.col("losses"), F.col("high_p") - F.col("low_p")
    return s.select(
        key, *at, "label", "fwd", "last", "mean_ret", "vol", (F.col("last") - F.col("first")).alias("drift"),
        F.when(F.col("std_p") > 1e-9, (F.col("last") - F.col("mean_p")) / F.col("std_p")).otherwise(0.0).alias("band_z"),
        "momentum", F.when(den > 1e-12, clamp(num / den, -1, 1)).otherwise(0.0).alias("autocorr"), "activity",
        F.when(moved > 1e-9, (F.col("gains") - F.col("losses")) / moved).otherwise(0.0).alias("rsi"),
        F.when(mad >= 1e-9, clamp((F.col("last") - F.col("mean_p")) / (0.015 * mad) / 100, -5, 5)).otherwise(0.0).alias("cci"),
        "macd_hist", F.when(span >= 1e-9, (F.col("last") - F.col("low_p")) / span).otherwise(0.5).alias("stoch_k"),
        F.coalesce("downside", F.lit(0.0)).alias("downside_vol"),
    )


def triple_barrier(series: DataFrame, price: str = "close", key: str = "market_id", at: tuple[str, ...] = ("bar_ts",), times: float = 1.5) -> DataFrame:
    """Which of two barriers, `times` the window's step deviation away, is touched first within the horizon; else the sign
    of the whole move."""
    w = order(key, at)
    ahead = [F.lead(price, k).over(w) - F.col(price) for k in range(1, HORIZON + 1)]
    s = labelled(series.withColumn("ahead", F.array(*ahead)), price, key, at).withColumn("barrier", times * F.col("step_std"))
    touch = F.coalesce(*[F.when(F.abs(F.get("ahead", k)) >= F.col("barrier"), F.signum(F.get("ahead", k))) for k in range(HORIZON)])
    return s.select(key, *at, "barrier", F.when(touch.isNotNull(), (touch > 0).cast("int")).otherwise(F.col("label")).alias("label"), F.when(touch.isNotNull(), touch * F.col("barrier")).otherwise(F.col("fwd")).alias("fwd"))


def range_features(bars: DataFrame, key: str = "market_id") -> DataFrame:
    """True range, Parkinson volatility, Williams %R and the place in the range of each bar's window of bars."""
    w = order(key)
    frame = w.rowsBetween(-WINDOW, -1)
    before = F.lag("close").over(w)
    true = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    ratio = F.when((F.col("high") > F.col("low")) & (F.col("low") > 0), F.pow(F.log(F.col("high") / F.col("low")), 2))
    s = bars.withColumn("tr", true).withColumn("pk", ratio)
    s = s.withColumns({"n": F.count("*").over(frame), "last": F.lag("close").over(w), "atr": F.avg("tr").over(w.rowsBetween(-(WINDOW - 1), -1)), "park": F.avg("pk").over(frame), "hi": F.max("high").over(frame), "lo": F.min("low").over(frame)}).where(F.col("n") == WINDOW)
    span = F.col("hi") - F.col("lo")
    return s.select(
        key, "bar_ts", (F.col("atr") / F.greatest("last", F.lit(1e-3))).alias("atr"), F.coalesce(F.sqrt(F.col("park") / (4 * F.log(F.lit(2.0)))), F.lit(0.0)).alias("parkinson_vol"),
        F.when(span >= 1e-9, (F.col("last") - F.col("hi")) / span).otherwise(-0.5).alias("williams_r"), F.when(span >= 1e-9, (F.col("last") - F.col("lo")) / span).otherwise(0.5).alias("stoch_k"),
    )


def oscillator_states(features: DataFrame) -> DataFrame:
    """Over- and undersold by RSI (70 and 30) and CCI (plus and minus 100)."""
    rsi, cci = (F.col("rsi") + 1) * 50, F.col("cci") * 100
    state = lambda x, lo, hi: F.when(x >= hi, "overbought").when(x <= lo, "oversold").otherwise("neutral")
    return features.withColumns({"rsi_state": state(rsi, 30, 70), "cci_state": state(cci, -100, 100)})


def strided(windows: DataFrame, step: int, key: str = "market_id", at: tuple[str, ...] = ("bar_ts",)) -> DataFrame:
    """Every step-th window of each key, from its first."""
    return windows.withColumn("_r", F.row_number().over(order(key, at)) - 1).where(F.col("_r") % step == 0).drop("_r")


def polynomial(series: DataFrame, price: str = "close", key: str = "market_id", points: tuple[int, ...] = (5, 8, 12, 16)) -> DataFrame:
    """Velocity and acceleration at the end of the window from quadratic fits to its last points, and the trend's consistency."""
    from ..functions.windows import polynomial_end

    w = order(key)
    s = series.withColumn("_d", F.col(price) - F.lag(price).over(w))
    cols = {}
    for n in points:
        cols[f"velocity_{n}"] = fir(price, [0.0, *polynomial_end(1, 2, n)], w)
        cols[f"acceleration_{n}"] = fir(price, [0.0, *polynomial_end(2, 2, n)], w)
    s = s.withColumns(cols | {"i": F.row_number().over(w) - 1, "_slope": fir(price, [0.0, *polynomial_end(1, 1, WINDOW)], w), "ups": F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)).over(w.rowsBetween(-(WINDOW - 1), -1))}).where(F.col("i") >= WINDOW)
    v = F.col("_slope")  # a straight line through the whole window; moves of nothing go with a falling one
    agree = F.when(v > 0, F.col("ups")).when(v < 0, WINDOW - 1 - F.col("ups")).otherwise(0) / (WINDOW - 1)
    return s.select(key, "bar_ts", *cols, (F.signum(v) * agree).alias("trend_consistency"))


def trend_estimators(series: DataFrame, price: str = "close", key: str = "market_id") -> DataFrame:
    """Slopes of the window by estimators that are all linear in it."""
    from ..functions.windows import ewma, holt, kalman, polynomial_end, smooth_increment

    w = order(key)
    named = {
        "sg1": polynomial_end(1, 1, WINDOW), "sg2": polynomial_end(1, 2, WINDOW), "holt": coefficients(holt),
        "kalman": coefficients(kalman), "tvdiff": coefficients(smooth_increment), "ewma_ret": coefficients(lambda xs: ewma([b - a for a, b in zip(xs, xs[1:])])),
    }
    s = series.withColumns({n: fir(price, [0.0, *c], w) for n, c in named.items()} | {"i": F.row_number().over(w) - 1})
    return s.where(F.col("i") >= WINDOW).select(key, "bar_ts", *named)


def newest13(series: DataFrame, price: str = "close", key: str = "market_id", at: str = "bar_ts") -> DataFrame:
    """Thirteen features of the newest window of each key, flat ones too; keys with fewer rows have none."""
    last = series.groupBy(key).agg(F.max(at).alias(at), F.max_by(price, at).alias(price))
    # rows after the end, the first of which is the anchor: its window is all real
    after = last.select(key, F.explode(F.sequence(F.lit(1), F.lit(HORIZON + 1))).alias("_k"), at, price).withColumn(at, F.col(at) + F.col("_k")).drop("_k")
    rows = price13(series.select(key, at, price).unionByName(after), price, key, (at,), least_std=-1.0)
    return rows.join(last.select(key, (F.col(at) + 1).alias(at)), [key, at], "left_semi")


def of_array(rows: DataFrame, prices: str) -> DataFrame:
    """Adds the thirteen features of a price window that is held as an array, oldest first; null where it isn't full.

    The same arithmetic as price13, over the values of one row: for streams and for windows that come ready.
    """
    p, n = F.col(prices), WINDOW
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    full = F.size(p) == n
    d = rows.withColumn("_p", F.when(full, p)).withColumn("_d", F.when(full, F.zip_with(F.slice(p, 2, n - 1), F.slice(p, 1, n - 1), lambda b, a: b - a)))
    d = d.withColumns({"mean_ret": _mean(F.col("_d")), "_m": _mean(F.col("_p")), "last": F.get("_p", n - 1)})
    deviation = lambda a, m, k: F.sqrt(add(F.transform(a, lambda x: (x - m) * (x - m))) / (k - 1))
    d = d.withColumns({"vol": deviation(F.col("_d"), F.col("mean_ret"), n - 1), "_s": deviation(F.col("_p"), F.col("_m"), n), "_c": F.transform("_d", lambda x: x - F.col("mean_ret")), "_falls": F.filter("_d", lambda x: x < 0), "activity": add(F.transform("_d", lambda x: F.abs(x)))})
    num = add(F.zip_with(F.slice("_c", 1, n - 2), F.slice("_c", 2, n - 2), lambda a, b: a * b))
    den = add(F.transform("_c", lambda x: x * x))
    mad = _mean(F.transform("_p", lambda x: F.abs(x - F.col("_m"))))
    low, span = F.array_min("_p"), F.array_max("_p") - F.array_min("_p")
    macd = [float(c) * F.get("_p", n - 1 - k) for k, c in enumerate(coefficients(macd_histogram))]
    falls = F.size("_falls")
    d = d.withColumns({
        "drift": F.col("last") - F.get("_p", 0), "band_z": F.when(F.col("_s") > 1e-9, (F.col("last") - F.col("_m")) / F.col("_s")).otherwise(0.0), "momentum": _mean(F.slice("_d", n - 4, 4)),
        "autocorr": F.when(den > 1e-12, clamp(num / den, -1, 1)).otherwise(0.0), "rsi": F.when(F.col("activity") > 1e-9, add(F.col("_d")) / F.col("activity")).otherwise(0.0),
        "cci": F.when(mad >= 1e-9, clamp((F.col("last") - F.col("_m")) / (0.015 * mad) / 100, -5, 5)).otherwise(0.0), "macd_hist": sum(macd[1:], macd[0]),
        "stoch_k": F.when(span >= 1e-9, (F.col("last") - low) / span).otherwise(0.5), "downside_vol": F.when(falls >= 2, deviation(F.col("_falls"), _mean(F.col("_falls")), falls)).otherwise(0.0),
    })
    return d.drop("_p", "_d", "_m", "_s", "_c", "_falls")


def _window_of_bars(bars: DataFrame, key: str) -> tuple[DataFrame, object, object, object]:
    """Bars with the window's close steps, deviations and ranges; the orders of the window, its steps and its last four."""
    w = order(key)
    frame, steps, four = w.rowsBetween(-WINDOW, -1), w.rowsBetween(-(WINDOW - 1), -1), w.rowsBetween(-4, -1)
    before = F.lag("close").over(w)
    ratio = F.when((F.col("high") > F.col("low")) & (F.col("low") > 0), F.pow(F.log(F.col("high") / F.col("low")), 2))
    s = bars.withColumns({"_d": F.col("close") - before, "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)), "_pk": ratio, "i": F.row_number().over(w) - 1})
    return s, frame, steps, four


def _last_z(c: str, frame, w) -> Column:
    """The newest value of the window against its mean and population deviation."""
    x = F.col(c).cast("double")
    return (F.lag(x).over(w) - F.avg(x).over(frame)) / (F.stddev_pop(x).over(frame) + 1e-9)


def flow_features(bars: DataFrame, key: str = "market_id") -> DataFrame:
    """Twenty features of the window of bars: price, range, and flow by the true aggressor's side; population deviations."""
    s, frame, steps, four = _window_of_bars(bars, key)
    w, d = order(key), F.col("_d")
    total = F.sum("volume").over(frame) + 1e-9
    both = F.col("buy_vol") + F.col("sell_vol")
    gains, losses = (F.sum(F.when(x > 0, x).otherwise(0.0)).over(steps) for x in (d, -d))
    s = s.withColumns({
        "last": F.lag("close").over(w), "mean_ret": F.avg(d).over(steps), "vol": F.stddev_pop(d).over(steps), "drift": F.lag("close").over(w) - F.lag("close", WINDOW).over(w),
        "_m": F.avg("close").over(frame), "_s": F.stddev_pop("close").over(frame), "momentum": F.avg(d).over(four), "_g": gains, "_l": losses, "_atr": F.avg("_tr").over(steps), "_park": F.avg("_pk").over(frame),
        "signed_imbalance": F.sum("signed_vol").over(frame) / total, "ofi_last": F.lag("signed_vol").over(w) / (F.lag("volume").over(w) + 1e-9), "ofi_trend": F.sum("signed_vol").over(four) / (F.sum("volume").over(four) + 1e-9),
        "vpin": F.coalesce(F.avg(F.when(both > 1e-9, F.abs(F.col("buy_vol") - F.col("sell_vol")) / both)).over(frame), F.lit(0.0)), "vol_z": _last_z("volume", frame, w), "trade_intensity": _last_z("trades", frame, w),
        "buy_pressure": F.sum("buy_vol").over(frame) / total, "whale_ratio": F.sum("whale_vol").over(frame) / total, "log_volume": F.log1p(total),
    }).where(F.col("i") >= WINDOW)
    moved = F.col("_g") + F.col("_l")
    return s.select(
        key, "bar_ts", "last", "mean_ret", "vol", "drift", F.when(F.col("_s") > 1e-9, (F.col("last") - F.col("_m")) / F.col("_s")).otherwise(0.0).alias("band_z"), "momentum",
        F.when(moved > 1e-9, (F.col("_g") - F.col("_l")) / moved).otherwise(0.0).alias("rsi"), (F.col("_atr") / F.greatest("last", F.lit(1e-3))).alias("atr"), F.coalesce(F.sqrt(F.col("_park") / (4 * F.log(F.lit(2.0)))), F.lit(0.0)).alias("parkinson_vol"),
        "signed_imbalance", "ofi_last", "ofi_trend", "vpin", (F.abs("ofi_trend") * (1 + F.greatest("vol_z", F.lit(0.0)))).alias("toxicity"), "trade_intensity", "buy_pressure", "whale_ratio", "vol_z",
        (F.abs(F.col("last") - 0.5) * 2).alias("extremeness"), "log_volume",
    )


def flow11(bars: DataFrame, key: str = "market_id") -> DataFrame:
    """Eleven features of signed flow and volume in the window; sample deviations."""
    s, frame, steps, four = _window_of_bars(bars, key)
    w, share = order(key), F.when(F.col("volume") > 1e-9, F.abs("signed_vol") / F.col("volume"))
    total = F.sum("volume").over(frame)
    ramp = [0.0, *[float(k) for k in range(WINDOW, 0, -1)]]
    s = s.withColumn("_r", F.coalesce(share, F.lit(0.0))).withColumns({
        "_v": total, "_f": F.sum("signed_vol").over(frame), "vpin": F.coalesce(F.avg(share).over(frame), F.lit(0.0)), "toxicity": fir("_r", ramp, w) / sum(ramp),
        "trade_intensity": (F.lag("trades").over(w) - F.avg("trades").over(frame)) / (F.stddev_samp("trades").over(frame) + 1e-9), "_flows": _lags("signed_vol", w), "_vols": _lags("volume", w),
        "last": F.lag("close").over(w), "mean_ret": F.avg("_d").over(steps), "vol": F.stddev_samp("_d").over(steps), "momentum": F.avg("_d").over(four),
    }).where(F.col("i") >= WINDOW)
    s = s.withColumn("_c", F.transform("_flows", lambda x: x - F.col("_f") / WINDOW))
    num = F.aggregate(F.zip_with(F.slice("_c", 1, WINDOW - 1), F.slice("_c", 2, WINDOW - 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    den = F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x)
    top = F.aggregate(F.slice(F.sort_array("_vols", False), 1, max(1, WINDOW // 5)), F.lit(0.0), lambda a, x: a + x)
    some = F.col("_v") >= 1e-9
    return s.select(
        key, "bar_ts", F.when(some, clamp(F.col("_f") / F.col("_v"), -1, 1)).otherwise(0.0).alias("signed_imbalance"), "vpin", "toxicity", "trade_intensity",
        F.when(den > 1e-12, clamp(num / den, -1, 1)).otherwise(0.0).alias("flow_autocorr"), F.when(some, clamp(top / F.col("_v"), 0, 1)).otherwise(0.0).alias("whale_ratio"),
        F.when(some, clamp((F.col("_v") + F.col("_f")) / (2 * F.col("_v")), 0, 1)).otherwise(0.5).alias("buy_pressure"), "last", "mean_ret", "vol", "momentum",
    )


def crossmarket(legs: DataFrame, basket: str = "basket_id") -> DataFrame:
    """Each leg against its siblings; a leg without any, or outside a basket that must sum to one, has neutral values."""
    b = W.partitionBy(basket)
    by_price = b.orderBy(F.desc("price"), "market_id")
    d = legs.withColumns({"_n": F.count("*").over(b), "_sum": F.sum("price").over(b), "_r": F.row_number().over(by_price), "_higher": F.rank().over(b.orderBy(F.desc("price"))) - 1, "_std": F.stddev_samp("price").over(b)})
    first, second = (F.max(F.when(F.col("_r") == k, F.col("price"))).over(b) for k in (1, 2))
    d = d.withColumns({"_first": first, "_second": second})
    whole = F.col("neg_risk") & (F.col("_n") >= 2)
    at = lambda x, other: F.when(whole, x).otherwise(other)
    best_other = F.when(F.col("_r") == 1, F.col("_second")).otherwise(F.col("_first"))
    return d.select(
        "market_id", basket, "price", at(F.col("_sum"), F.col("price")).alias("basket_sum"), at(F.col("_sum") - 1, 0.0).alias("residual"), at(F.when(F.col("_sum") > 1e-12, clamp(F.col("price") / F.col("_sum"), 0, 1)).otherwise(1.0), 1.0).alias("share"),
        (F.col("_n") - 1).alias("sibling_count"), at(F.col("_higher") / (F.col("_n") - 1), 0.0).alias("rank"), at(F.col("price") - best_other, 0.0).alias("favourite_gap"), at(F.col("_std"), 0.0).alias("dispersion"), F.col("neg_risk").cast("int").alias("neg_risk"),
    )


def snapshots(tape: DataFrame, ends: DataFrame, shares: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8), recent: int = 24, key: str = "market_id") -> DataFrame:
    """The state of each market at shares of its trades: price, time left and lived, recent moves and flow, maturity.

    `ends` has the created and end time of each market. Everything is a running window over one ordering by market.
    """
    w, whole = order(key, ("t", "seq")), W.partitionBy(key)
    past, late, steps = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(-(recent - 1), 0), w.rowsBetween(-(recent - 2), 0)
    signed = F.when(F.col("side") == "BUY", F.col("usd")).otherwise(-F.col("usd"))
    s = tape.withColumn("_d", F.col("price") - F.lag("price").over(w)).withColumns({
        "i": F.row_number().over(w) - 1, "n": F.count("*").over(whole), "volume": F.sum("usd").over(past), "volume_total": F.sum("usd").over(whole), "_first": F.first("price").over(late),
        "_std": F.stddev_samp("_d").over(steps), "_f": F.sum(signed).over(late), "_v": F.sum("usd").over(late), "_k": F.count("*").over(late),
    })
    at = F.array(*[F.struct(F.lit(x).alias("share"), F.floor(F.col("n") * x).alias("i")) for x in shares])
    s = s.withColumn("share", F.explode(F.filter(at, lambda x: x["i"] == F.col("i")))).join(ends, key)
    life = F.col("end") - F.col("created")
    left = F.when(life > 0, clamp((F.col("end") - F.col("t")) / life, 0, 1)).otherwise(0.0)
    from ..functions.scalars import logit_scaled, soft_bucket

    half = F.abs(F.col("price") - 0.5)
    return s.select(
        key, F.col("share.share").alias("at_share"), "t", "price", half.alias("dist_from_half"), logit_scaled("price").alias("logit_price"), left.alias("time_to_resolution"), F.when(life > 0, clamp((F.col("t") - F.col("created")) / life, 0, 1)).otherwise(1.0).alias("age_fraction"),
        clamp(F.col("price") - F.col("_first"), -1, 1).alias("momentum"), F.coalesce(clamp("_std", 0, 1), F.lit(0.0)).alias("realized_vol"), F.when(F.col("_v") > 1e-9, clamp(F.col("_f") / F.col("_v"), -1, 1)).otherwise(0.0).alias("flow_imbalance"),
        F.when(F.col("volume_total") > 1e-9, clamp(F.col("volume") / F.col("volume_total"), 0, 1)).otherwise(0.0).alias("volume_maturity"), clamp((F.col("_k") - 50) / (50 + 1e-9), -5, 5).alias("trade_count_z"),
        soft_bucket("price").alias("calib_bucket"), (half * left).alias("price_x_time"),
    )


def candle_features(bars: DataFrame, key: str = "market_id") -> DataFrame:
    """Of the window of bars: typical-price CCI, newest volume and trades against their mean (sample deviation), flow by
    the candle's own direction, and where bars closed in their ranges."""
    w = order(key)
    frame = w.rowsBetween(-WINDOW, -1)
    body, span = F.col("close") - F.col("open"), F.col("high") - F.col("low")
    s = bars.withColumns({"_tp": (F.col("high") + F.col("low") + F.col("close")) / 3, "_sv": F.signum(body) * F.col("volume"), "_pr": F.when(span > 1e-9, body / span).otherwise(0.0)})
    z = lambda c: (F.lag(c).over(w) - F.avg(c).over(frame)) / (F.stddev_samp(c).over(frame) + 1e-9)
    s = s.withColumns({
        "i": F.row_number().over(w) - 1, "_tps": _lags("_tp", w), "_m": F.avg("_tp").over(frame), "vol_z": z("volume"), "trade_intensity": z("trades"), "signed_flow": F.sum("_sv").over(frame) / (F.sum("volume").over(frame) + 1e-9), "intrabar_pressure": F.avg("_pr").over(frame),
    }).where(F.col("i") >= WINDOW)
    mad = _mean(F.transform("_tps", lambda x: F.abs(x - F.col("_m"))))
    return s.select(key, "bar_ts", F.when(mad >= 1e-9, clamp((F.get("_tps", WINDOW - 1) - F.col("_m")) / (0.015 * mad) / 100, -5, 5)).otherwise(0.0).alias("cci_tp"), "vol_z", "trade_intensity", "signed_flow", "intrabar_pressure")


def ohlcv20(bars: DataFrame, platform: int = 0, key: str = "market_id") -> DataFrame:
    """Twenty features of candles: the price window's, the ranges', and the candles' own, side by side."""
    p = price13(bars, key=key).select(key, "bar_ts", "label", "last", "mean_ret", "vol", "drift", "band_z", "momentum", "autocorr", "rsi", "macd_hist", (F.abs(F.col("last") - 0.5) * 2).alias("extremeness"))
    return p.join(range_features(bars, key), [key, "bar_ts"]).join(candle_features(bars, key), [key, "bar_ts"]).withColumn("platform", F.lit(float(platform)))


def snapshots12(tape: DataFrame, ends: DataFrame, shares: tuple[float, ...] = (0.15, 0.35, 0.55, 0.75, 0.9), recent: int = 24, key: str = "market_id") -> DataFrame:
    """Twelve features after the first k trades, k the whole part of each share of a market's trades, from two on.

    tape has yes_price and yes_flow (normalize.yes_view); `ends` the created and end times.
    """
    w, whole = order(key, ("t", "seq")), W.partitionBy(key)
    past, late, steps = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(-(recent - 1), 0), w.rowsBetween(-(recent - 2), 0)
    s = tape.withColumn("_d", F.col("yes_price") - F.lag("yes_price").over(w)).withColumns({
        "k": F.row_number().over(w), "n": F.count("*").over(whole), "_uv": F.sum("usd").over(past), "_all": F.sum("usd").over(whole), "_f": F.sum("yes_flow").over(past), "_rf": F.sum("yes_flow").over(late), "_ru": F.sum("usd").over(late),
        "_first": F.first("yes_price").over(late), "vol": F.coalesce(F.stddev_samp("_d").over(steps), F.lit(0.0)),
    })
    wanted = F.array_distinct(F.array(*[F.floor(F.col("n") * x) for x in shares]))
    s = s.where((F.col("k") >= 2) & F.array_contains(wanted, F.col("k").cast("long"))).join(ends, key)
    span = F.greatest(F.col("end") - F.col("created"), F.lit(1.0))
    signed = F.col("yes_price") - 0.5
    maturity = clamp(F.col("_uv") / (F.col("_all") + 1e-9), 0, 1)
    return s.select(
        key, "k", F.col("yes_price").alias("price"), signed.alias("signed_dist"), F.abs(signed).alias("dist"), (1 - clamp((F.col("t") - F.col("created")) / span, 0, 1)).alias("time_rem"), F.log1p(F.greatest(F.col("end") - F.col("t"), F.lit(0.0)) / 3600).alias("log_hours"),
        (F.col("yes_price") - F.col("_first")).alias("momentum"), "vol", (F.col("_rf") / (F.col("_ru") + 1e-9)).alias("flow_recent"), (F.col("_f") / (F.col("_uv") + 1e-9)).alias("flow_cum"), maturity.alias("maturity"), F.log1p(F.col("k").cast("double")).alias("log_trades"), (signed * maturity).alias("signed_maturity"),
    )


def big22(bars: DataFrame, key: str = "market_id") -> DataFrame:
    """Twenty-two features of the window of bars with true ranges and the aggressor's flow; population deviations."""
    w = order(key)
    frame = w.rowsBetween(-WINDOW, -1)
    log_range = F.pow(F.log(F.greatest(F.col("high") / F.greatest("low", F.lit(1e-6)), F.lit(1e-9))), 2)
    s = bars.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_lr", log_range)
    s = s.withColumns({"i": F.row_number().over(w) - 1, "_tps": _lags("_tp", w), "_m": F.avg("_tp").over(frame), "_hi": F.max("high").over(frame), "_lo": F.min("low").over(frame), "_pk": F.avg("_lr").over(frame), "_v": F.avg("volume").over(frame), "_n": F.avg("trades").over(frame), "_close": F.lag("close").over(w)}).where(F.col("i") >= WINDOW)
    mad, span = _mean(F.transform("_tps", lambda x: F.abs(x - F.col("_m")))), F.col("_hi") - F.col("_lo")
    extra = s.select(
        key, "bar_ts", F.when(mad > 1e-9, clamp((F.get("_tps", WINDOW - 1) - F.col("_m")) / (0.015 * mad) / 100, -5, 5)).otherwise(0.0).alias("cci"), F.when(span > 1e-9, (F.col("_close") - F.col("_lo")) / span).otherwise(0.5).alias("stoch_k"),
        F.when(span > 1e-9, (F.col("_close") - F.col("_hi")) / span).otherwise(-0.5).alias("williams_r"), F.sqrt(F.col("_pk") / (4 * F.log(F.lit(2.0)))).alias("parkinson_vol"), F.log1p(F.col("_v") / (F.col("_n") + 1e-9)).alias("log_avg_trade"), F.log1p(F.col("_n") * WINDOW).alias("log_trades"), F.lit(float(WINDOW)).alias("win_len"),
    )
    f = flow_features(bars, key).select(key, "bar_ts", "last", "mean_ret", "vol", "drift", "band_z", "momentum", "rsi", "atr", F.col("signed_imbalance").alias("ofi_window"), "ofi_last", "ofi_trend", "vol_z", "trade_intensity", "extremeness", "log_volume")
    return f.join(extra, [key, "bar_ts"])
