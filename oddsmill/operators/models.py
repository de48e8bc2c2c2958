"""Learners on features, their calibration, and small fixed forms of scoring. Trees and networks are Spark ML's, the logistic is
a few aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clamp, logistic
from . import evaluate
from .windows import HORIZON


def _vector(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(rows)


def _probability(df: DataFrame) -> Column:
    return vector_to_array("probability")[1].alias("prob")


@dataclass(frozen=True)
class Logistic:
    """A fitted logistic: weights are those of the standardised features."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def __call__(self, df: DataFrame) -> DataFrame:
        """Rows without a missing feature, with `prob`."""
        odds = F.lit(self.intercept)
        for x, w in zip(_scaled(self.features, self.mean, self.std), self.weights):
            odds = odds + w * x
        return _whole(df, self.features).withColumn("prob", logistic(odds))

    def raw(self) -> list[float]:
        """Weights of the features as they are, and the intercept that goes with them."""
        w = [x / s if s > 0 else 0.0 for x, s in zip(self.weights, self.std)]
        return [*w, self.intercept - sum(x * m for x, m in zip(w, self.mean))]


def _whole(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.where(" and ".join(f"{f} is not null and not isnan({f})" for f in features))


def _scaled(features: Sequence[str], mean: Sequence[float], std: Sequence[float]) -> list[Column]:
    return [(F.col(f) - m) / s if s > 0 else F.lit(0.0) for f, m, s in zip(features, mean, std)]


def fit_logistic(rows: DataFrame, features: list[str], label: str = "label", l2: float = 1e-3, steps: int = 6) -> Logistic:
    """Ridge logistic on features scaled by the training rows (sample deviation); the intercept isn't held down.

    A fixed number of Newton steps from zero. Each is one aggregate of the gradient and of the weighted Gram matrix, as
    many sums as there are pairs of features, added up map-side; only they come to the driver.
    """
    import numpy as np

    train = _whole(rows.where("part = 'train'"), features)
    found = train.agg(*[F.avg(f).alias(f"m{k}") for k, f in enumerate(features)], *[F.stddev_samp(f).alias(f"s{k}") for k, f in enumerate(features)]).first()
    d = len(features)
    mean, std = [float(found[k] or 0.0) for k in range(d)], [float(found[d + k] or 0.0) for k in range(d)]
    x = [F.lit(1.0), *[F.col(f"x{k}") for k in range(d)]]
    scaled = train.select(F.col(label).cast("double").alias("y"), *[c.alias(f"x{k}") for k, c in enumerate(_scaled(features, mean, std))])
    w = np.zeros(d + 1)
    hold = l2 * np.diag([0.0] + [1.0] * d)
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    for _ in range(steps):
        odds = F.lit(float(w[0]))
        for k in range(d):
            odds = odds + float(w[k + 1]) * x[k + 1]
        r = scaled.withColumn("p", logistic(odds)).withColumn("v", F.col("p") * (1 - F.col("p")))
        sums = r.agg(*[F.avg((F.col("p") - F.col("y")) * c) for c in x], *[F.avg(F.col("v") * x[i] * x[j]) for i, j in pairs]).first()
        if sums[0] is None:
            break
        gram = np.zeros((d + 1, d + 1))
        for (i, j), v in zip(pairs, sums[d + 1 :]):
            gram[i, j] = gram[j, i] = v
        gram += hold + np.diag([0.0 if k == 0 or std[k - 1] > 0 else 1.0 for k in range(d + 1)])  # flat features keep a weight of 0
        w = w - np.linalg.solve(gram, np.array(sums[: d + 1], float) + hold @ w)
    return Logistic(tuple(features), tuple(mean), tuple(std), tuple(float(v) for v in w[1:]), float(w[0]))


def family_shares(spark: SparkSession, model: Logistic, families: dict[str, str]) -> DataFrame:
    """Absolute weight of each family of features, its share of all, and its loudest feature: a row for each family."""
    rows = [(families[f], f, abs(w)) for f, w in zip(model.features, model.weights)]
    d = spark.createDataFrame(rows, "family string, feature string, w double")
    total = sum(w for _, _, w in rows) + 1e-12
    return d.groupBy("family").agg((F.sum("w") / total).alias("share"), F.sum("w").alias("abs_weight"), F.max_by("feature", "w").alias("top_feature"), F.max("w").alias("top_abs_weight"))


def fit_gbdt(rows: DataFrame, features: list[str], label: str = "label", rounds: int = 10, depth: int = 3):
    """Boosted trees on raw features; the last tenth of training rows by `tfrac` stops them early. Rows whose labels reach
    into that tenth (HORIZON steps of 1 / `n` before it) are left out."""
    train = rows.where("part = 'train'")
    cut = train.agg(F.percentile_approx("tfrac", F.lit(0.9), 10_000)).first()[0]
    stop = F.col("tfrac") > F.lit(cut)
    train = train.withColumn("stop", stop).where(stop | (F.col("tfrac") + HORIZON / F.col("n") <= F.lit(cut)))
    train = _vector(train, features)
    model = GBTClassifier(featuresCol="raw", labelCol=label, maxIter=rounds, maxDepth=depth, validationIndicatorCol="stop", seed=7).fit(train)
    return lambda df: model.transform(_vector(df, features)).withColumn("prob", _probability(df)).drop("raw", "rawPrediction", "probability", "prediction")


def fit_mlp(rows: DataFrame, features: list[str], label: str = "label", hidden: int = 16, rounds: int = 40):
    train = _vector(rows.where("part = 'train'"), features)
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[len(features), hidden, hidden, 2], maxIter=rounds, seed=7).fit(scale.transform(train))
    return lambda df: model.transform(scale.transform(_vector(df, features))).withColumn("prob", _probability(df)).drop("raw", "features", "rawPrediction", "probability", "prediction")


def fit_isotonic(rows: DataFrame, score: str = "prob", label: str = "outcome"):
    """Rising fit of outcomes on scores, applied by linear interpolation between its breakpoints."""
    model = IsotonicRegression(featuresCol=score, labelCol=label).fit(rows.select(F.col(score).cast("double"), F.col(label).cast("double")))
    return lambda df: model.transform(df).withColumnRenamed("prediction", "calibrated")


def fit_temperature(rows: DataFrame, score: str = "prob", label: str = "outcome", low: float = 0.25, high: float = 6.0, passes: int = 4, points: int = 9) -> float:
    """The divisor of log odds with the least mean log loss: each pass puts a grid over the interval in one aggregate."""
    q = clamp(score, 1e-6, 1 - 1e-6)
    d = rows.select(F.log(q / (1 - q)).alias("z"), F.col(label).alias("y"))
    for _ in range(passes):
        grid = [low + (high - low) * k / (points - 1) for k in range(points)]
        loss = lambda t: F.avg(F.log1p(F.exp(-F.abs(F.col("z") / t))) + F.greatest(F.col("z") / t, F.lit(0.0)) - F.col("y") * F.col("z") / t)
        found = d.agg(*[loss(t).alias(f"l{k}") for k, t in enumerate(grid)]).first()
        best = min(range(points), key=lambda k: found[k] if found[k] is not None else 0.0)
        low, high = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    return (low + high) / 2


#: A calibration as data: breakpoints [score, rate] of a rising map, or a method with its numbers.
Calibration = Sequence[Sequence[float]] | dict | None


def calibration_kind(spec: Calibration) -> str:
    if isinstance(spec, dict):
        return str(spec.get("method", "sigmoid"))
    return "isotonic" if spec else "sigmoid"


def calibrated(odds: Column, spec: Calibration) -> Column:
    """A probability from log odds by a calibration: a map of breakpoints over the logistic (linear between them, flat
    beyond), `temperature`, `platt` (a and b), or the plain logistic for anything else. Log odds count up to 60."""
    sigmoid = lambda z: logistic(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z)))
    kind = calibration_kind(spec)
    if kind == "temperature":
        return sigmoid(odds / (float(spec.get("temperature", 1.0)) or 1.0))
    if kind == "platt":
        return sigmoid(float(spec.get("a", 1.0)) * odds + float(spec.get("b", 0.0)))
    if kind != "isotonic":
        return sigmoid(odds)
    points = [(float(x), float(y)) for x, y, *_ in spec]
    xs, ys = (F.array(*[F.lit(p[k]) for p in points]) for k in (0, 1))
    p = sigmoid(odds)
    k = F.size(F.filter(xs, lambda x: x < p))  # the first breakpoint at or over p
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    between = F.when(x1 - x0 < 1e-12, y0).otherwise(y0 + (y1 - y0) * (p - x0) / (x1 - x0))
    return clamp(F.when(k == 0, F.lit(points[0][1])).when(k >= len(points), F.lit(points[-1][1])).otherwise(between), 0, 1)


def threshold_by_balance(rows: DataFrame, score: str = "prob", label: str = "outcome") -> DataFrame:
    """The threshold of 0.20 to 0.80 with the best balanced accuracy, the lowest of equals."""
    grid = [(round(0.2 + 0.01 * k, 2),) for k in range(61)]
    t = rows.sparkSession.createDataFrame(grid, "threshold double")
    up, hit = F.col(label) > 0.5, F.col(score) >= F.col("threshold")
    rate = lambda c, ok: F.coalesce(F.avg(F.when(c, ok.cast("double"))), F.lit(0.0))
    g = rows.crossJoin(F.broadcast(t)).groupBy("threshold").agg(((rate(up, hit) + rate(~up, ~hit)) / 2).alias("balanced_accuracy"))
    return g.orderBy(F.desc(F.round("balanced_accuracy", 12)), "threshold").limit(1)


def p_up(moves: DataFrame, key: str, move: str, n: int = 9) -> DataFrame:
    """Probability of a rise: one less the distribution at 0, read off a grid of quantiles, within .001 to .999."""
    levels = [(k + 1) / (n + 1) for k in range(n)]
    g = moves.groupBy(key).agg(F.percentile(move, F.array(*[F.lit(x) for x in levels])).alias("q"))
    q = F.col("q")
    below = F.size(F.filter(q, lambda x: x <= 0))
    a, b = F.get(q, below - 1), F.get(q, below)
    share = F.when(b > a, -a / (b - a)).otherwise(0.0)
    cdf = F.when(below == 0, 0.0).when(below == n, 1.0).otherwise((below + share) / (n + 1))
    return g.select(key, clamp(1 - cdf, 0.001, 0.999).alias("p_up"))


def cosine_to_group(vectors: DataFrame, label: int) -> DataFrame:
    """Mean cosine of each vector to the vectors of a group: its unit vector times the mean of theirs."""
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    u = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e")).withColumn("_s", size).where("_s > 0")
    u = u.select("vec_id", "label", F.transform("e", lambda x: x / F.col("_s")).alias("u"))
    mean = u.where(F.col("label") == label).select(F.posexplode("u").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x"))
    group = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("g"))  # one row as long as a vector
    return u.crossJoin(F.broadcast(group)).select("vec_id", F.aggregate(F.zip_with("u", "g", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("cosine"))


def auc_of(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """AUC, its strength either way, and Pearson's r with the forward move, for each candidate feature."""
    out = None
    for f in features:
        one = evaluate.auc(rows, f, label).crossJoin(rows.agg(F.coalesce(F.corr(f, "fwd"), F.lit(0.0)).alias("r")))
        one = one.select(F.lit(f).alias("feature"), "auc", (F.abs(F.col("auc") - 0.5) + 0.5).alias("strength"), "r")
        out = one if out is None else out.unionByName(one)
    return out


#: A prime under 2 ** 31: products of two residues fit a long, here and in SQL alike.
PRIME = 2_147_483_647


def _resample_sums(n: int, seed: int):
    """Of a task's rows: for each resample the sum of weights and of weighted values, as two arrays that grow with nothing."""

    def run(batches):
        import math

        import numpy as np
        import pyarrow as pa

        weight, total = np.zeros(n), np.zeros(n)
        b = np.arange(n, dtype=np.int64)
        # weights are Poisson with mean 1, up to seven: how many of these shares a number exceeds
        shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(7)])
        for batch in batches:
            values, ties = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(values), 256):
                x = (ties[at : at + 256, None] % PRIME * 48271 + b[None, :] * 69621 + seed) % PRIME
                x = (x * x % PRIME * 16807 + b[None, :]) % PRIME
                u = (x * x % PRIME + 0.5) / PRIME
                w = np.searchsorted(shares, u.ravel(), side="left").reshape(u.shape)
                weight += w.sum(0)
                total += values[at : at + 256] @ w
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(weight), pa.array(total)], names=["b", "w", "t"])

    return run


def bootstrap_mean(rows: DataFrame, value: str, tie: str, n: int = 2000, seed: int = 11) -> DataFrame:
    """95 % interval of a mean by a Poisson bootstrap: (low, high, mean), the bounds being the resamples at .025 and .975 of n.

    Every row draws its weight in each resample from a hash of its `tie`, an integer. A task adds its rows to two arrays of
    n sums; the arrays, not the rows, are shuffled.
    """
    d = rows.select(F.col(value).cast("double"), F.col(tie).cast("long")).where(F.col(value).isNotNull() & F.col(tie).isNotNull())
    sums = d.mapInArrow(_resample_sums(n, seed), "b long, w double, t double").groupBy("b").agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
    means = sums.where("w > 0").agg(F.sort_array(F.collect_list(F.col("t") / F.col("w"))).alias("m"), F.avg(F.col("t") / F.col("w")).alias("mean"))  # n numbers
    at = lambda share: F.get("m", F.floor(F.size("m") * F.lit(share)).cast("int"))
    return means.select(at(0.025).alias("low"), at(0.975).alias("high"), "mean")


def fuzzy_score(name: Column, query: str) -> Column:
    """Score of a name against a query of letters in order: 12 at the start, 9 at a word's, 6 after another match, else 1;
    0.4 off for each letter skipped; short names gain. Null where the letters aren't all there.

    A fold over the query's letters, each found at or after the end of the match before it, in built-ins.
    """
    low = F.lower(name)
    state = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("total"), F.lit(-1).alias("before"))

    def step(s: Column, c: Column) -> Column:
        k = F.call_function("locate", c, low, s["at"] + 1) - 1
        first = F.substring(low, k, F.lit(1)).rlike(r"[\p{L}\p{N}]")
        points = F.when(k == 0, 12.0).when(~first, 9.0).when((s["before"] >= 0) & (k == s["before"] + 1), 6.0).otherwise(1.0)
        skipped = F.when(s["before"] >= 0, 0.4 * (k - s["at"])).otherwise(0.0)
        found = F.struct((k + 1).alias("at"), (s["total"] + points - skipped).alias("total"), k.alias("before"))
        return F.when((s["at"] >= 0) & (k >= 0), found).otherwise(F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("total"), F.lit(-1).alias("before")))

    end = F.aggregate(F.array(*[F.lit(c) for c in query.lower()]), state, step)
    return F.when(end["at"] >= 0, end["total"] + (20 - F.length(name)) * 0.15)


def fuzzy_top(df: DataFrame, name: str, query: str, k: int = 24) -> DataFrame:
    """The k best names (ties by name and the other columns); a pattern drops most rows before any is scored."""
    import re

    some = df.where(F.lower(name).rlike(".*".join(re.escape(c) for c in query.lower())))
    return some.withColumn("score", fuzzy_score(F.col(name), query)).where("score is not null").orderBy(F.desc(F.round("score", 9)), name, *[c for c in df.columns if c != name]).limit(k)
