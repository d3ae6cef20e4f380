"""Model fitting with pyspark.ml: feature preparation, classifiers, calibration, catalyst ridge."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from barlight.config import FAMILIES
from barlight.functions.columns import as_int
from barlight.functions.ranks import quantiles
from barlight.operators.stoprisk import step_calibration
from barlight.operators.training import gram, solve_ridge

c = F.col


def prepare(df: DataFrame, features: tuple) -> DataFrame:
    """Median, mean and population std (of the imputed column) per feature; constant columns get std 1."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), c(f).cast("double").alias("x")) for f in features])
    long = df.select(F.explode(cells).alias("m")).select("m.feature", "m.x")
    medians = quantiles(long, ["feature"], "x", {"median": 0.5}).select("feature", "median")
    # One row per feature: the broadcast is as large as the feature list.
    filled = long.join(F.broadcast(medians), "feature", "left").withColumn("x", F.coalesce("x", "median", F.lit(0.0)))
    stats = filled.groupBy("feature").agg(F.coalesce(F.first("median"), F.lit(0.0)).alias("median"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("s"))
    return stats.select("feature", "median", "mean", F.when(c("s") <= 1e-8, F.lit(1.0)).otherwise(c("s")).alias("std"))


def design(df: DataFrame, features: tuple, stats: dict, families: bool = True) -> DataFrame:
    """Column *features*: standardised numbers followed by the family one-hot; *stats* holds one row per feature."""
    p = stats
    cols = {f"_x_{f}": (F.coalesce(c(f).cast("double"), F.lit(p[f]["median"])) - p[f]["mean"]) / p[f]["std"] for f in features if f in p}
    if families:
        cols |= {f"_f_{x}": as_int(F.upper("pattern_family") == x).cast("double") for x in FAMILIES}
    out = df.withColumns(cols)
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(out).drop(*cols)


def balance(df: DataFrame, label: str, weight: str | None = None) -> tuple[DataFrame, int]:
    """Weight from the class counts, n / (2 n of the class), times the row weight; and the number of rows n."""
    w = F.greatest(F.coalesce(c(weight), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    seen = df.agg(F.count("*").alias("n"), F.count_if(c(label) == 1).alias("p")).first()
    n, pos = seen["n"], seen["p"]
    up, down = n / (2.0 * max(1, pos)), n / (2.0 * max(1, n - pos))
    return df.withColumn("model_weight", w * F.when(c(label) == 1, up).otherwise(down)), n


def isotonic_steps(scored: DataFrame, score: str, label: str, weight: str | None = None) -> list[tuple[float, float]]:
    """Pool-adjacent-violators steps (upper bound, value) over the exact scores.

    Equal scores are counted first; the fit pools each range slice of the distinct scores in its task, and then the slices' blocks.
    """
    w = c(weight) if weight else F.lit(1.0)
    pooled = scored.groupBy(c(score).alias("x")).agg(F.sum(w).alias("w"), (F.sum(w * c(label)) / F.sum(w)).alias("y")).filter(c("w") > 0)
    model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(pooled)
    bounds, values = model.boundaries.toArray(), model.predictions.toArray()
    steps: dict[float, float] = {}
    for upper, value in zip(bounds, values):
        steps[float(value)] = float(upper)
    return [(upper, value) for value, upper in sorted(steps.items())]


def probability(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


@dataclass
class Calibrated:
    """A fitted classifier with its feature statistics and calibration steps."""

    model: object
    stats: dict
    features: tuple
    families: bool
    steps: list
    margin: bool = False

    def score(self, df: DataFrame, name: str) -> DataFrame:
        out = self.model.transform(design(df, self.features, self.stats, self.families))
        raw = self._raw()
        return out.withColumn(name, step_calibration(raw, self.steps)).drop("features", "rawPrediction", "probability", "prediction")

    def _raw(self) -> Column:
        return 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1])) if self.margin else probability()


L2 = 0.5


def estimator(kind: str, label: str, rows: int):
    """An unfitted classifier; the logistic penalty is L2 over the number of rows, on a loss averaged over the weights."""
    common = {"featuresCol": "features", "labelCol": label, "weightCol": "model_weight"}
    if kind == "logistic":
        return LogisticRegression(regParam=L2 / max(1, rows), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10, **common)
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=400, maxDepth=8, minInstancesPerNode=8, featureSubsetStrategy="sqrt", seed=42, **common)
    if kind == "gbt":
        return GBTClassifier(maxIter=220, maxDepth=4, stepSize=0.05, subsamplingRate=0.9, seed=42, **common)
    if kind == "margin":
        return LinearSVC(regParam=0.01, maxIter=200, **common)
    raise ValueError(f"unknown model {kind}")


def fit(df: DataFrame, label: str, features: tuple, kind: str = "logistic", families: bool = True, weight: str | None = None, **params) -> Calibrated:
    if absent := [f for f in features if f not in df.columns]:
        raise ValueError(f"features not in the training rows: {absent}")
    stats = {r["feature"]: r for r in prepare(df, features).collect()}  # one row per feature
    ready, rows = balance(design(df, features, stats, families), label, weight)
    ready = ready.persist()
    try:
        untrained = estimator(kind, label, rows)
        model = (untrained.setParams(**params) if params else untrained).fit(ready)
        out = Calibrated(model, stats, features, families, [], margin=kind == "margin")
        scored = model.transform(ready).withColumn("_p", out._raw())
        out.steps = isotonic_steps(scored, "_p", label, weight)
        return out
    finally:
        ready.unpersist()


def optimality(df: DataFrame, label: str, features: tuple, families: bool = True, weight: str | None = None, tolerance: float = 1e-4) -> tuple[int, int, bool]:
    """Rows, positives, and whether the gradient of the penalised loss vanishes at the logistic fit: mean of w (p - y) x plus L2 / n times b."""
    fitted = fit(df, label, features, "logistic", families, weight)
    ready, n = balance(design(df, features, fitted.stats, families), label, weight)
    scored = fitted.model.transform(ready)
    x, rest = vector_to_array("features"), c("model_weight") * (probability() - c(label))
    beta = fitted.model.coefficients.toArray()
    sums = scored.agg(
        F.sum("model_weight").alias("w"), F.sum(rest).alias("b"), F.count_if(c(label) == 1).alias("p"), *[F.sum(rest * x[i]).alias(f"g{i}") for i in range(len(beta))]
    ).first()
    gradient = [sums["b"] / sums["w"], *(sums[f"g{i}"] / sums["w"] + L2 / max(1, n) * b for i, b in enumerate(beta))]
    return n, sums["p"], bool(max(map(abs, gradient)) < tolerance)


def coverage(df: DataFrame, features: tuple) -> dict[str, float]:
    row = df.agg(*[F.avg(c(f).isNotNull().cast("double")).alias(f) for f in features]).first()
    return {f: float(row[f] or 0.0) for f in features}


def catalyst_ridge(df: DataFrame, features: tuple, label: str = "win_flag", min_coverage: float = 0.85, cap: float = 4.0, alpha: float = 1.0, min_rows: int = 10, baseline: dict | None = None, digits: int = 2) -> DataFrame:
    """Ridge on standardised catalyst columns with enough coverage, coefficients mapped back and capped.

    Without enough covered features or labelled rows the weights of *baseline* are returned (none given: zeros). Means, spreads and cross products come from one aggregation; only the small normal equations reach the driver.
    """
    spark = df.sparkSession
    schema = "mode string, feature string, coverage double, coefficient double"
    share = coverage(df, features)
    used = [f for f in features if share[f] >= min_coverage]
    known = df.filter(c(label).isNotNull()).select(*[F.coalesce(c(f).cast("double"), F.lit(0.0)).alias(f) for f in used], label)
    rows = gram(known.withColumn("_k", F.lit(1)), used, label, F.lit(1.0), ["_k"]) if used else []
    if not rows or rows[0]["m0_0"] < min_rows:
        return spark.createDataFrame([("fallback", f, share[f], float((baseline or {}).get(f, 0.0))) for f in features], schema)
    m, k = rows[0], len(used)
    n = m["m0_0"]
    mean = np.array([m[f"m0_{i}"] / n for i in range(1, k + 2)])
    spread = np.array([max(m[f"m{i}_{i}"] / n - mean[i - 1] ** 2, 0.0) ** 0.5 or 1.0 for i in range(1, k + 1)])
    cov = np.array([[m[f"m{min(i, j)}_{max(i, j)}"] / n - mean[i - 1] * mean[j - 1] for j in range(1, k + 2)] for i in range(1, k + 1)])
    scaled = n * cov[:, :k] / np.outer(spread, spread)
    beta = np.linalg.solve(scaled + alpha * np.eye(k), n * cov[:, k] / spread) / spread
    return spark.createDataFrame([("trained", f, share[f], round(float(np.clip(b, -cap, cap)), digits)) for f, b in zip(used, beta)], schema)


def ridge_residuals(df: DataFrame, coefficients: dict[str, float], label: str = "win_flag", alpha: float = 1.0) -> DataFrame:
    """How far stored catalyst coefficients are from the optimum of the standardised ridge on these rows: feature, coverage, coefficient, residual.

    The residual is the covariance of feature and label minus what the coefficients explain minus the penalty, per row and in standard units.
    """
    features = tuple(coefficients)
    share = coverage(df, features)
    known = df.filter(c(label).isNotNull()).select(*[F.coalesce(c(f).cast("double"), F.lit(0.0)).alias(f) for f in features], label)
    rows = gram(known.withColumn("_k", F.lit(1)), list(features), label, F.lit(1.0), ["_k"])
    out, k = [], len(features)
    for m in rows:
        n = m["m0_0"]
        mean = [m[f"m0_{i}"] / n for i in range(1, k + 2)]
        cov = lambda i, j: m[f"m{min(i, j)}_{max(i, j)}"] / n - mean[i - 1] * mean[j - 1]  # noqa: B023, E731
        spread = [max(cov(i, i), 0.0) ** 0.5 or 1.0 for i in range(1, k + 1)]
        for i, f in enumerate(features, start=1):
            explained = sum(cov(i, j) * coefficients[g] for j, g in enumerate(features, start=1))
            residual = (cov(i, k + 1) - explained) / spread[i - 1] - alpha / n * coefficients[f] * spread[i - 1]
            out.append((f, share[f], coefficients[f], residual))
    return df.sparkSession.createDataFrame(out, "feature string, coverage double, coefficient double, residual double")


__all__ = ["Calibrated", "balance", "catalyst_ridge", "coverage", "design", "estimator", "fit", "isotonic_steps", "prepare", "solve_ridge"]
