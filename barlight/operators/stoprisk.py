"""Market breadth, stop-risk prediction from parameter tables, and the risk penalty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlight.config import StopRiskPolicy
from barlight.functions.columns import as_int, bound, clip, exceeds, pct_change, rounded
from barlight.functions.ranks import quantiles

c = F.col
# Column names of the model artifacts, and which of them each preset uses.
SCORE_FEATURES = ("signal_score", "score_trend", "score_setup", "score_volume", "score_rsi", "score_risk", "score_pattern")
BONUS_FEATURES = ("ma_slope_bonus", "pattern_bonus", "score_penalty_total", "consensus_count")
ROW_FEATURES = (
    "feature_recent_signal_count", "feature_close_vs_prev_high_pct", "feature_close_vs_sma50_pct", "feature_gap_pct",
    "feature_range_vs_atr", "feature_gap_sequence_risk", "feature_exhaustion_risk",
)
REGIME_FEATURES = (
    "regime_pct_above_sma50", "regime_pct_above_sma200", "regime_median_ret_20d_pct", "regime_median_close_vs_sma50_pct",
)
FEATURE_SETS = {
    "full": SCORE_FEATURES + BONUS_FEATURES + ROW_FEATURES + REGIME_FEATURES,
    "scores_only": SCORE_FEATURES + BONUS_FEATURES,
    "scores_plus_row_context": SCORE_FEATURES + BONUS_FEATURES + ROW_FEATURES,
    "scores_plus_regime": SCORE_FEATURES + BONUS_FEATURES + REGIME_FEATURES,
}
TARGETS = {
    "stop_before_target": "signal_stop_risk",
    "stop_within_5d": "signal_stop_risk_5d",
    "gap_through_stop": "signal_gap_through_stop_risk",
    "mae_exceeds_stop": "signal_mae_exceeds_stop_risk",
}


def breadth(features: DataFrame) -> DataFrame:
    """Cross-section of each date. Shares are partial sums; medians use the sliced exact quantile.

    A close that equals its mean is not above it, whatever noise the mean's running sums left.
    """
    above = lambda ma: F.avg(as_int(exceeds(c("close"), c(ma))).cast("double")) * 100.0
    shares = features.groupBy("date").agg(
        rounded(above("sma50"), 4).alias("regime_pct_above_sma50"), rounded(above("sma200"), 4).alias("regime_pct_above_sma200")
    )
    metric = lambda name, v: F.struct(F.lit(name).alias("metric"), v.alias("value"))
    values = F.array(metric("ret", c("ret_20")), metric("vs50", pct_change(c("close"), c("sma50"))))
    long = features.select("date", F.explode(values).alias("m")).select("date", "m.metric", "m.value")
    medians = quantiles(long, ["date", "metric"], "value", {"median": 0.5})
    pick = lambda name: rounded(F.max(F.when(c("metric") == name, c("median"))), 6)
    wide = medians.groupBy("date").agg(
        pick("ret").alias("regime_median_ret_20d_pct"), pick("vs50").alias("regime_median_close_vs_sma50_pct")
    )
    return shares.join(wide, "date", "left")


def join_breadth(signals: DataFrame, regime: DataFrame) -> DataFrame:
    return signals.join(regime.withColumnRenamed("date", "signal_date"), "signal_date", "left")


def model_input(parameters: dict[str, dict[str, float]], family_coefficients: dict[str, float], intercept: float) -> Column:
    """Linear predictor: missing values take the median, then (x - mean) / std times the coefficient."""
    total = F.lit(float(intercept))
    for name, p in parameters.items():
        x = F.coalesce(c(name).cast("double"), F.lit(float(p["median"])))
        total = total + (x - p["mean"]) / (p["std"] or 1.0) * p["coefficient"]
    for family, beta in family_coefficients.items():
        total = total + as_int(F.upper(F.trim("pattern_family")) == family) * F.lit(float(beta))
    return total


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -35.0, 35.0)))


def step_calibration(p: Column, steps: list[tuple[float, float]]) -> Column:
    """Value of the first step whose upper bound is at least p; beyond the last bound the last value."""
    if not steps:
        return p
    table = F.array(*[F.struct(F.lit(float(upper)).alias("upper"), F.lit(float(value)).alias("value")) for upper, value in steps])
    first = lambda p: F.try_element_at(F.filter(table, lambda s: p <= s["upper"]), F.lit(1))
    return bound(p, lambda p: F.when(p.isNotNull(), F.coalesce(first(p)["value"], F.lit(float(steps[-1][1])))))


def risk_penalty(risk: Column, policy: StopRiskPolicy = StopRiskPolicy()) -> Column:
    share = clip((clip(risk, 0, 1) - policy.risk_floor) / max(policy.risk_full_penalty - policy.risk_floor, 1e-6), 0, 1)
    return F.coalesce(policy.max_penalty * F.pow(share, F.lit(policy.power)), F.lit(0.0))


def apply_risk(signals: DataFrame, policy: StopRiskPolicy = StopRiskPolicy()) -> DataFrame:
    """Penalty, optional gate and reliability cap from column signal_stop_risk; the stored pre-penalty score is the base."""
    has = "signal_score_pre_stop_risk_penalty" in signals.columns
    base = F.coalesce(*([c("signal_score_pre_stop_risk_penalty")] if has else []), "signal_score", F.lit(0.0))
    risk = clip(c("signal_stop_risk"), 0, 1)
    gated = (risk > policy.hard_gate_threshold) if policy.hard_gate else F.lit(False)
    out = signals.withColumn("_base", base).withColumns(
        {
            "signal_reliability_score": F.round((1.0 - risk) * 100.0 + 1e-9, 0).cast("long"),
            "score_penalty_stop_risk": rounded(risk_penalty(c("signal_stop_risk"), policy), 4),
            "score_penalty_stop_risk_gated": F.coalesce(gated, F.lit(False)),
        }
    )
    score = F.when(c("score_penalty_stop_risk_gated"), F.lit(0.0)).otherwise(clip(c("_base") - risk_penalty(c("signal_stop_risk"), policy), 0, 100))
    capped = F.when(c("signal_reliability_score") < policy.reliability_cap_threshold, F.least(score, F.lit(policy.reliability_score_cap))).otherwise(score)
    return out.withColumns(
        {"signal_score_pre_stop_risk_penalty": rounded(c("_base"), 4), "signal_score": rounded(capped, 1)}
    ).drop("_base")
