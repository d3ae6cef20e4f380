"""Replay of the scoring chain over stored or fresh signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from barlight.operators import markov, penalties, scoring, stoprisk, stscore

Step = Callable[[DataFrame], DataFrame]


REPLACED = (
    "lt_health_bonus", "lt_health_points", "score_penalty_total", "score_markov_adjustment", "pattern_bonus", "score_pattern", "signal_stop_risk",
    "signal_score_pre_stop_risk_penalty", "signal_reliability_score", "score_penalty_stop_risk", "score_penalty_stop_risk_gated", "probability",
    "st_score_pre_model", "blended_score", "st_score", "gap_intraday_pct", "volatility_pct", *stscore.BOOSTERS, *stoprisk.REGIME_FEATURES,
)


def rescore(
    signals: DataFrame, family_weights: DataFrame, buckets: DataFrame, transitions: DataFrame, lookback: int = 20, stop_risk: Step | None = None, short_term: Step | None = None
) -> DataFrame:
    """Family bonus, health, penalties, regime adjustment, and where given the stop-risk model and the short-term score.

    The unadjusted score travels with the row, so replaying the chain on its own output changes nothing even where a
    step clipped the score.
    """
    out = signals
    if "lt_health_bonus" in out.columns:
        out = out.withColumn("signal_score", F.col("signal_score_unadjusted")).drop(*REPLACED)
    else:
        out = out.withColumn("signal_score_unadjusted", out["signal_score"])
    out = scoring.apply_lt_health(scoring.apply_family_bonus(out, family_weights))
    out = penalties.apply_penalties(penalties.penalty_features(out, lookback), buckets)
    out = markov.adjust(out.withColumn("markov_state", markov.state()), transitions)
    for step in (stop_risk, short_term):
        out = step(out) if step else out
    return out
