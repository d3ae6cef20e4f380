"""Score components, family bonus and long-term health adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlight.config import ScoreWeights
from barlight.functions.columns import as_int, clip, clip_score, rounded

W = ScoreWeights()


def rsi_sweet_spot(rsi: Column) -> Column:
    """100 between 50 and 60, falling linearly to 0 on either side; neutral 50 when unknown."""
    r = clip_score(rsi)
    return (
        F.when(r.isNull(), F.lit(50.0))
        .when(r < 50.0, clip_score(r / 50.0 * 100.0))
        .when(r > 60.0, clip_score((100.0 - r) / 40.0 * 100.0))
        .otherwise(F.lit(100.0))
    )


def component_columns(trend_pct: Column, setup_pct: Column, volume_ratio: Column, stop_pct: Column, rsi: Column) -> dict[str, Column]:
    """Five components rounded to one digit, and their weighted sum from the unrounded values."""
    raw = {
        "trend": clip_score(50.0 + trend_pct * 5.0),
        "setup": clip_score(50.0 + setup_pct * 8.0),
        "volume": clip_score(40.0 + volume_ratio * 20.0),
        "risk": clip_score(100.0 - stop_pct * 6.0),
        "rsi": rsi_sweet_spot(rsi),
    }
    total = sum((getattr(W, k) * v for k, v in raw.items()), F.lit(0.0))
    return {f"score_{k}": rounded(v, 1) for k, v in raw.items()} | {"component_score": rounded(total, 1)}


def slope_bonus(slope_pct: Column) -> Column:
    return F.when(slope_pct > 0, rounded(F.least(F.lit(W.slope_bonus_cap), slope_pct * 4.0), 2)).otherwise(F.lit(0.0))


def family_weight_columns(weight: Column, detail_score: Column | None = None) -> tuple[Column, Column]:
    """(bonus, score_pattern) of a family; without a learned detail the score is the weight's share of its cap."""
    share = rounded(F.coalesce(weight, F.lit(0.0)) / W.family_cap * 100.0, 1)
    score = share if detail_score is None else F.coalesce(detail_score, share)
    return F.coalesce(weight, F.lit(0.0)), score


def apply_family_bonus(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """Replace the family contribution. *weights* has one row per family (at most seven): family, weight, score_pattern."""
    w = weights.select(
        F.upper(F.trim("family")).alias("_family"), F.col("weight").alias("_weight"), F.col("score_pattern").alias("_detail")
    )
    old = F.coalesce("pattern_bonus", F.lit(0.0)) if "pattern_bonus" in signals.columns else F.lit(0.0)
    bonus, score = family_weight_columns(F.col("_weight"), F.col("_detail"))
    joined = signals.join(F.broadcast(w), F.upper(F.trim("pattern_family")) == F.col("_family"), "left")
    base = F.coalesce("signal_score", F.lit(0.0)) - old
    return joined.withColumns(
        {
            "signal_score": rounded(clip_score(base + bonus), 1),
            "score_pattern": rounded(score, 1),
            "pattern_bonus": rounded(bonus, 2),
        }
    ).drop("_family", "_weight", "_detail")


def apply_lt_health(signals: DataFrame) -> DataFrame:
    """Four trend-health tests read from the feature columns on the row; unknown features leave the score alone."""
    tests = [
        F.col("sma50") > F.col("sma200"),
        F.col("ret_20") > 0,
        F.col("ret_60") > 0,
        F.col("dist_52w_high_pct") >= -12.0,
    ]
    known = F.lit(True)
    for c in ("sma50", "sma200", "ret_20", "ret_60", "dist_52w_high_pct"):
        known = known & F.col(c).isNotNull()
    points = F.when(known, sum((as_int(t) for t in tests), F.lit(0))).otherwise(F.lit(2))
    bonus = F.when(known, clip((F.col("lt_health_points") - 2.0) * 1.5, -3.0, 3.0)).otherwise(F.lit(0.0))
    base = F.coalesce("signal_score", F.lit(0.0))
    return signals.withColumn("lt_health_points", points.cast("long")).withColumns(
        {
            "signal_score_pre_lt_health": rounded(base, 4),
            "lt_health_bonus": rounded(bonus, 2),
            "signal_score": rounded(clip_score(base + bonus), 1),
        }
    )
