"""Short-term score: intraday features, model blend, rank uplift and boosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlight.config import REGIME_STATES
from barlight.functions.columns import clip, rounded
from barlight.functions.ranks import add_average_rank

c = F.col


def intraday(signals: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Move from open to close and range of the signal bar, 0 when the bar is missing."""
    if bars is not None:
        day = bars.select("ticker", c("date").alias("signal_date"), *[c(x).alias(f"_{x}") for x in ("open", "high", "low", "close")])
        signals, p = signals.join(day, ["ticker", "signal_date"], "left"), "_"
    else:
        p = ""
    o, h, l, cl = (c(p + x) for x in ("open", "high", "low", "close"))
    out = signals.withColumns(
        {
            "gap_intraday_pct": F.coalesce(F.when(o > 0, rounded((cl - o) / o * 100.0, 4)), F.lit(0.0)),
            "volatility_pct": F.coalesce(F.when(cl > 0, rounded((h - l) / cl * 100.0, 4)), F.lit(0.0)),
        }
    )
    return out.drop("_open", "_high", "_low", "_close") if p else out


def fill_regime(signals: DataFrame, states: DataFrame, probabilities: DataFrame) -> DataFrame:
    """Fill state and probabilities that are missing or zero. *probabilities*: _state, _cont, _adv (at most five rows)."""
    s = states.select("ticker", c("date").alias("signal_date"), c("state").alias("_new"))
    out = signals.join(s, ["ticker", "signal_date"], "left").withColumn("markov_state", F.coalesce("_new", "markov_state", F.lit("")))
    out = out.join(F.broadcast(probabilities), c("markov_state") == c("_state"), "left")
    fill = lambda old, new: F.when(F.abs(F.coalesce(old, F.lit(0.0))) > 1e-12, c(old)).otherwise(rounded(F.coalesce(new, F.lit(0.0)), 4))
    return out.withColumns(
        {
            "markov_p_continuation": fill("markov_p_continuation", "_cont"),
            "markov_p_adverse": fill("markov_p_adverse", "_adv"),
        }
    ).drop("_new", "_state", "_cont", "_adv")


def one_hot(state: Column) -> dict[str, Column]:
    return {f"{x}_encoded": F.coalesce((F.lower(F.trim(state)) == x).cast("long"), F.lit(0)) for x in REGIME_STATES}


def one_hot_text(state: Column) -> Column:
    return F.concat_ws("|", *[v.cast("string") for v in one_hot(state).values()])


def blend_weights(extra: dict[str, float]) -> dict[str, float]:
    """Weights of the other models clamped to [0, 1]; together they leave at least 5 % for the logistic model."""
    w = {k: max(0.0, min(1.0, float(v))) for k, v in extra.items()}
    total = sum(w.values())
    if total >= 1.0:
        w = {k: v * 0.95 / max(total, 1e-9) for k, v in w.items()}
    return {"logistic": max(0.0, 1.0 - sum(w.values())), **w}


def blend(probabilities: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the models that are present."""
    present = {k: weights[k] for k in probabilities if k in weights}
    total = sum(present.values())
    share = {k: (v / total if total > 1e-9 else 1.0 / len(present)) for k, v in present.items()}
    return sum((probabilities[k] * share[k] for k in present), F.lit(0.0))


def rank_uplift(signals: DataFrame, probability: str = "probability", weight: float = 0.25) -> DataFrame:
    """Blend of the calibrated score and its percentile rank over the whole table (average ties)."""
    ranked = add_average_rank(signals, probability, "_rank")
    base = clip(c(probability) * 100.0, 0, 100)
    pct = F.coalesce(c("_rank") / c("_rank_n"), F.lit(0.5)) * 100.0
    return ranked.withColumns(
        {"st_score_pre_model": rounded(base, 1), "blended_score": (1.0 - weight) * base + weight * pct}
    ).drop("_rank", "_rank_n")


BOOSTERS = ("boost_regime", "boost_consensus", "boost_entry", "boost_volatility", "boost_precision")


def boosters() -> dict[str, Column]:
    """Five additive bonuses from regime, consensus, entry quality, volatility and precision columns."""
    z = lambda name, default=0.0: F.coalesce(c(name).cast("double"), F.lit(float(default)))
    p, q = z("markov_p_continuation"), z("markov_p_adverse")
    gap = F.coalesce(c("feature_gap_pct"), c("gap_intraday_pct"), F.lit(0.0))
    tired, high, n = z("feature_exhaustion_risk"), z("feature_close_vs_prev_high_pct"), z("consensus_count", 1)
    state, swing, ret, wide = c("markov_state"), z("feature_range_vs_atr", 1), z("regime_median_ret_20d_pct"), z("regime_pct_above_sma50", 50)
    on = lambda test, size: F.when(test, F.lit(float(size))).otherwise(F.lit(0.0))
    return {
        "boost_regime": on((p >= 0.65) & (q <= 0.20), 8)
        + F.when((state == "fresh_breakout") & (p >= 0.60), F.when(p >= 0.68, 7.0).otherwise(5.0)).otherwise(0.0)
        + on((state == "constructive_trend") & (p >= 0.58), 3) + on(state.isin("extended_breakout", "breakdown_risk"), -2),
        "boost_consensus": on(n >= 3, 6) + on(n == 2, 3),
        "boost_entry": on(gap.between(-0.5, 1.5), 3) + on(tired < 8, 2) + on(high >= -1, 1) + on(gap >= 3, -2),
        "boost_volatility": on((ret > 1.5) & (swing < 1.2), 4) + on(wide > 75, 2) + on(ret < -1.5, -2),
        "boost_precision": on((p >= 0.58) & (q <= 0.22), 2) + on(gap.between(-0.8, 1.8), 1.5) + on(tired <= 8.5, 2) + on(high >= -1.2, 1)
        + on(gap >= 3.5, -2) + on(tired >= 16, -2.5) + on(z("score_penalty_extension") <= -0.35, -1.5),
    }


def apply_boosters(signals: DataFrame) -> DataFrame:
    parts = boosters()
    out = signals.withColumns(parts)
    total = clip(sum((c(k) for k in parts), F.lit(0.0)), -6, 18)
    return out.withColumn("st_score", rounded(clip(c("blended_score") + total, 0, 100), 1))


def forward_momentum(features: DataFrame) -> DataFrame:
    """Close 1, 3 and 5 bars later against this close. Looks ahead: labels and reports only, never a model input."""
    from barlight.functions.columns import by_ticker

    move = lambda n: F.when(c("close") > 0, rounded((F.lead("close", n).over(by_ticker()) - c("close")) / c("close") * 100.0, 4))
    return features.withColumns({f"momentum_{n}d_pct": F.coalesce(move(n), F.lit(0.0)) for n in (1, 3, 5)})
