"""Regime states of bars, their transition table, and the score adjustment read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.config import ADVERSE_STATES, CONTINUATION_STATES, MarkovPolicy
from barlight.functions.columns import by_ticker, clip, clip_score, pct_change, rounded

c = F.col


def state() -> Column:
    """Regime of a bar from its feature columns; the strongest warning wins."""
    vs20, vs50 = pct_change(c("close"), c("sma20")), pct_change(c("close"), c("sma50"))
    gap = pct_change(c("close"), c("prev20_close"))
    at_high = gap >= -0.5
    return (
        F.when((vs50 <= -4.0) | ((c("ret_20") <= -8.0) & (vs50 < 0.0)), "breakdown_risk")
        .when(at_high & ((vs20 >= 6.0) | (c("rsi_full") >= 72.0)), "extended_breakout")
        .when(at_high & (vs50 >= 0.0) & (c("rsi_full") < 72.0), "fresh_breakout")
        .when((vs50 >= 0.0) & (c("ret_20") >= 2.0) & vs20.between(-2.0, 6.0), "constructive_trend")
        .otherwise("sideways")
    )


def plain_ticker(ticker: Column) -> Column:
    """One spelling per instrument, so suffixed and bare names meet in joins."""
    return F.regexp_replace(F.upper(F.trim(ticker)), r"\.NS$", "")


def recency_weight(date: Column, latest: Column, half_life_months: float) -> Column:
    if half_life_months <= 0:
        return F.lit(1.0)
    months = F.greatest(F.datediff(latest, date), F.lit(0)) / 30.4375
    return F.coalesce(F.exp(F.lit(-0.6931471805599453 / half_life_months) * months), F.lit(1.0))


def train(states: DataFrame, policy: MarkovPolicy = MarkovPolicy()) -> DataFrame:
    """Weighted transition probabilities to the state *horizon* bars later: state, next_state, weight, prob."""
    moves = states.withColumn("next_state", F.lead("state", policy.horizon).over(by_ticker())).filter(c("next_state").isNotNull())
    # Weights against a fixed day differ from those against the latest one by a factor, so one pass finds both.
    rate = -0.6931471805599453 / policy.half_life_months / 30.4375 if policy.half_life_months > 0 else 0.0
    age = lambda day: F.datediff(F.lit("2000-01-01").cast("date"), day)
    sums = moves.groupBy("state", "next_state").agg(F.sum(F.exp(rate * age(c("date")))).alias("_w"), F.max("date").alias("_d"))
    counts = sums.withColumn("weight", c("_w") / F.exp(rate * age(F.max("_d").over(Window.partitionBy(F.lit(1))))))
    total = F.sum("weight").over(Window.partitionBy("state"))
    rows = counts.withColumn("total", total).filter(c("total") >= policy.min_transitions)
    return rows.select("state", "next_state", rounded(c("weight"), 4).alias("weight"), rounded(c("weight") / c("total"), 6).alias("prob"))


def state_probabilities(transitions: DataFrame) -> DataFrame:
    mass = lambda names: F.sum(F.when(c("next_state").isin(*names), c("prob")).otherwise(0.0))
    out = transitions.groupBy(c("state").alias("_state")).agg(mass(CONTINUATION_STATES).alias("_cont"), mass(ADVERSE_STATES).alias("_adv"))
    return out.withColumns({"_cont": clip(c("_cont"), 0, 1), "_adv": clip(c("_adv"), 0, 1)})


def adjust(signals: DataFrame, transitions: DataFrame, policy: MarkovPolicy = MarkovPolicy()) -> DataFrame:
    """Score adjustment from the signal's state (column markov_state); at most five states are broadcast."""
    old = F.coalesce("score_markov_adjustment", F.lit(0.0)) if "score_markov_adjustment" in signals.columns else F.lit(0.0)
    named = signals.withColumn("_key", F.coalesce("markov_state", F.lit("sideways"))).withColumn("_base", F.coalesce("signal_score", F.lit(0.0)) - old)
    out = named.join(F.broadcast(state_probabilities(transitions)), c("_key") == c("_state"), "left")
    p, q = F.coalesce("_cont", F.lit(0.0)), F.coalesce("_adv", F.lit(0.0))
    push = lambda v, center, size: F.greatest(F.lit(0.0), v - center) / max(1e-6, 1.0 - center) * size
    raw = push(p, policy.continuation_center, policy.max_bonus) - push(q, policy.adverse_center, policy.max_penalty)
    return (
        out.withColumns(
            {
                "signal_score_pre_markov": rounded(c("_base"), 4),
                "markov_p_continuation": rounded(p, 4),
                "markov_p_adverse": rounded(q, 4),
                "score_markov_adjustment": rounded(clip(raw, -policy.max_penalty, policy.max_bonus), 2),
            }
        )
        .withColumn("signal_score", rounded(clip_score(c("_base") + c("score_markov_adjustment")), 1))
        .drop("_key", "_state", "_cont", "_adv", "_base")
    )
