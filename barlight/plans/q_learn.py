"""Queries over training tables, learned weights and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.config import Outcome
from barlight.functions.columns import rounded
from barlight.operators import candles, models, outcomes as oc, stoprisk, stored, training
from barlight.operators.penalties import FEATURES
from barlight.plans import inputs
from barlight.plans.parameters import tables
from barlight.plans.q_score import CATALYST_FEATURES, CATALYST_WEIGHTS, SCORES, catalytic, outcomes, rescored_outcomes, st_rows
from barlight.plans.queries import query
from barlight.session import durable

c = F.col
K = ("ticker", "signal_date", "pattern")


@query
def tr_history(spark, sf):
    s = inputs.signals(spark, sf)
    out = training.training_history(s, inputs.stored_bars(spark, sf))
    return out.select(
        *K, "month", "pattern_family", "target_price", "effective_stop_price", "bars_available", c("target_day").alias("first_target_hit_day"),
        c("stop_day").alias("first_stop_hit_day"), "outcome", "win_flag", "loss_flag", "hold_flag", "stop_before_target", "stop_within_5d", "gap_through_stop",
        "mae_exceeds_stop", "signal_score_pre_penalty", *FEATURES, *[f"feature_recent_signal_count_{n}d" for n in (5, 10, 20, 40)],
    )


@query
def tr_date_window(spark, sf):
    return training.date_window(inputs.signals(spark, sf), "signal_date", "1998-01-01", "1999-12-31").select(*K, "signal_score")


@query
def tr_recency_weight(spark, sf):
    out = training.add_recency_weight(inputs.signals(spark, sf))
    return out.select(*K, rounded(c("sample_weight"), 8).alias("sample_weight"))


@query
def tr_weighted_mean(spark, sf):
    rows = training.add_recency_weight(outcomes(spark, sf))
    mean = lambda x: rounded(training.weighted_mean(c(x).cast("double"), c("sample_weight")), 6).alias(x)
    return rows.groupBy("pattern_family").agg(mean("win_flag"), mean("signal_score"), mean("feature_gap_pct"))


@query
def wt_family(spark, sf):
    return training.family_weights(outcomes(spark, sf))


@query
def wt_quantile_buckets(spark, sf):
    keys = ["feature", "family"]
    out = training.bucket_ranges(training.quantile_edges(training.long_features(outcomes(spark, sf)), keys, 5, 25), keys)
    return out.select(*keys, "lower", "upper", "include_upper")


@query
def wt_penalty_buckets(spark, sf):
    return training.penalty_buckets(outcomes(spark, sf))


@query
def wt_lookback_select(spark, sf):
    return training.select_lookback(outcomes(spark, sf))


@inputs.plan_once
def candle_rows(spark, sf):
    """Signals with candle flags and the percentage-stop outcome, kept as a table."""
    s = inputs.signals(spark, sf).select(*K, "pattern_family", "entry_price", "signal_score", "bar_no", "stop_price")
    labelled = oc.forward_outcome(oc.touches(s, inputs.stored_bars(spark, sf), Outcome(), row_stop=False))
    return durable(candles.signal_flags(labelled, inputs.candle_bars(spark, sf)))


FLAGS = candles.WEIGHT_FLAGS + candles.COMPARISON_FLAGS


@query
def wt_candle_marginal(spark, sf):
    return training.candle_marginals(candle_rows(spark, sf), FLAGS)


@query
def wt_candle_overlap(spark, sf):
    """Weights from the stored coefficients, with their distance from the optimum on these rows."""
    rows = training.add_recency_weight(candle_rows(spark, sf))
    out = training.candle_overlap(rows, candles.WEIGHT_FLAGS, "sample_weight", coefficients=tables()["candle_overlap"])
    return out.withColumns({x: rounded(c(x), 6) + 0.0 for x in ("fit_weight", "residual")})


@query
def wt_candle_overlap_fit(spark, sf):
    rows = training.add_recency_weight(candle_rows(spark, sf))
    return training.candle_overlap(rows, candles.WEIGHT_FLAGS, "sample_weight")


@query
def wt_candle_compare(spark, sf):
    pairs = {"hammer": ("hammer_basic", "hammer"), "engulfing": ("engulfing", "engulfing_confirmed")}
    return training.candle_compare(training.candle_marginals(candle_rows(spark, sf), FLAGS), pairs)


PREP = ("signal_score", "score_trend", "score_setup", "feature_close_vs_prev_high_pct", "feature_gap_pct", "feature_range_vs_atr", "feature_gap_sequence_risk")


@query
def md_feature_prep(spark, sf):
    out = models.prepare(outcomes(spark, sf), PREP)
    return out.select("feature", *[rounded(c(x), 6).alias(x) for x in ("median", "mean", "std")])


def _scored(spark, sf, kind, **params):
    rows = st_rows(spark, sf)
    fitted = models.fit(rows, "st_hit_target_7d", SCORES, kind, weight="sample_weight", **params)
    return fitted.score(rows, "probability_calibrated").select(*K, "st_hit_target_7d", "probability_calibrated")


@query
def md_logistic_fit(spark, sf):
    return _scored(spark, sf, "logistic")


@query
def md_rf_fit(spark, sf):
    return _scored(spark, sf, "random_forest")


@query
def md_gbt_fit(spark, sf):
    return _scored(spark, sf, "gbt")


@query
def md_margin_fit(spark, sf):
    return _scored(spark, sf, "margin")


def _stored(spark, sf, kind):
    p = stored.probability(tables()["short_term"][kind])
    return st_rows(spark, sf).select(*K, "st_hit_target_7d", rounded(p, 6).alias("probability_calibrated"))


@query
def md_logistic(spark, sf):
    """Calibrated probabilities from the stored parameter table, like the next three."""
    return _stored(spark, sf, "logistic")


@query
def md_margin(spark, sf):
    return _stored(spark, sf, "margin")


@query
def md_rf(spark, sf):
    return _stored(spark, sf, "random_forest")


@query
def md_gbt(spark, sf):
    return _stored(spark, sf, "gbt")


@query
def md_gradient(spark, sf):
    """Gradients of the penalised losses at the stored logistic coefficients, short-term and all four stop-risk targets: zero where the rows are those they were fitted to."""
    parts = [stored.gradient(st_rows(spark, sf), tables()["short_term"]["logistic"], "st_hit_target_7d", "sample_weight").withColumn("target", F.lit("st_hit_target_7d"))]
    known = full_horizon(spark, sf)
    parts += [stored.gradient(known, tables()["stop_risk"][t], t).withColumn("target", F.lit(t)) for t in stoprisk.TARGETS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("target", "column", "train_rows", "positives", (rounded(c("gradient"), 6) + 0.0).alias("gradient"))


@query
def md_isotonic(spark, sf):
    """Calibration steps of a single score."""
    rows = st_rows(spark, sf).withColumn("p", c("signal_score") / 100.0)
    steps = models.isotonic_steps(rows, "p", "st_hit_target_7d")
    return rows.select(*K, rounded(stoprisk.step_calibration(c("p"), steps), 6).alias("calibrated"))


def full_horizon(spark, sf):
    return outcomes(spark, sf).filter(c("bars_available") >= Outcome().horizon)


@query
def md_stop_risk(spark, sf):
    """All four targets from the stored parameter tables, in one pass."""
    risks = {name: rounded(stored.probability(tables()["stop_risk"][target]), 4) for target, name in stoprisk.TARGETS.items()}
    return full_horizon(spark, sf).select(*K, *[v.alias(k) for k, v in risks.items()])


@query
def md_stop_risk_fit(spark, sf):
    """Four targets from the scores-only feature set, fitted to signals whose whole horizon is known."""
    rows = rescored_outcomes(spark, sf)
    out = rows
    for target, name in stoprisk.TARGETS.items():
        out = models.fit(rows, target, stoprisk.FEATURE_SETS["scores_only"]).score(out, name)
    return out.select(*K, *stoprisk.TARGETS.values())


@query
def md_stop_risk_presets(spark, sf):
    """Every preset, with and without families: rows, positives and whether the fit is the optimum of its penalised loss."""
    rows = rescored_outcomes(spark, sf)
    facts = []
    for preset, features in stoprisk.FEATURE_SETS.items():
        for families in (True, False):
            facts.append((preset, families, *models.optimality(rows, "stop_before_target", features, families)))
    return spark.createDataFrame(facts, "preset string, families boolean, train_rows long, positives long, at_optimum boolean")


@query
def md_logistic_optimum(spark, sf):
    """Rows, positives and whether the short-term logistic fit is the optimum of its penalised loss."""
    facts = models.optimality(st_rows(spark, sf), "st_hit_target_7d", SCORES, True, "sample_weight")
    return spark.createDataFrame([facts], "train_rows long, positives long, at_optimum boolean")


def catalyst_rows(spark, sf):
    return catalytic(spark, sf).join(outcomes(spark, sf).select(*K, "win_flag"), list(K))


@query
def md_cat_ridge(spark, sf):
    """The stored catalyst coefficients, capped, with coverage and their distance from the optimum on these rows."""
    out = models.ridge_residuals(catalyst_rows(spark, sf), tables()["catalyst"], "win_flag")
    return out.select("feature", rounded(c("coverage"), 6).alias("coverage"), rounded(F.least(F.greatest(c("coefficient"), F.lit(-4.0)), F.lit(4.0)), 2).alias("coefficient"), (rounded(c("residual"), 6) + 0.0).alias("residual"))


@query
def md_cat_ridge_fit(spark, sf):
    return models.catalyst_ridge(catalyst_rows(spark, sf), CATALYST_FEATURES, baseline=CATALYST_WEIGHTS)
