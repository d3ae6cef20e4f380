"""Queries over score components, penalties, regimes, risk and short-term scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.config import SHORT_TERM, Outcome
from barlight.functions.columns import rounded
from barlight.operators import catalysts, markov, models, outcomes as oc, penalties, rescore as chain, scoring, stoprisk, stored, stscore, training
from barlight.plans import inputs
from barlight.plans.parameters import tables
from barlight.plans.queries import query
from barlight.session import durable

c = F.col
K = ("ticker", "signal_date", "pattern")

# Parameters of the demonstration risk model (coefficient per feature, per family, calibration steps).
RISK_COEFFICIENTS = {"signal_score": -0.6, "score_trend": -0.2, "score_volume": 0.1, "score_risk": -0.3, "consensus_count": -0.1}
FAMILY_COEFFICIENTS = {"A": -0.2, "B": 0.1, "C": 0.0, "D": 0.3, "E": 0.2, "F": 0.1, "G": -0.1}
RISK_INTERCEPT = -0.4
RISK_STEPS = [(0.2, 0.08), (0.3, 0.2), (0.35, 0.31), (0.4, 0.42), (0.5, 0.55), (0.7, 0.8)]


@inputs.plan_once
def outcomes(spark, sf):
    """Labelled history, kept as a table."""
    s = inputs.signals(spark, sf)
    return durable(training.training_history(s, inputs.stored_bars(spark, sf)))


@inputs.plan_once
def family_weights(spark, sf):
    return durable(training.family_weights(outcomes(spark, sf)))


@inputs.plan_once
def buckets(spark, sf):
    return durable(training.penalty_buckets(outcomes(spark, sf)))


SHORT_TERM_KINDS = ("logistic", "margin", "random_forest", "gbt")
SCORES = ("signal_score", "score_trend", "score_setup", "score_volume", "score_rsi", "score_risk", "ma_slope_bonus", "consensus_count")


@inputs.plan_once
def st_rows(spark, sf):
    """Short-term labelled signals with a recency weight, kept as a table."""
    s = inputs.signals(spark, sf).drop("target", "stop")
    labelled = oc.model_trade(oc.touches(s, inputs.stored_bars(spark, sf), SHORT_TERM, row_stop=False))
    labelled = labelled.withColumns({"return_pct": rounded(c("return_pct"), 4), "month": F.date_format("signal_date", "yyyy-MM")})
    return durable(training.add_recency_weight(labelled))


@inputs.plan_once
def short_term_models(spark, sf):
    """Fitted models of the short-term blend."""
    return {kind: models.fit(st_rows(spark, sf), "st_hit_target_7d", SCORES, kind, weight="sample_weight") for kind in ("logistic", "margin")}


@inputs.plan_once
def rescored_history(spark, sf):
    """Labelled signals with the columns the rescoring chain adds, kept as a table."""
    scored = chain.rescore(inputs.signals(spark, sf), family_weights(spark, sf), buckets(spark, sf), transitions(spark, sf))
    scored = stoprisk.join_breadth(scored, breadth(spark, sf)).select(*K, *stoprisk.FEATURE_SETS["full"])
    labels = outcomes(spark, sf).select(*K, "month", "pattern_family", "bars_available", *stoprisk.TARGETS)
    return durable(labels.join(scored, list(K)))


def rescored_outcomes(spark, sf):
    """Those of them whose whole horizon is known."""
    return rescored_history(spark, sf).filter(c("bars_available") >= Outcome().horizon).drop("bars_available")


@inputs.plan_once
def stop_risk_model(spark, sf):
    return models.fit(rescored_outcomes(spark, sf), "stop_before_target", stoprisk.FEATURE_SETS["scores_only"])


@inputs.plan_once
def states(spark, sf):
    return inputs.stored_features(spark, sf).select("ticker", "date", markov.state().alias("state"))


@inputs.plan_once
def transitions(spark, sf):
    return durable(markov.train(states(spark, sf)))


@inputs.plan_once
def breadth(spark, sf):
    return stoprisk.breadth(inputs.stored_features(spark, sf))


@query
def sc_family_bonus(spark, sf):
    """Applied twice: the second pass replaces the first."""
    once = scoring.apply_family_bonus(inputs.signals(spark, sf), family_weights(spark, sf))
    return scoring.apply_family_bonus(once, family_weights(spark, sf)).select(*K, "score_pattern", "pattern_bonus", "signal_score")


@query
def sc_lt_health(spark, sf):
    out = scoring.apply_lt_health(inputs.signals(spark, sf))
    return out.select(*K, "signal_score_pre_lt_health", "lt_health_points", "lt_health_bonus", "signal_score")


@query
def ft_recent_count(spark, sf):
    out = penalties.recent_counts(inputs.signals(spark, sf), {f"n{n}": n for n in (5, 10, 20, 40)})
    return out.select(*K, "n5", "n10", "n20", "n40")


@query
def ft_penalty_features(spark, sf):
    return penalties.penalty_features(inputs.signals(spark, sf)).select(*K, *penalties.FEATURES)


def _penalised(spark, sf):
    return penalties.apply_penalties(penalties.penalty_features(inputs.signals(spark, sf)), buckets(spark, sf))


@query
def sc_bucket_penalty(spark, sf):
    return _penalised(spark, sf).select(*K, "score_penalty_crowding", "score_penalty_extension", "score_penalty_gap_shock", "score_penalty_total", "signal_score")


@query
def mk_state(spark, sf):
    return states(spark, sf)


@query
def mk_alias_rows(spark, sf):
    """Suffixed and bare spellings meet on one key."""
    s = states(spark, sf).withColumn("ticker", F.concat("ticker", F.when(F.dayofmonth("date") % 2 == 0, F.lit(".ns")).otherwise(F.lit(" "))))
    return s.select(markov.plain_ticker(c("ticker")).alias("ticker"), "date", "state")


def _regime(spark, sf):
    return markov.adjust(inputs.signals(spark, sf).withColumn("markov_state", markov.state()), transitions(spark, sf))


MARKOV = ("markov_state", "markov_p_continuation", "markov_p_adverse", "score_markov_adjustment", "signal_score_pre_markov", "signal_score")


@query
def mk_adjust(spark, sf):
    return _regime(spark, sf).select(*K, *MARKOV)


@query
def mk_train(spark, sf):
    return markov.train(states(spark, sf))


@query
def rg_breadth(spark, sf):
    return breadth(spark, sf)


@query
def sr_features(spark, sf):
    out = stoprisk.join_breadth(penalties.penalty_features(inputs.signals(spark, sf)), breadth(spark, sf))
    return out.select(*K, *stoprisk.ROW_FEATURES, *stoprisk.REGIME_FEATURES)


def parameters(spark, sf):
    from barlight.operators.models import prepare

    stats = prepare(inputs.signals(spark, sf), tuple(RISK_COEFFICIENTS)).collect()  # one row per feature
    return {r["feature"]: {"median": r["median"], "mean": r["mean"], "std": r["std"], "coefficient": RISK_COEFFICIENTS[r["feature"]]} for r in stats}


def _risk(spark, sf):
    z = stoprisk.model_input(parameters(spark, sf), FAMILY_COEFFICIENTS, RISK_INTERCEPT)
    p = rounded(stoprisk.sigmoid(z), 8)
    out = inputs.signals(spark, sf).withColumn("raw_probability", p)
    return out.withColumn("signal_stop_risk", rounded(stoprisk.step_calibration(c("raw_probability"), RISK_STEPS), 4))


@query
def sr_predict(spark, sf):
    return _risk(spark, sf).select(*K, rounded(c("raw_probability"), 6).alias("raw_probability"), "signal_stop_risk")


@query
def sr_penalty(spark, sf):
    out = stoprisk.apply_risk(_risk(spark, sf))
    return out.select(*K, "signal_stop_risk", "signal_reliability_score", "score_penalty_stop_risk", "score_penalty_stop_risk_gated",
                      "signal_score_pre_stop_risk_penalty", "signal_score")


@query
def st_intraday(spark, sf):
    s = inputs.signals(spark, sf).select(*K)
    return stscore.intraday(s, inputs.stored_bars(spark, sf)).select(*K, "gap_intraday_pct", "volatility_pct")


@query
def st_markov_fill(spark, sf):
    """Half the signals arrive without a state or with zero probabilities."""
    s = inputs.signals(spark, sf).select(
        *K, F.when(c("pattern_family") == "A", F.lit("sideways")).alias("markov_state"),
        F.when(c("pattern_family") == "B", F.lit(0.5)).otherwise(F.lit(0.0)).alias("markov_p_continuation"), F.lit(None).cast("double").alias("markov_p_adverse"),
    )
    probabilities = markov.state_probabilities(transitions(spark, sf))
    return stscore.fill_regime(s, states(spark, sf), probabilities).select(*K, "markov_state", "markov_p_continuation", "markov_p_adverse")


@query
def st_onehot_state(spark, sf):
    out = states(spark, sf)
    return out.select("ticker", "date", *[v.alias(k) for k, v in stscore.one_hot(c("state")).items()], stscore.one_hot_text(c("state")).alias("markov_state_encoded"))


def _probabilities():
    """Calibrated probabilities of the four fitted models, from their stored parameter tables."""
    return {kind: c(f"_p_{kind}") for kind in SHORT_TERM_KINDS}


@inputs.plan_once
def ensemble(spark, sf):
    """Signals with the probabilities of the whole ensemble, scored in one pass and kept as a table."""
    return durable(inputs.signals(spark, sf).withColumns({f"_p_{kind}": stored.probability(tables()["short_term"][kind]) for kind in SHORT_TERM_KINDS}))


@query
def st_blend(spark, sf):
    """Four-way blend, an over-full three-way blend that is rescaled, and a blend with one model missing."""
    p = _probabilities()
    mixes = {
        "four": stscore.blend(p, stscore.blend_weights({"margin": 0.25, "random_forest": 0.25, "gbt": 0.25})),
        "rescaled": stscore.blend({k: p[k] for k in ("logistic", "margin", "random_forest")}, stscore.blend_weights({"margin": 0.8, "random_forest": 0.6})),
        "missing": stscore.blend({k: p[k] for k in ("logistic", "gbt")}, stscore.blend_weights({"margin": 0.25, "random_forest": 0.25, "gbt": 0.25})),
    }
    return ensemble(spark, sf).select(*K, *[rounded(v, 6).alias(f"p_{k}") for k, v in mixes.items()])


def _uplift(spark, sf):
    p = stscore.blend(_probabilities(), stscore.blend_weights({"margin": 0.25, "random_forest": 0.25, "gbt": 0.25}))
    scored = ensemble(spark, sf).withColumn("probability", rounded(p, 6))
    return stscore.rank_uplift(scored.drop(*[f"_p_{kind}" for kind in SHORT_TERM_KINDS]))


@query
def st_rank_uplift(spark, sf):
    return _uplift(spark, sf).select(*K, "st_score_pre_model", rounded(c("blended_score"), 4).alias("blended_score"))


def short_term(spark, sf):
    """Signals with everything the boosters read, and the final short-term score."""
    s = _uplift(spark, sf)
    s = penalties.apply_penalties(penalties.penalty_features(s), buckets(spark, sf))
    s = stscore.intraday(markov.adjust(s.withColumn("markov_state", markov.state()), transitions(spark, sf)))
    return stscore.apply_boosters(stoprisk.join_breadth(s, breadth(spark, sf)))


@query
def st_boosters(spark, sf):
    return short_term(spark, sf).select(*K, *stscore.boosters(), "st_score")


@query
def md_st_features(spark, sf):
    f = stscore.intraday(stscore.forward_momentum(inputs.stored_features(spark, sf)).withColumn("markov_state", markov.state()))
    keep = f.select("ticker", c("date").alias("signal_date"), "markov_state", "gap_intraday_pct", "volatility_pct", "momentum_1d_pct", "momentum_3d_pct", "momentum_5d_pct")
    return inputs.signals(spark, sf).select(*K).join(keep, ["ticker", "signal_date"])


@query
def rescore_history(spark, sf):
    """The chain replayed over its own output."""
    args = (family_weights(spark, sf), buckets(spark, sf), transitions(spark, sf))
    twice = chain.rescore(chain.rescore(inputs.signals(spark, sf), *args), *args)
    return twice.select(*K, "pattern_bonus", "lt_health_bonus", "score_penalty_total", "score_markov_adjustment", "signal_score")


def _stop_risk(spark, sf):
    fit = stop_risk_model(spark, sf)
    return lambda df: stoprisk.apply_risk(fit.score(df, "signal_stop_risk"))


def _short_term_score(spark, sf):
    fits = short_term_models(spark, sf)

    def score(df):
        named = {kind: f"_p_{kind}" for kind in fits}
        for kind, fit in fits.items():
            df = fit.score(df, named[kind])
        mix = stscore.blend({k: c(v) for k, v in named.items()}, stscore.blend_weights({"margin": 0.25, "gbt": 0.25}))
        df = stscore.rank_uplift(df.withColumn("probability", mix).drop(*named.values()))
        return stscore.apply_boosters(stoprisk.join_breadth(stscore.intraday(df), breadth(spark, sf)))

    return score


@query
def rescore_full(spark, sf):
    """The whole chain with fitted stop-risk and short-term models, and whether a replay over its output changes anything."""
    args = (family_weights(spark, sf), buckets(spark, sf), transitions(spark, sf))
    steps = {"stop_risk": _stop_risk(spark, sf), "short_term": _short_term_score(spark, sf)}
    once = durable(chain.rescore(inputs.signals(spark, sf), *args, **steps))
    twice = chain.rescore(once, *args, **steps)
    scores = ("signal_score", "st_score", "signal_stop_risk")
    again = twice.select(*K, *[c(x).alias(f"again_{x}") for x in scores])
    same = lambda x: c(x).eqNullSafe(c(f"again_{x}"))
    known = c("signal_stop_risk").between(0, 1) & c("st_score").between(0, 100) & c("signal_score").between(0, 100)
    return once.join(again, list(K)).select(*K, (same("signal_score") & same("st_score") & same("signal_stop_risk")).alias("replay_equal"), known.alias("in_range"))


# ---- catalysts ----------------------------------------------------------------------------------------------------
@query
def cat_factor_join(spark, sf):
    out = catalysts.join_factors(inputs.signals(spark, sf).select(*K), inputs.factors(spark, sf))
    return out.select(*K, "vix_close", "fx_close", "oil_close", "net_flow")


EVENT_FLAGS = ("within_earnings_window", "within_dividend_window", "post_event_gap_risk", "event_proximity_score")


def eventful(spark, sf):
    s = inputs.signals(spark, sf).drop("gap_pct")
    s = stscore.intraday(s).withColumnRenamed("gap_intraday_pct", "gap_pct")
    return catalysts.event_windows(s, inputs.calendar(spark, sf))


@query
def cat_event_window(spark, sf):
    return eventful(spark, sf).select(*K, *EVENT_FLAGS)


# One learned weight per catalyst column.
CATALYST_WEIGHTS = {
    "vix_regime_high": -1.5, "flow_regime_weak": -0.75, "energy_regime_shock": -3.0, "within_earnings_window": 2.0, "within_dividend_window": 1.0,
    "post_event_gap_risk": -4.0, "event_proximity_score": 0.5,
}
REGIME_FLAGS = ("vix_regime_high", "flow_regime_weak", "energy_regime_shock")
CATALYST_FEATURES = (*REGIME_FLAGS, "within_earnings_window", "within_dividend_window", "post_event_gap_risk", "event_proximity_score")


@query
def cat_regimes(spark, sf):
    return catalysts.factor_regimes(inputs.factors(spark, sf))


def catalytic(spark, sf):
    return catalysts.join_factors(eventful(spark, sf), catalysts.factor_regimes(inputs.factors(spark, sf)))


def adjusted(spark, sf):
    return catalysts.adjust_for_events(catalytic(spark, sf))


@query
def cat_event_adjust(spark, sf):
    out = catalysts.adjust_for_events(adjusted(spark, sf))
    return out.select(*K, "signal_score_pre_catalyst_event", "score_bonus_catalyst_event", "score_penalty_catalyst_event", "score_adjustment_catalyst_event", "signal_score")


@query
def cat_mode_rerank(spark, sf):
    base = adjusted(spark, sf)
    parts = [catalysts.rank_by_mode(base, m).select(*K, F.lit(m).alias("mode"), "signal_score") for m in ("baseline", "market_only", "mid_band_event_rerank", "market_and_events")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def cat_penalty_apply(spark, sf):
    return catalysts.apply_learned_penalties(catalytic(spark, sf), CATALYST_WEIGHTS).select(*K, "catalyst_penalty", "signal_score")


