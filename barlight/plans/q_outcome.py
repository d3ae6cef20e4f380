"""Queries over forward outcomes and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.config import COVERAGE, SHORT_TERM, Backtest, Outcome
from barlight.functions.columns import rounded
from barlight.operators import outcomes as oc, positions
from barlight.plans import inputs
from barlight.plans.queries import query

c = F.col
KEYS = ("ticker", "signal_date", "pattern")


def _touched(spark, sf, cfg=Outcome(), row_stop=True):
    return oc.touches(inputs.signals(spark, sf), inputs.stored_bars(spark, sf), cfg, row_stop)


@query
def ot_family_outcome(spark, sf):
    return oc.forward_outcome(_touched(spark, sf)).select(*KEYS, "pattern_family", "outcome")


@query
def ot_penalty_outcome(spark, sf):
    return oc.forward_outcome(_touched(spark, sf)).filter(c("bars_available") > 0).select(*KEYS, "pattern_family", "outcome")


@query
def ot_forward_30d(spark, sf):
    out = oc.forward_outcome(_touched(spark, sf))
    return out.select(
        *KEYS, "pattern_family", "outcome", "win_flag", "loss_flag", "hold_flag", "bars_available", rounded(c("target"), 6).alias("target_price"),
        rounded(c("stop"), 6).alias("effective_stop_price"), c("target_day").alias("first_target_hit_day"), c("stop_day").alias("first_stop_hit_day"),
    )


@query
def ot_stop_labels(spark, sf):
    out = oc.stop_labels(_touched(spark, sf), 30)
    return out.select(*KEYS, "stop_before_target", "stop_within_5d", "gap_through_stop", "mae_exceeds_stop")


@query
def ot_st_label(spark, sf):
    return oc.st_label(_touched(spark, sf, SHORT_TERM, False)).select(*KEYS, "st_hit_target_7d")


@query
def ot_candle_outcome(spark, sf):
    return oc.forward_outcome(_touched(spark, sf, Outcome(), False)).select(*KEYS, "outcome")


@query
def ot_combo_trade(spark, sf):
    out = oc.combo_trade(_touched(spark, sf))
    return out.select(*KEYS, "trade_status", "trade_exit_date", "trade_exit_price", "trade_days_held", "trade_return_pct")


@query
def ot_model_compare(spark, sf):
    return oc.model_trade(_touched(spark, sf, SHORT_TERM, False)).select(*KEYS, "status", rounded(c("return_pct"), 4).alias("return_pct"), "st_hit_target_7d")


@query
def ot_close_stop(spark, sf):
    return oc.close_stop(_touched(spark, sf, SHORT_TERM, False)).select(*KEYS, "outcome")


@query
def ot_coverage_target(spark, sf):
    out = oc.coverage_target(_touched(spark, sf, COVERAGE))
    return out.select(*KEYS, rounded(c("target"), 4).alias("target_price"), "bars_available", c("target_day").alias("first_target_hit_day"), "is_breakout", "is_pending")


@query
def ot_sell_signal(spark, sf):
    return oc.sell_signals(inputs.signals(spark, sf), inputs.stored_bars(spark, sf))


@query
def ot_tracker(spark, sf):
    out = oc.track(positions.hold_flag(inputs.signals(spark, sf), "score_gt_90_hold_to_target"), inputs.stored_bars(spark, sf))
    return out.select(*KEYS, "hold_to_target_only", "status", "exit_date", rounded(c("exit_price"), 4).alias("exit_price"), "latest_close", "days_held")


def _portfolio(spark, sf):
    return positions.value(oc.track(positions.lab_stop(inputs.signals(spark, sf)), inputs.stored_bars(spark, sf)))


@query
def stop_lab_modes(spark, sf):
    parts = [positions.lab_stop(inputs.signals(spark, sf), m).select(*KEYS, "stop_price", "stop_pct", F.lit(m).alias("mode")) for m in ("fixed_pct", "atr", "structure_atr")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def stop_confluence(spark, sf):
    return positions.confluence_stop(inputs.signals(spark, sf)).select(*KEYS, "stop_price", "stop_pct")


@query
def stop_hold_flag(spark, sf):
    parts = [positions.hold_flag(inputs.signals(spark, sf), m).select(*KEYS, F.lit(m).alias("mode"), "hold_to_target_only")
             for m in ("fixed_pct", "score_gt_90_hold_to_target", "score_gt_95_hold_to_target")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def pos_value(spark, sf):
    return _portfolio(spark, sf).select(*KEYS, "status", "qty", "invested", "current_value", "pnl", "return_pct", "days_held", "exit_date")


@query
def pos_filter_days(spark, sf):
    return positions.within_days(_portfolio(spark, sf), 60).select(*KEYS, "status", "days_held")


@query
def pos_summary(spark, sf):
    return positions.summarize(_portfolio(spark, sf))


@query
def pos_monthly(spark, sf):
    return positions.monthly(_portfolio(spark, sf), 100_000.0)


@query
def pos_yearly(spark, sf):
    return positions.yearly(_portfolio(spark, sf), 100_000.0)


@query
def pos_score_buckets(spark, sf):
    return positions.score_buckets(_portfolio(spark, sf))


@query
def pos_grid(spark, sf):
    return positions.scenario_grid(inputs.signals(spark, sf), inputs.stored_bars(spark, sf), (3.0, 6.0), ("fixed_pct", "structure_atr"), (0.0, 60.0), (1_000.0, 10_000.0))


@query
def pos_quality_gate(spark, sf):
    """Orders as signals on supplier tickers: many fall on days without a bar, some tickers have none."""
    day = F.when(c("o_orderpriority") != "5-LOW", F.to_date("o_orderdate"))
    ticker = F.when(c("o_orderstatus") == "P", F.concat(F.lit("X"), c("o_custkey").cast("string"))).otherwise(F.concat(F.lit("S"), c("o_custkey").cast("string")))
    signals = inputs.table(spark, sf, "orders").select(day.alias("signal_date"), ticker.alias("ticker"))
    audit = positions.quality_audit(signals, inputs.stored_bars(spark, sf))
    return audit.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query
def pos_oos_scope(spark, sf):
    """Scope signals to those with a prediction; predictions repeat per family day."""
    s = inputs.signals(spark, sf)
    predictions = s.filter(c("signal_score") >= 40).select("ticker", "signal_date", "pattern_family", rounded(c("signal_score") / 100, 4).alias("risk"))
    out = positions.out_of_sample_scope(s, predictions.unionByName(predictions), ["ticker", "signal_date", "pattern_family"])
    return out.select(*KEYS, "risk")
