"""Queries over indicators, detectors and candle shapes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from barlight.config import COVERAGE_SCAN
from barlight.functions.columns import lagged, rounded
from barlight.operators import candles, indicators, patterns, scoring
from barlight.plans import inputs
from barlight.plans.queries import QUERIES, query

c = F.col


def _indicator(name: str, *cols: str, exact: tuple = (), source: str = "frames"):
    def run(spark, sf):
        df = getattr(inputs, source)(spark, sf)
        return df.select("ticker", "date", *exact, *[rounded(c(x), 6).alias(x) for x in cols])

    run.__name__ = name
    query(run)


_indicator("ind_sma", "sma20", "sma50", "sma200", "vol_avg20")
_indicator("ind_prev_high_close", "prev_high_close")
_indicator("ind_swing_low", "swing_low10")
_indicator("ind_prev_high_high", "high20")
_indicator("ind_true_range_atr", "tr", "atr14")
_indicator("ind_bollinger", "sma20", "bb_upper", "bb_lower", "bb_width", "bb_width_min")
_indicator("ind_vwap", "vwap")
_indicator("ind_ma_slope", "sma50_slope_pct")
_indicator("ind_returns", "ret_1", "ret_3", "ret_5", "ret_20", "ret_60")
_indicator("ind_dist_52w_high", "high252", "dist_52w_high_pct")
_indicator("ind_gap_range", "gap_pct", "range_vs_atr", "prev_gap_pct", "prev_range_vs_atr")
_indicator("ind_ema", "ema12", "ema26", "ema20", source="features")
_indicator("ind_macd", "macd", "signal9", "macd_prev", "signal9_prev", source="features")
FEATURE_REPORT = (
    "sma20", "sma50", "sma200", "vol_avg20", "prev_high_close", "swing_low10", "high20", "atr14", "macd", "signal9", "rsi",
    "bb_upper", "bb_width", "bb_width_min", "vwap", "sma50_slope_pct", "gap_pct", "range_vs_atr",
)
_indicator("ind_feature_table", *FEATURE_REPORT, exact=("bar_no", "squeeze_recent", "pivot_high", "pivot_low"), source="features")


@query
def ind_lag(spark, sf):
    f = inputs.features(spark, sf)
    return f.select(
        "ticker", "date", "close_prev1", "open_prev1", rounded(c("prev_gap_pct"), 6).alias("prev_gap_pct"),
        rounded(c("macd_prev"), 6).alias("macd_prev"), rounded(c("rsi_prev"), 6).alias("rsi_prev"),
        rounded(lagged("bb_width", 2), 6).alias("bb_width_lag2"), lagged("close", 5).alias("close_prev5"),
    )


@query
def ind_rsi_wilder(spark, sf):
    f = indicators.recursive_columns(indicators.number_bars(inputs.bars(spark, sf)))
    latest = F.when(c("bar_no") >= 15, rounded(indicators.wilder_rsi(zero_loss=100.0), 2))
    epsilon = F.when(c("avg_loss") > 0, rounded(c("rsi_full"), 6)).otherwise(F.lit(100.0))
    return f.select(
        "ticker", "date", rounded(c("rsi"), 6).alias("rsi_null_on_zero_loss"), rounded(c("rsi_full"), 6).alias("rsi_full"),
        latest.alias("rsi_latest"), epsilon.alias("rsi_epsilon"),
    )


@query
def ind_pivots(spark, sf):
    f = inputs.frames(spark, sf).filter(c("pivot_high") | c("pivot_low"))
    return f.select("ticker", "date", "bar_no", "high", "low", "pivot_high", "pivot_low")


@query
def ind_next_open_entry(spark, sf):
    return inputs.frames(spark, sf).select("ticker", "date", c("next_open").alias("entry_price"))


def _detector(name: str, family: str):
    def run(spark, sf):
        return patterns.detect(inputs.features(spark, sf), (family,), COVERAGE_SCAN)

    run.__name__ = name
    query(run)


for _name, _family in {"pat_b_pullback": "B", "pat_c_macd": "C", "pat_d_rsi": "D", "pat_e_squeeze": "E", "pat_f_vwap": "F", "pat_g_vcp": "G"}.items():
    _detector(_name, _family)


@query
def pat_a_breakout(spark, sf):
    """All three stop modes side by side."""
    f = inputs.features(spark, sf)
    parts = [
        patterns.detect(f, ("A",), replace(COVERAGE_SCAN, stop_mode=mode)).withColumn("stop_mode", F.lit(mode))
        for mode in ("fixed_pct", "atr", "structure_atr")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def pat_a_lt(spark, sf):
    f = inputs.features(spark, sf)
    parts = [patterns.detect_long_term(f, COVERAGE_SCAN, vectorised=v).withColumn("vectorised", F.lit(v)) for v in (True, False)]
    return parts[0].unionByName(parts[1])


@query
def pat_multi(spark, sf):
    return inputs.scan(spark, sf).select(*patterns.SIGNAL_COLUMNS, "consensus_count")


@query
def pat_all_dates(spark, sf):
    out = patterns.scan(inputs.features(spark, sf), COVERAGE_SCAN, context=(), from_date="1999-01-01")
    return out.select(*patterns.SIGNAL_COLUMNS, "consensus_count")


@query
def pat_consensus(spark, sf):
    out = inputs.scan(spark, sf).filter(c("consensus_count") > 1)
    return out.select("signal_date", "ticker", "pattern", "consensus_count", "signal_score")


@query
def pat_combo_key(spark, sf):
    return patterns.combo_key(inputs.scan(spark, sf))


@query
def pat_event_top(spark, sf):
    return patterns.best_per_event(inputs.scan(spark, sf).select(*patterns.SIGNAL_COLUMNS, "consensus_count"))


@query
def vw_family_counts(spark, sf):
    return inputs.scan(spark, sf).groupBy("pattern_family").agg(F.count("*").alias("signals"))


@query
def sc_components(spark, sf):
    return patterns.detect(inputs.features(spark, sf), cfg=COVERAGE_SCAN)


@query
def sc_rsi_sweet_spot(spark, sf):
    return inputs.features(spark, sf).select("ticker", "date", rounded(scoring.rsi_sweet_spot(c("rsi_full")), 1).alias("score_rsi"))


@query
def sc_ma_slope_bonus(spark, sf):
    f = inputs.frames(spark, sf).filter(c("sma50_slope_pct").isNotNull())
    return f.select("ticker", "date", scoring.slope_bonus(c("sma50_slope_pct")).alias("ma_slope_bonus"))


def _candle(shape: str):
    def run(spark, sf):
        return inputs.candle_bars(spark, sf).filter(c(shape)).select("ticker", "date", "open", "high", "low", "close")

    run.__name__ = f"cdl_{shape}"
    query(run)


for _shape in candles.SHAPES:
    if not _shape.startswith("marubozu"):
        _candle(_shape)


@query
def cdl_marubozu(spark, sf):
    return inputs.candle_bars(spark, sf).filter(c("marubozu_basic")).select("ticker", "date", "marubozu_basic", "marubozu")


@query
def cdl_combos(spark, sf):
    keys = inputs.signals(spark, sf).select("signal_date", "ticker", "pattern", "pattern_family")
    out = candles.candle_combos(keys, inputs.candle_bars(spark, sf))
    return out.select("signal_date", "ticker", "pattern", "confirmed_hammer_a", "engulfing_trend_combo", "piercing_variant_b_combo")


@query
def cdl_scan_shapes(spark, sf):
    return candles.scan_shapes(inputs.candle_bars(spark, sf))


@query
def cdl_recent(spark, sf):
    return inputs.candle_bars(spark, sf).select(
        "ticker", "date", candles.in_last("hammer_basic", 2).alias("hammer_recent2"), candles.in_last("morning_star", 2).alias("morning_star_recent2")
    )
