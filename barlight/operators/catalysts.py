"""Market factors and company events: joins, regimes, score adjustments, re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.functions.columns import as_flag, clip, clip_score, pct_change, rounded

c = F.col


def snap_to_trading_day(events: DataFrame, trading_days: DataFrame, column: str = "event_date") -> DataFrame:
    """Nearest (ties go forward), strictly earlier, and same-or-later trading day of each date.

    Only distinct dates are ordered, so the sequential step is bounded by the calendar whatever the event count.
    """
    marks = trading_days.select(c("date").alias("d")).distinct().withColumn("open", F.lit(1))
    wanted = events.select(c(column).alias("d")).distinct().withColumn("open", F.lit(0))
    days = marks.unionByName(wanted).groupBy("d").agg(F.max("open").alias("open"))
    day = F.when(c("open") == 1, c("d"))
    earlier = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    marked = days.withColumns({"before": F.max(day).over(earlier), "after": F.min(day).over(later)})
    nearest = (
        F.when(c("after").isNull(), c("before"))
        .when(c("before").isNull() | (c("after") == c("d")), c("after"))
        .when(F.datediff("d", "before") < F.datediff("after", "d"), c("before"))
        .otherwise(c("after"))
    )
    table = marked.select(c("d").alias(column), nearest.alias("nearest"), "before", "after")
    return events.join(table, column, "left").withColumn("nearest", F.coalesce("nearest", column))


def derive_factors(factors: DataFrame) -> DataFrame:
    """Row-based changes of the daily factor table (one row per date: bounded by the calendar)."""
    by_date = Window.orderBy("date")
    change = lambda col, n: pct_change(c(col), F.lag(col, n).over(by_date))
    return factors.withColumns(
        {
            "vix_change_1d_pct": change("vix_close", 1),
            "fx_ret_5d_pct": change("fx_close", 5),
            "oil_ret_5d_pct": change("oil_close", 5),
        }
    )


def sector_of(tickers: DataFrame, sectors: DataFrame) -> DataFrame:
    return tickers.join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Other")))


def join_factors(signals: DataFrame, factors: DataFrame) -> DataFrame:
    return signals.join(factors.withColumnRenamed("date", "signal_date"), "signal_date", "left")


def event_windows(signals: DataFrame, calendar: DataFrame, window_days: int = 3) -> DataFrame:
    """Event flags within +-window_days calendar days.

    Every event marks the days around it, marks are reduced per (ticker, day), and signals join by equality: the
    work is linear in events and signals instead of every pair of an instrument.
    """
    offsets = F.sequence(F.lit(-window_days), F.lit(window_days))
    marks = (
        calendar.select("ticker", "event_date", F.lower("event_type").alias("kind"), F.explode(offsets).alias("off"))
        .select("ticker", F.date_add("event_date", c("off")).alias("signal_date"), "kind", "off")
        .groupBy("ticker", "signal_date")
        .agg(
            F.max(c("kind") == "earnings").alias("_earn"),
            F.max(c("kind") == "dividend").alias("_div"),
            F.max(c("off") == 1).alias("_after"),
            F.min(F.abs("off")).alias("_dist"),
        )
    )
    return (
        signals.join(marks, ["ticker", "signal_date"], "left")
        .withColumns(
            {
                "within_earnings_window": as_flag(c("_earn")),
                "within_dividend_window": as_flag(c("_div")),
                "post_event_gap_risk": as_flag(c("_after") & (c("gap_pct") > 2.0)),
                "event_proximity_score": rounded(F.coalesce(1 - c("_dist") / max(1, window_days), F.lit(0.0)), 2),
            }
        )
        .drop("_earn", "_div", "_after", "_dist")
    )


def factor_regimes(factors: DataFrame, window: int = 60, vix_q: float = 0.90, flow_q: float = 0.25, oil_drop_pct: float = -5.0) -> DataFrame:
    """Regime flags per date from the trailing *window* factor rows (no look-ahead)."""
    trailing = Window.orderBy("date").rowsBetween(-(window - 1), 0)
    limits = factors.withColumns(
        {
            "_vix": F.percentile("vix_close", F.lit(vix_q)).over(trailing),
            "_flow": F.percentile("net_flow", F.lit(flow_q)).over(trailing),
            "_oil": pct_change(c("oil_close"), F.lag("oil_close", 1).over(Window.orderBy("date"))),
        }
    )
    return limits.select(
        "date",
        as_flag(c("vix_close") > c("_vix")).alias("vix_regime_high"),
        as_flag(c("net_flow") < c("_flow")).alias("flow_regime_weak"),
        as_flag(c("_oil") < oil_drop_pct).alias("energy_regime_shock"),
    )


def _flag(df: DataFrame, name: str) -> Column:
    return as_flag(c(name)) if name in df.columns else F.lit(False)


def adjust_for_events(signals: DataFrame, earnings: float = 4.0, dividend: float = 2.0, gap: float = 2.0, cap: float = 6.0) -> DataFrame:
    """Capped event adjustment; replaying it first removes the previous one."""
    old = F.coalesce("score_adjustment_catalyst_event", F.lit(0.0)) if "score_adjustment_catalyst_event" in signals.columns else F.lit(0.0)
    base = clip_score(F.coalesce("signal_score", F.lit(0.0)) - old)
    reaction = ((c("score_trend") >= 50) | (c("score_setup") >= 50)) & (c("score_volume") >= 50)
    calm = ~_flag(signals, "vix_regime_high")
    bonus = F.when(_flag(signals, "within_earnings_window") & as_flag(reaction) & calm, earnings).otherwise(0.0) + F.when(
        _flag(signals, "within_dividend_window") & (c("_base") >= 60) & calm, dividend
    ).otherwise(0.0)
    penalty = F.when(_flag(signals, "post_event_gap_risk"), F.lit(gap)).otherwise(F.lit(0.0))
    total = clip(c("score_bonus_catalyst_event") - c("score_penalty_catalyst_event"), -cap, cap)
    return (
        signals.withColumn("_base", base)
        .withColumns({"score_bonus_catalyst_event": bonus, "score_penalty_catalyst_event": penalty})
        .withColumns(
            {
                "signal_score_pre_catalyst_event": rounded(c("_base"), 2),
                "score_adjustment_catalyst_event": rounded(total, 2),
                "signal_score": rounded(clip_score(c("_base") + total), 1),
            }
        )
        .drop("_base")
    )


def market_soft_penalty(signals: DataFrame, vix: float = 0.5, flow: float = 0.25, energy: float = 0.25) -> DataFrame:
    part = lambda name, size: F.when(_flag(signals, name), F.lit(-size)).otherwise(F.lit(0.0))
    total = part("vix_regime_high", vix) + part("flow_regime_weak", flow) + part("energy_regime_shock", energy)
    return signals.withColumn("score_adjustment_mode_market", rounded(total, 2)).withColumn(
        "signal_score", rounded(clip_score(F.coalesce("signal_score", F.lit(0.0)) + c("score_adjustment_mode_market")), 1)
    )


def mid_band_rerank(signals: DataFrame, low: float = 70.0, high: float = 85.0) -> DataFrame:
    base = F.coalesce("signal_score_pre_catalyst_event", "signal_score")
    bonus = F.when((base >= low) & (base < high), c("score_bonus_catalyst_event")).otherwise(F.lit(0.0))
    change = bonus - c("score_penalty_catalyst_event")
    return signals.withColumn("score_adjustment_mode_events", rounded(change, 2)).withColumn(
        "signal_score", rounded(clip_score(base + c("score_adjustment_mode_events")), 1)
    )


def rank_by_mode(signals: DataFrame, mode: str) -> DataFrame:
    """Catalyst ranking mode: baseline, market_only, mid_band_event_rerank or market_and_events."""
    if mode == "baseline":
        return signals
    out = signals.withColumn("signal_score_pre_catalyst_mode", c("signal_score"))
    if mode in ("mid_band_event_rerank", "market_and_events"):
        out = mid_band_rerank(out)
    if mode in ("market_only", "market_and_events"):
        out = market_soft_penalty(out)
    return out


def apply_learned_penalties(signals: DataFrame, weights: dict[str, float], cap: float = 8.0) -> DataFrame:
    """Dot product of catalyst columns and learned weights, bounded."""
    total = sum((F.coalesce(c(k).cast("double"), F.lit(0.0)) * v for k, v in sorted(weights.items())), F.lit(0.0))
    return signals.withColumn("catalyst_penalty", rounded(clip(total, -cap, cap), 4)).withColumn(
        "signal_score", rounded(clip_score(c("signal_score") + clip(total, -cap, cap)), 1)
    )
