"""Report views over signals and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlight.config import COVERAGE, Backtest, Outcome
from barlight.functions.columns import rounded
from barlight.operators import outcomes as oc, positions

c = F.col


def last_months(signals: DataFrame, months: int, column: str = "signal_date") -> DataFrame:
    if months <= 0:
        return signals
    return signals.filter(c(column) >= F.add_months(signals.agg(F.max(column)).scalar(), -months))


def coverage(detections: DataFrame, bars: DataFrame, saved: DataFrame, cfg: Outcome = COVERAGE, threshold: float = 80.0) -> DataFrame:
    """Detections that reached the target with the best saved signal of the day and family, and whether it was recognised.

    Column pending_count carries the number of detections still open.
    """
    t = oc.coverage_target(oc.touches(detections, bars, cfg), cfg)
    keys = ["signal_date", "ticker", "pattern_family"]
    best = saved.groupBy(*keys).agg(F.max("signal_score").alias("saved_score"))
    open_count = t.agg(F.count_if(c("is_pending"))).scalar()
    return t.filter(c("is_breakout")).join(best, keys, "left").withColumns(
        {
            "captured": c("saved_score").isNotNull(),
            "recognised": F.coalesce(c("saved_score") >= threshold, F.lit(False)),
            "pending_count": open_count,
        }
    )


def latest_per_ticker(signals: DataFrame, score: str, prefix: str) -> DataFrame:
    best = F.max_by(F.struct(c(score).alias("s"), c("signal_date").alias("d")), F.struct("signal_date", score))
    return signals.groupBy("ticker").agg(best.alias("b")).select("ticker", c("b.s").alias(f"{prefix}_score"), c("b.d").alias(f"{prefix}_signal_date"))


def universe_scores(universe: DataFrame, long_term: DataFrame, short_term: DataFrame, score_lt: str = "signal_score", score_st: str = "st_score") -> DataFrame:
    lt, st = latest_per_ticker(long_term, score_lt, "lt"), latest_per_ticker(short_term, score_st, "st")
    out = universe.join(lt, "ticker", "left").join(st, "ticker", "left")
    as_of = out.agg(F.greatest(F.max("lt_signal_date"), F.max("st_signal_date"))).scalar()
    return out.withColumns(
        {
            "has_lt_signal": c("lt_score").isNotNull(), "has_st_signal": c("st_score").isNotNull(), "as_of_date": as_of,
            "lt_score": rounded(F.coalesce("lt_score", F.lit(0.0)), 1), "st_score": rounded(F.coalesce("st_score", F.lit(0.0)), 1),
        }
    )


def default_long_term(signals: DataFrame, bars: DataFrame, months: int = 24, min_score: float = 80.0, days: int = 60) -> DataFrame:
    picked = positions.lab_stop(last_months(signals, months), "structure_atr", 9.0, structure_buffer=2.5).filter(c("signal_score") >= min_score)
    view = positions.value(oc.track(picked, bars, Backtest(target_pct=6.0, stop_pct=9.0)))
    return positions.within_days(view, days)


def default_short_term(signals: DataFrame, bars: DataFrame, as_of: Column, months: int = 24, min_score: float = 10.0, days: int = 7, score: str = "st_score") -> DataFrame:
    picked = last_months(signals, months).filter((c(score) >= min_score) | (c("signal_date") >= F.date_sub(as_of, 7)))
    view = positions.value(oc.track(positions.confluence_stop(picked), bars, Backtest(target_pct=3.0, stop_pct=2.0)))
    return positions.within_days(view, days)


def daily_alert(signals: DataFrame, exits: DataFrame, day: Column, threshold: float, score: str = "signal_score") -> DataFrame:
    """Entries of *day* at or above the threshold and exits of *day*, as one list."""
    entries = signals.filter((c("signal_date") == day) & (c(score) >= threshold)).select(
        F.lit("entry").alias("kind"), "ticker", "pattern", rounded(c(score), 0).alias("score"), "entry_price", c("stop_price").alias("exit_price"),
        F.lit(None).cast("double").alias("return_pct"),
    )
    done = exits.filter(c("sell_signal_date") == day).select(
        F.lit("exit").alias("kind"), "ticker", "pattern", F.lit(None).cast("double").alias("score"), "entry_price", c("sell_price").alias("exit_price"),
        c("realized_return_pct").alias("return_pct"),
    )
    return entries.unionByName(done)


COMPONENTS = ("score_setup", "score_trend", "score_volume", "score_risk", "score_rsi", "ma_slope_bonus")


def case_studies(signals: DataFrame) -> DataFrame:
    """Newest, then best, signal of each ticker with its three strongest and two weakest components."""
    pick = F.max_by(F.struct("signal_date", "pattern_family", "pattern", "signal_score", *COMPONENTS), F.struct("signal_date", "signal_score", "pattern"))
    best = signals.filter(c("signal_score").isNotNull()).groupBy("ticker").agg(pick.alias("b")).select("ticker", "b.*")
    parts = F.array(*[F.struct((-c(x)).alias("o"), F.lit(x).alias("name")) for x in COMPONENTS])
    names = F.transform(F.array_sort(F.filter(parts, lambda p: p["o"].isNotNull())), lambda p: p["name"])
    return best.select(
        "ticker", "signal_date", "pattern_family", "signal_score", F.array_join(F.slice(names, 1, 3), ",").alias("top"), F.array_join(F.slice(names, -2, 2), ",").alias("weak")
    )
