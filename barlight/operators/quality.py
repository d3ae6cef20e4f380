"""Data quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barlight.functions.columns import rounded

c = F.col


def duplicate_gate(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number of rows that share their key with another row."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    dup = F.coalesce(F.sum(F.when(c("n") > 1, c("n"))), F.lit(0))
    return counts.agg(dup.alias("duplicate_count"), (dup == 0).alias("passed")).withColumn("gate", F.lit(name))


def join_coverage(signals: DataFrame, factors: DataFrame, calendar: DataFrame, market: float = 0.70, events: float = 0.50) -> DataFrame:
    """Share of signals with factors on their date and with an event on their date."""
    days = factors.filter(c("vix_close").isNotNull()).select(c("date").alias("signal_date"), F.lit(True).alias("_m"))
    marks = calendar.select("ticker", c("event_date").alias("signal_date"), F.lit(True).alias("_e")).distinct()
    joined = signals.join(days, "signal_date", "left").join(marks, ["ticker", "signal_date"], "left")
    share = lambda x: F.avg(c(x).isNotNull().cast("double"))
    return joined.agg(
        rounded(share("_m") * 100.0, 2).alias("market_coverage_pct"), (share("_m") >= market).alias("market_passed"),
        rounded(share("_e") * 100.0, 2).alias("event_coverage_pct"), (share("_e") >= events).alias("event_passed"),
    )


def leakage(signals: DataFrame, calendar: DataFrame, window_days: int = 3) -> DataFrame:
    """Attached (signal, event) pairs whose event is dated after the signal, found through the event window.

    Each event marks the days around it, so the join stays an equality and its output linear in events.
    """
    off = F.sequence(F.lit(-window_days), F.lit(window_days))
    marks = calendar.select("ticker", "event_date", F.explode(off).alias("o")).select(
        "ticker", F.date_add("event_date", c("o")).alias("signal_date"), (c("o") < 0).alias("future")
    )
    per_day = marks.groupBy("ticker", "signal_date").agg(F.count("*").alias("n"), F.count_if("future").alias("f"))
    hits = signals.join(per_day, ["ticker", "signal_date"])
    future = F.coalesce(F.sum("f"), F.lit(0))
    return hits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("attached_events"), future.alias("future_event_count"), (future == 0).alias("passed"))
