"""Inputs of the registered queries. Plans are remembered; bars and signal history are also kept as written tables,
as a deployment would keep them between its steps."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlight.config import COVERAGE_SCAN
from barlight.operators import candles, indicators, registry
from barlight.session import durable
from barlight.sources import derived
from barlight.sources.derived import table

REMEMBERED: list[Callable] = []


def plan_once(fn):
    """Remember the plan for each running application and input folder; end_run() forgets it with the tables it reads."""

    @lru_cache(maxsize=64)
    def made(application: str, spark: SparkSession, sf: str) -> DataFrame:
        return fn(spark, sf)

    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return made(spark.sparkContext.applicationId, spark, sf)

    REMEMBERED.append(made.cache_clear)
    return run


def forget() -> None:
    for clear in REMEMBERED:
        clear()


@plan_once
def bars(spark: SparkSession, sf: str) -> DataFrame:
    return derived.derived_bars(spark, sf)


@plan_once
def features(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.feature_table(bars(spark, sf))


@plan_once
def frames(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.frame_columns(indicators.number_bars(bars(spark, sf)))


@plan_once
def candle_bars(spark: SparkSession, sf: str) -> DataFrame:
    return candles.candle_flags(features(spark, sf))


@plan_once
def scan(spark: SparkSession, sf: str) -> DataFrame:
    """The full detection plan, from the raw table to signals."""
    return registry.REGISTERED[0].scan(features(spark, sf), COVERAGE_SCAN)


@plan_once
def stored_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars as the table a deployment keeps: written once, read by everything downstream of detection."""
    return durable(bars(spark, sf))


@plan_once
def kept_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table over the stored bars, whose longest history is known."""
    kept = stored_bars(spark, sf)
    return indicators.feature_table(kept, longest=indicators.longest_history(kept))


STATE_FEATURES = ("ticker", "date", "open", "high", "low", "close", "sma20", "sma50", "sma200", "prev20_close", "ret_20", "rsi_full")


@plan_once
def stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """What states and breadth read of the feature table, as a deployment keeps it next to the bars; other features are never computed for it."""
    return durable(kept_features(spark, sf).select(*STATE_FEATURES))


@plan_once
def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Stored signal history: the stored bars' detection result as a written table."""
    return durable(registry.REGISTERED[0].scan(kept_features(spark, sf), COVERAGE_SCAN))


@plan_once
def factors(spark: SparkSession, sf: str) -> DataFrame:
    """Daily market factors: one row per order date."""
    price = F.col("o_totalprice")
    return (
        table(spark, sf, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(
            F.round(10 + F.avg(price) / 20000 + 1e-9, 4).alias("vix_close"),
            F.round(70 + F.min(price) / 50000 + 1e-9, 4).alias("fx_close"),
            F.round(50 + F.max(price) / 10000 + 1e-9, 4).alias("oil_close"),
            F.round(F.sum(F.when(F.col("o_orderstatus") == "F", price).otherwise(-price)) / 1000 + 1e-7, 2).alias("net_flow"),
        )
    )


@plan_once
def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Company events as a hand-kept list: every shipment, untidy type names, load order in seq."""
    kind = F.when(F.col("l_returnflag") == "R", " Earning ").when(F.col("l_returnflag") == "A", "DIV").otherwise("split")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit(" s"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.to_date("l_shipdate").alias("event_date"),
        kind.alias("event_type"),
        F.col("l_discount").alias("amount"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


@plan_once
def calendar(spark: SparkSession, sf: str) -> DataFrame:
    from barlight.sources.readers import normalise_manual_events

    return normalise_manual_events(raw_events(spark, sf), "seq")


@plan_once
def trading_days(spark: SparkSession, sf: str) -> DataFrame:
    """Weekdays with at least one order."""
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(day.alias("date")).filter(F.weekday("date") < 5).distinct()
