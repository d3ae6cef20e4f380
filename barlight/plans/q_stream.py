"""Queries that replay the given tables as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barlight.operators import patterns, positions
from barlight.plans import inputs
from barlight.plans.queries import query
from barlight.session import run_folder
from barlight.sources.upserts import keep_last
from barlight.streaming.bars import run_to_table, ticks_to_bars
from barlight.streaming.incremental import Store, incremental_scan, run_available
from barlight.streaming.monthstore import MonthStore
from barlight.streaming.positions import OUTPUT, bar_events, run_tracking, signal_events

c = F.col
K = ("ticker", "signal_date", "pattern")


def _folder(spark):
    return f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"


@query
def str_bars(spark, sf):
    """The events table as a tick stream: bars of the days the watermark has closed."""
    schema = inputs.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    ticks = events.select(
        F.concat(F.lit("U"), c("user_id").cast("string")).alias("ticker"), c("ts").cast("timestamp").alias("ts"), c("event_id").alias("tick_id"), c("value").alias("price")
    )
    home = _folder(spark)
    bars = ticks_to_bars(ticks)
    run_to_table(bars, f"{home}/bars", f"{home}/checkpoint")
    return spark.read.schema(bars.schema).parquet(f"{home}/bars")


def _replay(spark, sf, body, home):
    """Bars arrive in two deliveries, each processed by one run of the same job."""
    bars = inputs.stored_bars(spark, sf)
    landing = f"{home}/landing"
    for name, part in {"a": bars.filter(c("date") < "1999-06-01"), "b": bars.filter(c("date") >= "1999-06-01")}.items():
        part.write.parquet(f"{landing}/delivery={name}")
        stream = spark.readStream.schema(bars.schema).parquet(f"{landing}/*")
        run_available(stream.select(*bars.columns), body, f"{home}/checkpoint")


@query
def str_incremental(spark, sf):
    home = _folder(spark)
    store = Store(spark, f"{home}/signals")
    _replay(spark, sf, incremental_scan(MonthStore(spark, f"{home}/bars"), store), home)
    columns = (*patterns.SIGNAL_COLUMNS, "consensus_count")
    rows = store.read(inputs.signals(spark, sf).select(*columns).schema)
    return keep_last(rows, ["signal_date", "ticker", "pattern"], "batch").select(*columns)


@query
def str_open_positions(spark, sf):
    """Bars and signals arrive together in two deliveries; open positions are keyed state between them."""
    home = _folder(spark)
    store = Store(spark, f"{home}/positions")
    signals = positions.hold_flag(positions.lab_stop(inputs.signals(spark, sf)), "fixed_pct")
    events = bar_events(inputs.stored_bars(spark, sf)).unionByName(signal_events(signals))
    for name, part in {"a": events.filter(c("ts") < "1999-06-01"), "b": events.filter(c("ts") >= "1999-06-01")}.items():
        part.write.parquet(f"{home}/landing/delivery={name}")
        stream = spark.readStream.schema(events.schema).parquet(f"{home}/landing/*").select(*events.columns)
        run_tracking(stream, store.put, f"{home}/checkpoint")
    out = keep_last(spark.read.schema(f"{OUTPUT}, batch bigint").parquet(f"{home}/positions"), list(K), "batch")
    return out.select(*K, "status", "exit_date", F.round(c("exit_price") + 1e-9, 4).alias("exit_price"))
