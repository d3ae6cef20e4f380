"""Incremental detection and position tracking over arriving bars.

Each micro-batch writes its own folder (batch=<id>), so a retried batch overwrites itself and the merge by batch number
is idempotent. Nothing is kept in Python: history, signals and open positions are tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlight.config import COVERAGE_SCAN, Backtest, Detection
from barlight.operators import outcomes as oc, patterns
from barlight.operators.indicators import feature_table
from barlight.streaming.monthstore import MonthStore

c = F.col
# The longest plain window of the feature table (a year of bars and its shift) and the slowest exponential average (Wilder 14 and MACD 26).
LONGEST_WINDOW = 253
SLOWEST_DECAY = 1.0 - 1.0 / 14.0


def lookback_bars(cfg: Detection = COVERAGE_SCAN) -> int:
    """Bars before the first new one that an indicator or detector can still feel.

    Exponential averages fade below double precision; a detector looks back over its own window on top of the indicators' reach.
    """
    fade = math.ceil(math.log(2.0**-53) / math.log(SLOWEST_DECAY))
    return max(LONGEST_WINDOW, fade) + max(cfg.breakout_days, cfg.base_lookback) + 2 * cfg.pivot_span + 1


@dataclass(frozen=True)
class Store:
    """A table made of one folder per micro-batch."""

    spark: SparkSession
    path: str

    def put(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, schema, upto: int | None = None, only: int | None = None) -> DataFrame:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        rows = self.spark.read.schema(f"{columns}, batch bigint").parquet(self.path)
        if only is not None:
            return rows.filter(c("batch") == only)
        return rows if upto is None else rows.filter(c("batch") <= upto)


def incremental_scan(bar_store: MonthStore, signal_store: Store, cfg: Detection = COVERAGE_SCAN) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: store the new bars, scan only their dates, write their signals."""

    def body(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        bar_store.put(batch, batch_id)
        history = bar_store.history(batch, lookback_bars(cfg), batch_id)
        signals = patterns.scan(feature_table(history, cfg), cfg, context=("bar_no",))
        fresh = batch.select("ticker", c("date").alias("signal_date")).distinct()
        signal_store.put(signals.drop("bar_no").join(fresh, ["ticker", "signal_date"], "left_semi"), batch_id)

    return body


POSITION = ("ticker", "signal_date", "pattern", "entry_price", "stop_price", "hold_to_target_only")


def advance_positions(open_positions: DataFrame, bars: DataFrame, cfg: Backtest = Backtest(), expire_days: int | None = None) -> DataFrame:
    """Open positions after the given new bars: status target, stop or (optionally) expired, else holding."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("_last"))
    out = oc.track(oc.locate(open_positions, bars), bars, cfg).join(last, "ticker", "left")
    if expire_days is not None:
        old = (c("status") == "holding") & (F.datediff("_last", "signal_date") > expire_days)
        out = out.withColumns({"exit_date": F.when(old, c("_last")).otherwise(c("exit_date")), "status": F.when(old, "expired").otherwise(c("status"))})
    return out.select(*POSITION, "status", "exit_date", "exit_price")


def track_stream(signals: DataFrame, positions: Store, cfg: Backtest = Backtest(), expire_days: int | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: positions carried from the batch before plus signals not seen yet meet this batch's bars.

    Every batch writes the state it leaves, an empty one the state it found. Signals dated up to the batch's last bar that no batch has opened
    yet are opened, those dated between two deliveries and late ones included; bars delivered before a late signal are not looked at again.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        none = signals.limit(0).select(*POSITION)
        schema = advance_positions(none, batch, cfg, expire_days).schema
        carried, known = none, None
        if batch_id > 0:
            carried = positions.read(schema, only=batch_id - 1).filter(c("status") == "holding")
            known = positions.read(schema, upto=batch_id - 1).select("ticker", "signal_date", "pattern").distinct()
        if batch.isEmpty():
            positions.put(carried.select(schema.fieldNames()) if batch_id > 0 else advance_positions(none, batch, cfg, expire_days), batch_id)
            return
        last = batch.agg(F.max("date").alias("b"))
        fresh = signals.filter(c("signal_date") <= last.scalar()).select(*POSITION)
        if known is not None:
            fresh = fresh.join(known, ["ticker", "signal_date", "pattern"], "left_anti")
        positions.put(advance_positions(carried.select(*POSITION).unionByName(fresh), batch, cfg, expire_days), batch_id)

    return body


def run_available(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
