"""Daily bars from a tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

c = F.col


def ticks_to_bars(ticks: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tumbling-day OHLCV bars. Columns in: ticker, ts, tick_id, price.

    Ticks later than *delay* are dropped. The aggregation is partial before its shuffle, so one busy instrument does
    not gather its ticks in one task, and the state holds one row per open (ticker, day).
    """
    first = F.struct("ts", "tick_id")
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("ticker", F.window("ts", "1 day"))
        .agg(
            F.min_by("price", first).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", first).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        .select(F.to_date("window.start").alias("date"), "ticker", "open", "high", "low", "close", "volume")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append finished rows to a table and stop when the available input is used up."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
