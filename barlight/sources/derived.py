"""Stand-in market tables derived from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OHLCV bar per (ticker, date); the grouping pre-aggregates before its shuffle, whatever the key skew."""
    daily = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
        .agg(
            F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
            F.sum("l_quantity").alias("v"),
            F.max("l_discount").alias("hi"),
            F.max("l_tax").alias("lo"),
        )
        .withColumn("ticker", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
        .drop("l_suppkey")
        .repartition("ticker")
    )
    ordered = Window.partitionBy("ticker").orderBy("date")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one time order for all windows: one sort
    z = (F.col("p") - F.avg("p").over(whole)) / F.nullif(F.stddev_samp("p").over(whole), F.lit(0.0))
    step = 0.02 * F.coalesce(z, F.lit(0.0)) + 0.0005
    close = lambda last: 100 * F.exp(F.sum("_step").over(ordered.rowsBetween(Window.unboundedPreceding, last)))
    return (
        daily.withColumn("_step", step)
        .withColumns({"close": close(0), "_before": close(-1)})
        .withColumn("open", F.coalesce("_before", "close") * (1 + (F.col("lo") - 0.04) / 10))
        .select(
            "date",
            "ticker",
            F.round("open", 4).alias("open"),
            F.round(F.greatest("open", "close") * (1 + F.col("hi") / 10), 4).alias("high"),
            F.round(F.least("open", "close") * (1 - F.col("lo") / 10), 4).alias("low"),
            F.round("close", 4).alias("close"),
            (F.col("v") * 100).alias("volume"),
        )
    )
