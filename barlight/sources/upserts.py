"""Keyed merges and sinks. Duplicates collapse map-side, so a key with many copies never gathers in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _keep(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    rest = [x for x in df.columns if x not in keys]
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_r"))
    return kept.select(*keys, "_r.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest *order* per key (order must be unique within a key)."""
    return _keep(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _keep(df, keys, order, F.min_by)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str = "load_seq", keep: str = "last") -> DataFrame:
    """Union of both tables, columns aligned by name, one row per key."""
    both = stored.unionByName(incoming, allowMissingColumns=True)
    return (keep_last if keep == "last" else keep_first)(both, keys, order)


BUY_KEYS = ["signal_date", "ticker", "pattern"]
SELL_KEYS = ["buy_signal_date", "ticker", "pattern"]
BAR_KEYS = ["date", "ticker"]


def merge_factors(factors: DataFrame, flows: DataFrame) -> DataFrame:
    """Full outer join by date; the incoming flow wins over the stored one."""
    new = flows.select("date", F.col("net_flow").alias("_new"))
    return factors.join(new, "date", "full_outer").withColumn("net_flow", F.coalesce("_new", "net_flow")).drop("_new")


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """CSV or Parquet by suffix; Parquet may be partitioned for pruning.

    Rows are rebalanced on the partition column first: few files per value, and a large value is split over tasks.
    """
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    elif partition_by:
        df.hint("rebalance", F.col(partition_by)).write.mode("overwrite").partitionBy(partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
