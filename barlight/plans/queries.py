"""Registry of named queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Register *fn* under its own name; whole numbers leave as long."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = fn(spark, sf)
        ints = {f.name: F.col(f"`{f.name}`").cast("long") for f in df.schema.fields if isinstance(f.dataType, IntegerType)}
        return df.withColumns(ints) if ints else df

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from barlight.plans import q_learn, q_market, q_outcome, q_score, q_signal, q_source, q_stream, q_walk  # noqa: F401

    return dict(QUERIES)
