"""Table schemas and schema alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

BARS = StructType(
    [
        StructField("date", DateType(), False),
        StructField("ticker", StringType(), False),
        *[StructField(x, DoubleType()) for x in ("open", "high", "low", "close", "adj_close", "volume")],
    ]
)
EVENTS = StructType(
    [
        StructField("ticker", StringType()),
        StructField("event_date", DateType()),
        StructField("event_type", StringType()),
        StructField("amount", DoubleType()),
    ]
)


def ensure_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """Project to *schema*: missing columns become null, the rest are coerced."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )
