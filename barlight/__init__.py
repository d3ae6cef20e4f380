"""barlight: market-signal analytics expressed as Spark DataFrame operators."""
