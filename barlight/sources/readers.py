"""Readers and normalisers: bars, provider payloads, exchange files, flows, universe lists, event calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlight.config import BENCHMARK_TICKERS
from barlight.functions.columns import number
from barlight.schema import BARS
from barlight.sources.upserts import keep_last

# Column and key aliases used by the providers, in order of preference.
EXCHANGE_ALIASES = {
    "symbol": ("SYMBOL",),
    "series": ("SERIES",),
    "open": ("OPEN_PRICE", "OPEN"),
    "high": ("HIGH_PRICE", "HIGH"),
    "low": ("LOW_PRICE", "LOW"),
    "close": ("CLOSE_PRICE", "CLOSE"),
    "volume": ("TTL_TRD_QNTY", "TOTTRDQTY", "TOTTRD_QTY", "VOLUME"),
}
NET_KEYS = ("netValue", "net", "netCash", "fiiNet", "diiNet", "fiiNetValue", "diiNetValue")
BUY_KEYS = ("buyValue", "buy", "fiiBuyValue", "diiBuyValue")
SELL_KEYS = ("sellValue", "sell", "fiiSellValue", "diiSellValue")
DATE_KEYS = ("date", "Date", "tradeDate", "tradedDate")
DATE_PATTERNS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
}
EVENT_SYNONYMS = {"earning": "earnings", "div": "dividend", "dividends": "dividend"}
EVENT_TYPES = ("earnings", "dividend")
QUOTE_PAYLOAD = (
    "ticker string, timestamp array<bigint>, open array<double>, high array<double>, low array<double>, "
    "close array<double>, volume array<double>, adjclose array<double>"
)


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars from CSV or Parquet with an explicit schema; the benchmark instrument is dropped."""
    reader = spark.read.schema(BARS)
    raw = reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
    return normalise_bars(raw)


def normalise_bars(raw: DataFrame) -> DataFrame:
    missing = {"date", "ticker", "open", "high", "low", "close", "volume"} - set(raw.columns)
    if missing:
        raise ValueError(f"bars lack required columns: {sorted(missing)}")
    numeric = {x: F.col(x).try_cast("double") for x in ("open", "high", "low", "close", "adj_close", "volume") if x in raw.columns}
    ticker = F.trim("ticker")
    return raw.withColumns({"date": F.col("date").try_cast("date"), "ticker": ticker, **numeric}).filter(
        ~F.upper(ticker).isin(*BENCHMARK_TICKERS)
    ).dropna(subset=["date", "ticker", "open", "high", "low", "close"])


def parse_quotes(payloads: DataFrame, column: str = "payload", benchmarks: tuple = BENCHMARK_TICKERS) -> DataFrame:
    """Provider payload of parallel arrays to one row per bar."""
    doc = F.from_json(column, QUOTE_PAYLOAD)
    rows = payloads.select(doc.alias("d")).select(
        "d.ticker",
        F.col("d.adjclose").isNull().alias("_no_adj"),
        F.explode(
            F.arrays_zip(*[F.col(f"d.{x}").alias(x) for x in ("timestamp", "open", "high", "low", "close", "volume")],
                         F.coalesce("d.adjclose", F.transform("d.timestamp", lambda _: F.lit(None).cast("double"))).alias("adjclose"))
        ).alias("b"),
    )
    volume = F.when(F.col("ticker").isin(*benchmarks), F.coalesce("b.volume", F.lit(0.0))).otherwise(F.col("b.volume"))
    return rows.select(
        F.to_date(F.timestamp_seconds("b.timestamp")).alias("date"),
        "ticker", "b.open", "b.high", "b.low", "b.close",
        F.coalesce("b.adjclose", "b.close").alias("adj_close"), volume.alias("volume"),
    ).dropna(subset=["open", "high", "low", "close"])


def normalise_exchange_file(raw: DataFrame, universe: DataFrame, suffix: str = ".NS") -> DataFrame:
    """Daily exchange file: first alias present wins, series EQ only, members of *universe* (column symbol) only."""
    headers = {x.strip().upper(): x for x in raw.columns}
    found = {k: next((headers[a] for a in names if a in headers), None) for k, names in EXCHANGE_ALIASES.items()}
    if any(v is None for v in found.values()):
        raise ValueError(f"exchange file lacks {[k for k, v in found.items() if v is None]}")
    text = {k: F.upper(F.trim(F.col(f"`{found[k]}`"))) for k in ("symbol", "series")}
    values = {k: F.trim(F.col(f"`{found[k]}`")).try_cast("double") for k in ("open", "high", "low", "close", "volume")}
    rows = raw.select("date", *[v.alias(k) for k, v in {**text, **values}.items()])
    return (
        rows.filter(F.col("series") == "EQ")
        .join(universe.select("symbol").distinct(), "symbol", "left_semi")
        .dropna(subset=list(values))
        .select("date", F.concat("symbol", F.lit(suffix)).alias("ticker"), *values, F.col("close").alias("adj_close"))
    )


def parse_any_date(text: Column) -> Column:
    """First format that matches, else Spark's own date cast. Each parse is guarded by its shape."""
    s = F.trim(text)
    parsed = [F.when(s.rlike(shape), F.to_date(F.try_to_timestamp(s, F.lit(fmt)))) for fmt, shape in DATE_PATTERNS.items()]
    return F.coalesce(*parsed, s.try_cast("date"))


def parse_flows(records: DataFrame, column: str = "record") -> DataFrame:
    """Heterogeneous flow records (one JSON object each) to one net value per date."""
    m = F.col("_m")
    value = lambda key: number(F.element_at(m, F.lit(key)))
    first = lambda keys: F.coalesce(*[value(k) for k in keys])
    dates = F.coalesce(*[parse_any_date(F.element_at(m, F.lit(k))) for k in DATE_KEYS])
    net = F.coalesce(first(NET_KEYS), first(BUY_KEYS) - first(SELL_KEYS))
    rows = records.select(F.from_json(column, "map<string,string>").alias("_m")).select(dates.alias("date"), net.alias("net"))
    return rows.dropna().groupBy("date").agg(F.sum("net").alias("net_flow"))


def normalise_flow_history(raw: DataFrame, order: str) -> DataFrame:
    """Historical flows in any of four layouts, last row per date by *order*."""
    have = set(raw.columns)
    day = next(x for x in DATE_KEYS if x in have)
    if "net_flow" in have:
        value = F.col("net_flow").try_cast("double")
    elif "netValue" in have or "net" in have:
        value = number(F.col("netValue" if "netValue" in have else "net"))
    elif {"fii_net", "dii_net"} <= have:
        value = F.col("fii_net").try_cast("double") + F.col("dii_net").try_cast("double")
    else:
        raise ValueError("no flow columns")
    rows = raw.select(F.to_date(day).alias("date"), value.alias("net_flow"), order).dropna(subset=["date", "net_flow"])
    return keep_last(rows, ["date"], order).drop(order)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("pos"))
    return clean_universe(lines)


def clean_universe(lines: DataFrame, benchmarks: tuple = BENCHMARK_TICKERS) -> DataFrame:
    """Ticker list: comments, blanks and benchmarks out, first position kept."""
    ticker = F.upper(F.trim("line"))
    rows = lines.select(ticker.alias("ticker"), "pos").filter((F.col("ticker") != "") & ~F.col("ticker").startswith("#"))
    return rows.filter(~F.col("ticker").isin(*benchmarks)).groupBy("ticker").agg(F.min("pos").alias("pos"))


def normalise_manual_events(raw: DataFrame, order: str, trading_days: DataFrame | None = None) -> DataFrame:
    """Manual events: synonyms, allowed types, snapped to the nearest trading day, last entry per key."""
    from barlight.operators.catalysts import snap_to_trading_day

    kind = F.lower(F.trim("event_type"))
    for old, new in EVENT_SYNONYMS.items():
        kind = F.when(F.lower(F.trim("event_type")) == old, F.lit(new)).otherwise(kind)
    rows = raw.withColumns(
        {"ticker": F.upper(F.trim("ticker")), "event_date": F.col("event_date").try_cast("date"), "event_type": kind}
    ).filter(F.col("event_type").isin(*EVENT_TYPES) & (F.col("ticker") != "") & F.col("event_date").isNotNull())
    if trading_days is not None:
        rows = snap_to_trading_day(rows, trading_days).drop("event_date").withColumnRenamed("nearest", "event_date").drop("before", "after")
    return keep_last(rows, ["ticker", "event_date", "event_type"], order).drop(order)
