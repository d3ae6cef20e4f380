"""Queries over sources, sinks and upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barlight.operators import catalysts
from barlight.plans import inputs
from barlight.plans.queries import query
from barlight.sources import readers, upserts

c = F.col


@query
def src_bars(spark, sf):
    bench = F.when(c("ticker") == "S0", "^nsei ").otherwise(c("ticker"))
    raw = inputs.bars(spark, sf).select(c("date").cast("string").alias("date"), bench.alias("ticker"),
                                        *[c(x).cast("string").alias(x) for x in ("open", "high", "low", "close", "volume")])
    return readers.normalise_bars(raw)


@query
def src_quotes_nested(spark, sf):
    month = F.trunc("date", "MM")
    gone = (c("ticker") != "S0") & (F.dayofmonth("date") == 13)
    cell = F.struct(
        F.unix_timestamp("date").alias("timestamp"), F.when(~gone, c("open")).alias("open"), "high", "low", "close",
        F.when(c("ticker") != "S0", c("volume")).alias("volume"), F.round(c("close") * 0.99 + 1e-9, 4).alias("adjclose"),
    )
    cells = inputs.bars(spark, sf).groupBy("ticker", month.alias("month")).agg(F.collect_list(cell).alias("cells"))
    names = ("timestamp", "open", "high", "low", "close", "volume")
    adjusted = F.when(F.month("month") % 2 == 0, c("cells.adjclose")).alias("adjclose")
    payload = F.to_json(F.struct("ticker", *[c(f"cells.{x}").alias(x) for x in names], adjusted))
    return readers.parse_quotes(cells.select(payload.alias("payload")), benchmarks=("S0",))


@query
def src_bhav_normalise(spark, sf):
    series = F.when(F.weekday("date") == 2, " be").otherwise(" eq ")
    raw = inputs.bars(spark, sf).select(
        "date", F.concat(F.lit(" "), F.lower("ticker")).alias(" symbol"), series.alias("SERIES "), c("open").cast("string").alias("OPEN"),
        c("high").cast("string").alias("HIGH_PRICE"), c("low").cast("string").alias("low"), c("close").cast("string").alias("CLOSE_PRICE"),
        F.when(F.dayofmonth("date") == 13, F.lit("-")).otherwise(F.concat(F.lit(" "), c("volume").cast("string"))).alias("TOTTRDQTY"),
    )
    universe = inputs.table(spark, sf, "supplier").filter(c("s_acctbal") > 0).select(F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("symbol"))
    return readers.normalise_exchange_file(raw, universe)


@query
def src_flows_parse(spark, sf):
    day, price = F.to_date("o_orderdate"), F.round("o_totalprice", 2)
    n = c("o_orderkey") % 5
    text = F.format_number(price, 2)
    formats = ["yyyy-MM-dd", "dd-MM-yyyy", "dd-MMM-yyyy", "dd MMM yyyy", "dd/MM/yyyy"]
    written = F.coalesce(*[F.when(n == i, F.date_format(day, f)) for i, f in enumerate(formats)])
    entries = {
        "F": F.create_map(F.lit("date"), written, F.lit("netValue"), text),
        "O": F.create_map(F.lit("tradeDate"), written, F.lit("net"), F.lit("-"), F.lit("fiiBuyValue"), F.format_number(price + 100, 2), F.lit("sell"), F.lit("100")),
        "P": F.create_map(F.lit("Date"), written, F.lit("note"), F.lit("none")),
    }
    record = F.coalesce(*[F.when(c("o_orderstatus") == k, F.to_json(v)) for k, v in entries.items()])
    out = readers.parse_flows(inputs.table(spark, sf, "orders").select(record.alias("record")))
    return out.withColumn("net_flow", F.round(c("net_flow") + 1e-9, 2))


@query
def src_flows_hist(spark, sf):
    price = F.round("o_totalprice", 2)
    base = inputs.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), price.alias("v"), c("o_orderkey").alias("seq"))
    text = F.format_number("v", 2)
    layouts = {
        "net_flow": base.select(c("day").alias("Date"), c("v").alias("net_flow"), "seq"),
        "netValue": base.select(c("day").alias("date"), text.alias("netValue"), "seq"),
        "net": base.select(c("day").alias("tradeDate"), text.alias("net"), "seq"),
        "split": base.select(c("day").alias("tradedDate"), (c("v") + 1.0).alias("fii_net"), F.lit(-1.0).alias("dii_net"), "seq"),
    }
    parts = [readers.normalise_flow_history(df, "seq").withColumn("layout", F.lit(k)) for k, df in layouts.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("net_flow", F.round("net_flow", 2))


@query
def src_universe(spark, sf):
    ticker = F.concat(F.lit(" c"), c("c_nationkey").cast("string"), F.lit(" "))
    line = F.when(c("c_mktsegment") == "FURNITURE", F.concat(F.lit(" # "), ticker)).otherwise(ticker)
    lines = inputs.table(spark, sf, "customer").select(line.alias("line"), c("c_custkey").alias("pos"))
    return readers.clean_universe(lines, benchmarks=("C3",))


@query
def src_manual_events(spark, sf):
    return readers.normalise_manual_events(inputs.raw_events(spark, sf), "seq", inputs.trading_days(spark, sf))


@query
def sink_table(spark, sf):
    """Write bars partitioned by month, read them back through the same schema."""
    from barlight.session import run_folder

    path = f"{run_folder(spark)}/bars-{uuid.uuid4().hex}.parquet"
    upserts.write_table(inputs.bars(spark, sf).withColumn("month", F.date_format("date", "yyyy-MM")), path, "month")
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).parquet(path)
    return back.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.round(F.sum("close") + 1e-9, 2).alias("total")
    )


@query
def upsert_bars(spark, sf):
    stored = inputs.bars(spark, sf).select("date", "ticker", "close", "volume", F.lit(1).cast("long").alias("load_seq"))
    fresh = stored.filter(F.year("date") >= 1999).withColumns({"close": F.round(c("close") * 1.01 + 1e-9, 4), "load_seq": F.lit(2).cast("long")})
    return upserts.upsert(stored, fresh, upserts.BAR_KEYS)


def _order_signals(spark, sf):
    return inputs.table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("signal_date"), F.concat(F.lit("C"), c("o_custkey").cast("string")).alias("ticker"),
        c("o_orderpriority").alias("pattern"), c("o_totalprice").alias("entry_price"), c("o_orderkey").alias("load_seq"), "o_orderstatus",
    )


@query
def upsert_buys(spark, sf):
    rows = _order_signals(spark, sf)
    stored = rows.filter(c("o_orderstatus") != "O").drop("o_orderstatus")
    fresh = rows.filter(c("o_orderstatus") == "O").withColumn("tag", F.lit("new")).drop("o_orderstatus")
    return upserts.upsert(stored, fresh, upserts.BUY_KEYS)


@query
def upsert_sells(spark, sf):
    rows = _order_signals(spark, sf).withColumnsRenamed({"signal_date": "buy_signal_date", "entry_price": "sell_price"}).drop("o_orderstatus")
    return upserts.keep_first(rows, upserts.SELL_KEYS, "load_seq")


@query
def merge_factors(spark, sf):
    new = inputs.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"))
    flows = new.agg(F.round(F.sum("l_quantity"), 2).alias("net_flow"))
    return upserts.merge_factors(inputs.factors(spark, sf).select("date", "vix_close", "net_flow"), flows)


@query
def snap_trading_day(spark, sf):
    days = inputs.calendar(spark, sf).select("event_date").distinct()
    return catalysts.snap_to_trading_day(days, inputs.trading_days(spark, sf))


@query
def factor_derive(spark, sf):
    out = catalysts.derive_factors(inputs.factors(spark, sf))
    names = ("vix_change_1d_pct", "fx_ret_5d_pct", "oil_ret_5d_pct")
    return out.select("date", *[F.round(c(x) + 1e-9, 6).alias(x) for x in names], "net_flow")


@query
def sector_map(spark, sf):
    tickers = inputs.table(spark, sf, "supplier").select(F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("ticker"), "s_nationkey")
    nations = inputs.table(spark, sf, "nation").filter(c("n_regionkey") != 2)
    sectors = tickers.join(nations, c("s_nationkey") == c("n_nationkey")).select("ticker", c("n_name").alias("sector"))
    return catalysts.sector_of(tickers.select("ticker"), sectors)
