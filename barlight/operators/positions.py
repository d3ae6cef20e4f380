"""Positions simulated per signal: stop modes, valuation, summaries and scenario grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.config import Backtest
from barlight.functions.columns import as_int, rounded
from barlight.operators import outcomes as oc

c = F.col


def lab_stop(signals: DataFrame, mode: str = "structure_atr", stop_pct: float = 9.0, atr_multiplier: float = 2.5, structure_buffer: float = 0.5) -> DataFrame:
    """Recompute the stop of each signal from the bar context it carries; an unusable stop falls back to the fixed one."""
    fixed = c("entry_price") * (1.0 - stop_pct / 100.0)
    raw = {"atr": c("entry_price") - c("atr14") * atr_multiplier, "structure_atr": c("low5_recent") - c("atr14") * structure_buffer}.get(mode)
    return _with_stop(signals, fixed if raw is None else F.when(raw.isNotNull(), F.greatest(raw, fixed)).otherwise(fixed), fixed)


def confluence_stop(signals: DataFrame, stop_pct: float = 2.0, buffer_pct: float = 0.5) -> DataFrame:
    """Just below the lowest of recent low, EMA 20 and close VWAP 20, at most 10 % away."""
    fixed = c("entry_price") * (1.0 - stop_pct / 100.0)
    anchors = [F.when(c(x) > 0, c(x)) for x in ("low10_recent", "ema20", "close_vwap20")]
    lowest = F.least(*anchors) * (1.0 - buffer_pct / 100.0)
    return _with_stop(signals, F.coalesce(F.greatest(lowest, c("entry_price") * 0.90), fixed), fixed)


def _with_stop(signals: DataFrame, stop: Column, fixed: Column) -> DataFrame:
    usable = F.when((stop > 0) & (stop < c("entry_price")), stop).otherwise(fixed)
    return signals.withColumn("_stop", usable).withColumns(
        {"stop_pct": rounded((c("entry_price") - c("_stop")) / c("entry_price") * 100.0, 2), "stop_price": rounded(c("_stop"), 4)}
    ).drop("_stop")


def hold_flag(signals: DataFrame, mode: str) -> DataFrame:
    limit = {"score_gt_95_hold_to_target": 95.0, "score_gt_90_hold_to_target": 90.0}.get(mode)
    flag = F.lit(False) if limit is None else F.coalesce(c("signal_score") > limit, F.lit(False))
    return signals.withColumn("hold_to_target_only", flag)


def value(tracked: DataFrame, capital: float | Column = 10_000.0) -> DataFrame:
    """Quantity, invested amount, value and return of each position; positions too dear for the capital are dropped."""
    qty = F.when(c("entry_price") > 0, F.floor(capital / c("entry_price"))).otherwise(F.lit(0)).cast("long")
    out = tracked.withColumn("qty", qty).filter(c("qty") > 0).withColumn("invested", rounded(c("qty") * c("entry_price"), 2))
    out = out.withColumn("current_value", rounded(c("qty") * F.coalesce("exit_price", "latest_close"), 2))
    return out.withColumns(
        {
            "pnl": rounded(c("current_value") - c("invested"), 2),
            "return_pct": rounded((c("current_value") / c("invested") - 1.0) * 100.0, 2),
        }
    )


def within_days(view: DataFrame, days: int) -> DataFrame:
    return view.filter(c("days_held") <= days)


def _sum_if(cond: Column, col: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, c(col))), F.lit(0.0))


def summary_columns() -> list[Column]:
    closed = c("status").isin("target", "stop")
    count = lambda s: F.count_if(c("status") == s)
    ratio = lambda a, b: F.coalesce((a / F.nullif(b, F.lit(0.0)) - 1.0) * 100.0, F.lit(0.0))
    rate = F.coalesce(count("target") / F.nullif(count("target") + count("stop"), F.lit(0)) * 100.0, F.lit(0.0))
    everything = F.lit(True)
    return [
        F.count("*").alias("n_total"), count("target").alias("n_target"), count("stop").alias("n_stop"), count("holding").alias("n_holding"),
        rounded(_sum_if(everything, "invested"), 2).alias("total_invested"), rounded(_sum_if(everything, "current_value"), 2).alias("total_current"),
        rounded(_sum_if(everything, "pnl"), 2).alias("total_pnl"),
        rounded(ratio(_sum_if(everything, "current_value"), _sum_if(everything, "invested")), 4).alias("overall_return"),
        rounded(_sum_if(closed, "invested"), 2).alias("closed_invested"), rounded(_sum_if(closed, "current_value"), 2).alias("closed_current"),
        rounded(_sum_if(closed, "pnl"), 2).alias("closed_pnl"),
        rounded(ratio(_sum_if(closed, "current_value"), _sum_if(closed, "invested")), 4).alias("closed_return"), rounded(rate, 4).alias("win_rate"),
    ]


def summarize(view: DataFrame, *keys: str) -> DataFrame:
    return view.groupBy(*keys).agg(*summary_columns())


def monthly(view: DataFrame, initial_capital: float | None = None) -> DataFrame:
    """Trades per month with running capital; the running step sees one row per month."""
    m = view.groupBy(F.date_format("signal_date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("trades"), F.sum("invested").alias("inv"), F.sum("current_value").alias("cur"), F.sum("pnl").alias("ret"), F.avg("return_pct").alias("avg"),
    )
    order = Window.partitionBy(F.lit(1)).orderBy("month")
    opening = F.lit(float(initial_capital)) if initial_capital else F.first("inv").over(order)
    earned = F.coalesce(F.sum(rounded(c("ret"), 2)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    m = m.withColumn("start", rounded(opening + earned, 2))
    share = lambda a, b, n: F.coalesce(F.when(b > 0, rounded(a / b * 100.0, n)), F.lit(0.0))
    return m.select(
        "month", c("start").alias("start_capital"), "trades", rounded(c("inv"), 2).alias("invested"),
        rounded(F.greatest(c("inv") - c("start"), F.lit(0.0)), 2).alias("recycled_capital"), rounded(F.greatest(c("start") - c("inv"), F.lit(0.0)), 2).alias("idle_cash"),
        share(c("inv"), c("start"), 1).alias("utilization_pct"), rounded(c("cur"), 2).alias("current_value"), rounded(c("ret"), 2).alias("return_value"),
        share(c("ret"), c("inv"), 2).alias("return_pct"), share(c("ret"), c("start"), 2).alias("pool_return_pct"), rounded(c("avg"), 2).alias("avg_trade_return_pct"),
        rounded(c("start") + c("ret"), 2).alias("end_capital"),
    )


def yearly(view: DataFrame, initial_capital: float) -> DataFrame:
    y = view.filter(c("status").isin("target", "stop") & c("exit_date").isNotNull()).groupBy(F.year("exit_date").alias("year")).agg(F.sum("pnl").alias("p"))
    earned = F.coalesce(F.sum("p").over(Window.partitionBy(F.lit(1)).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    y = y.withColumn("s", F.lit(float(initial_capital)) + earned)
    return y.select(
        "year", rounded(c("s"), 2).alias("starting_capital"), rounded(c("p"), 2).alias("realized_pnl"), rounded(c("s") + c("p"), 2).alias("ending_capital"),
        F.when(c("s") > 0, rounded(c("p") / c("s") * 100.0, 3)).otherwise(0.0).alias("realized_return_pct"),
    )


def score_buckets(view: DataFrame, score: str = "signal_score") -> DataFrame:
    """Ten-point buckets, empty ones included."""
    known = view.filter(c(score).isNotNull()).withColumn("_b", F.least(F.floor(F.greatest(F.least(c(score), F.lit(100.0)), F.lit(0.0)) / 10), F.lit(9)))
    is_ = lambda s: F.sum(as_int(c("status") == s))
    g = known.groupBy("_b").agg(
        F.count("*").alias("signals"), is_("target").alias("target_hit"), is_("stop").alias("stop_hit"), is_("holding").alias("holding"), F.avg("return_pct").alias("a")
    )
    closed = c("target_hit") + c("stop_hit")
    out = view.sparkSession.range(10).join(g, c("id") == c("_b"), "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return out.select(
        F.concat((c("id") * 10).cast("string"), F.lit("-"), (c("id") * 10 + 10).cast("string")).alias("score_bucket"), zero(c("signals")).alias("signals"),
        zero(closed).alias("closed"), *[zero(c(x)).alias(x) for x in ("target_hit", "stop_hit", "holding")],
        F.coalesce(rounded(c("target_hit") / F.nullif(closed, F.lit(0)) * 100.0, 1), F.lit(0.0)).alias("win_rate_pct"),
        F.coalesce(rounded(c("a"), 2), F.lit(0.0)).alias("avg_return_pct"),
    )


def scenario_grid(signals: DataFrame, bars: DataFrame, targets: tuple, modes: tuple, min_scores: tuple, capitals: tuple) -> DataFrame:
    """Summary of every scenario: stop mode x target x minimum score x capital per trade.

    Stop mode and target change the touches, so they multiply the signals and join their key; bars are read and numbered once. Score and
    capital only re-aggregate the compact results.
    """
    stops = [lab_stop(signals, mode).withColumn("stop_mode", F.lit(mode)) for mode in modes]
    wanted = reduce(DataFrame.unionByName, stops).withColumn("target_pct", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    tracked = oc.track(wanted, bars, Backtest(), ("stop_mode", "target_pct"))
    grid = F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(float(k)).alias("k")) for s in min_scores for k in capitals])
    rows = tracked.withColumn("_g", F.explode(grid)).withColumns({"min_score": c("_g.s"), "capital": c("_g.k")}).filter(c("signal_score") >= c("min_score"))
    return summarize(value(rows, c("capital")), "stop_mode", "target_pct", "min_score", "capital")


def quality_audit(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals with a reason column: null when usable."""
    days = bars.select(c("ticker").alias("_t"), c("date").alias("_d"))
    names = bars.select(c("ticker").alias("_n")).distinct()
    out = signals.join(names, c("ticker") == c("_n"), "left").join(days, (c("ticker") == c("_t")) & (c("signal_date") == c("_d")), "left")
    reason = (
        F.when(c("signal_date").isNull(), "invalid_date").when(c("_n").isNull(), "no_price_history").when(c("_d").isNull(), "missing_price_on_date")
    )
    return out.withColumn("reason", reason).drop("_n", "_t", "_d")


def out_of_sample_scope(signals: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Signals that have an out-of-sample prediction, each matched once."""
    rest = [x for x in predictions.columns if x not in keys]
    one = predictions.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_p")).select(*keys, "_p.*")
    return signals.join(one, keys)
