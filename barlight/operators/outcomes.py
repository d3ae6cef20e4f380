"""Forward outcomes: one first-touch operator, many policies.

Bars are addressed by (ticker, block of 64 bars). A signal meets only the blocks its horizon touches, so the work is
linear in signals times horizon instead of all bars of the instrument. Unbounded scans first find the one later block
that can contain the touch: they descend a two-level index of block extremes, which each instrument has as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.config import COVERAGE, SHORT_TERM, Backtest, Outcome
from barlight.functions.columns import by_ticker, rounded
from barlight.operators.indicators import number_bars

c = F.col
BLOCK = 64
GROUP = 32
KEY = ("ticker", "signal_date", "pattern")


def locate(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Number of the last bar on or before each signal date; signals cut from the feature table carry it already."""
    if "bar_no" in signals.columns:
        return signals
    marks = number_bars(bars.select("ticker", "date")).unionByName(
        signals.select("ticker", c("signal_date").alias("date")), allowMissingColumns=True
    )
    days = marks.groupBy("ticker", "date").agg(F.max("bar_no").alias("bar_no"))
    last = F.max("bar_no").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    at = days.select("ticker", c("date").alias("signal_date"), F.coalesce(last, F.lit(0)).alias("bar_no"))
    return signals.join(at, ["ticker", "signal_date"])


def _blocked(bars: DataFrame) -> DataFrame:
    return number_bars(bars).select(
        "ticker", F.floor((c("bar_no") - 1) / BLOCK).alias("_block"), c("bar_no").alias("_no"), c("date").alias("_date"),
        *[c(x).alias(f"_{x}") for x in ("open", "high", "low", "close")],
    )


def _block_of(no: Column) -> Column:
    return F.floor((no - 1) / BLOCK)


def effective_stop(stop_pct: float, row_stop: bool = True) -> Column:
    fixed = c("entry_price") * (1.0 - stop_pct / 100.0)
    if not row_stop:
        return fixed
    usable = (c("stop_price") > 0) & (c("stop_price") < c("entry_price"))
    return F.when(usable, c("stop_price")).otherwise(fixed)


def touches(signals: DataFrame, bars: DataFrame, cfg: Outcome = Outcome(), row_stop: bool = True) -> DataFrame:
    """Signals with everything their next *horizon* bars say: first target and stop days, extremes, last close."""
    cols = signals.columns
    sig = signals.withColumns({"target": c("entry_price") * (1.0 + cfg.target_pct / 100.0), "stop": effective_stop(cfg.stop_pct, row_stop)})
    blocks = F.sequence(_block_of(c("bar_no") + 1), _block_of(c("bar_no") + cfg.horizon))
    probes = sig.withColumn("_block", F.explode(blocks))
    b = _blocked(bars).withColumnRenamed("ticker", "_ticker").withColumnRenamed("_block", "_b")
    on = (c("ticker") == c("_ticker")) & (c("_block") == c("_b")) & c("_no").between(c("bar_no") + 1, c("bar_no") + cfg.horizon)
    day = c("_no") - c("bar_no")
    rest = [x for x in cols if x not in KEY] + ["target", "stop"]
    facts = probes.join(b, on, "left").groupBy(*KEY).agg(
        F.any_value(F.struct(*rest)).alias("_s"),
        F.count("_no").alias("bars_available"),
        F.min(F.when(c("_high") >= c("target"), day)).alias("target_day"),
        F.min(F.when(c("_low") <= c("stop"), day)).alias("stop_day"),
        F.min(F.when(c("_close") <= c("stop"), day)).alias("close_stop_day"),
        F.min_by("_open", "_no").alias("first_open"),
        F.min("_low").alias("lowest_low"),
        F.max_by("_close", "_no").alias("last_close"),
        F.max("_date").alias("last_date"),
        F.min(F.when(c("_high") >= c("target"), c("_date"))).alias("target_date"),
        F.min(F.when(c("_low") <= c("stop"), c("_date"))).alias("stop_date"),
    )
    facts = facts.select(*KEY, "_s.*", *[x for x in facts.columns if x not in (*KEY, "_s")])
    return facts.filter(c("entry_price") > 0)


def _no_later(a: str, b: str) -> Column:
    return c(a).isNotNull() & (c(b).isNull() | (c(a) <= c(b)))


def target_first() -> Column:
    """win / loss / hold, the target winning a tie on one bar."""
    return F.when(_no_later("target_day", "stop_day"), "win").when(c("stop_day").isNotNull(), "loss").otherwise("hold")


def stop_first(target: str = "target", stop: str = "stop", neither: str = "hold") -> Column:
    return F.when(_no_later("stop_day", "target_day"), stop).when(c("target_day").isNotNull(), target).otherwise(neither)


def forward_outcome(t: DataFrame) -> DataFrame:
    """Outcome with flags and the first day of both sides."""
    out = t.withColumn("outcome", target_first())
    flag = lambda name: (c("outcome") == name).cast("long")
    return out.withColumns({"win_flag": flag("win"), "loss_flag": flag("loss"), "hold_flag": flag("hold")})


def stop_labels(t: DataFrame, horizon: int, full_horizon: bool = False) -> DataFrame:
    """Four stop-event labels, the stop winning a tie; signals without future bars are dropped."""
    before = _no_later("stop_day", "target_day")
    return t.filter(c("bars_available") >= (horizon if full_horizon else 1)).withColumns(
        {
            "stop_before_target": before.cast("long"),
            "stop_within_5d": (before & (c("stop_day") <= 5)).cast("long"),
            "gap_through_stop": F.coalesce((c("first_open") <= c("stop")).cast("long"), F.lit(0)),
            "mae_exceeds_stop": F.coalesce((c("lowest_low") <= c("stop")).cast("long"), F.lit(0)),
        }
    )


def st_label(t: DataFrame, horizon: int = SHORT_TERM.horizon) -> DataFrame:
    """1 when the target is touched and no bar of the full horizon touches the stop."""
    hit = c("target_day").isNotNull() & c("stop_day").isNull()
    return t.filter(c("bars_available") >= horizon).withColumn("st_hit_target_7d", hit.cast("long"))


def combo_trade(t: DataFrame) -> DataFrame:
    """Trade with exit price, date, days held and return; open trades leave at the last close of the horizon."""
    status = stop_first()
    out = t.withColumn("trade_status", status)
    pick = lambda s, g, h: F.when(c("trade_status") == "stop", s).when(c("trade_status") == "target", g).otherwise(h)
    price = pick(c("stop"), c("target"), c("last_close"))
    return out.withColumns(
        {
            "trade_exit_date": pick(c("stop_date"), c("target_date"), c("last_date")),
            "trade_exit_price": rounded(price, 4),
            "trade_days_held": pick(c("stop_day"), c("target_day"), c("bars_available")),
            "trade_return_pct": rounded((price / c("entry_price") - 1.0) * 100.0, 4),
        }
    )


def model_trade(t: DataFrame, cfg: Outcome = SHORT_TERM) -> DataFrame:
    """Short-term trade for model comparison: fixed gain or loss, else the last close."""
    out = t.filter(c("bars_available") >= cfg.horizon).withColumn("status", stop_first(neither="holding"))
    gain = (
        F.when(c("status") == "target", F.lit(cfg.target_pct))
        .when(c("status") == "stop", F.lit(-cfg.stop_pct))
        .otherwise((c("last_close") / c("entry_price") - 1.0) * 100.0)
    )
    return out.withColumns({"return_pct": gain, "st_hit_target_7d": (c("status") == "target").cast("long")})


def close_stop(t: DataFrame) -> DataFrame:
    """Target by the high, stop by the close, target first."""
    outcome = F.when(_no_later("target_day", "close_stop_day"), "target").when(c("close_stop_day").isNotNull(), "stop").otherwise("holding")
    return t.withColumn("outcome", outcome)


def coverage_target(t: DataFrame, cfg: Outcome = COVERAGE) -> DataFrame:
    hit = c("target_day").isNotNull()
    return t.withColumns({"is_breakout": hit, "is_pending": ~hit & (c("bars_available") < cfg.horizon)})


# ---- unbounded scans ----------------------------------------------------------------------------------------------
def reach_index(blocked: DataFrame, top: str) -> DataFrame:
    """One row per ticker: its groups of GROUP blocks, each with its own extremes and those of its blocks, in time order.

    Bars are unique per (ticker, date), so a row is bounded by the calendar: a century of days has fewer than 600 blocks.
    """
    extremes = blocked.groupBy("ticker", c("_block").alias("block")).agg(F.max(top).alias("top"), F.min("_close").alias("bottom"))
    groups = extremes.groupBy("ticker", F.floor(c("block") / GROUP).alias("group")).agg(
        F.max("block").alias("last"), F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.array_sort(F.collect_list(F.struct("block", "top", "bottom"))).alias("blocks")
    )
    return groups.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("group", "last", "top", "bottom", "blocks"))).alias("_index"))


def first_reach(after: Column, target: Column, stop: Column, index: str = "_index") -> Column:
    """Number of the first block beyond *after* whose extremes reach *target* or *stop*; null without one.

    Of the groups that qualify only two are opened: the first may do so by a block that isn't late enough, every block of the second is.
    """
    reaches = lambda x: F.coalesce(x["top"] >= target, F.lit(False)) | F.coalesce(x["bottom"] <= stop, F.lit(False))
    groups = F.slice(F.filter(index, lambda g: (g["last"] > after) & reaches(g)), 1, 2)
    late = F.flatten(F.transform(groups, lambda g: F.filter(g["blocks"], lambda b: (b["block"] > after) & reaches(b))))
    return F.try_element_at(late, F.lit(1))["block"]


def _first_touch(signals: DataFrame, bars: DataFrame, target: Column, stop: Column | None, by_close: bool, lockout_days: int, key: tuple = KEY) -> DataFrame:
    """First later bar at or beyond target (or, once the lockout is over, closing at or below stop), as column hit.

    A signal looks at the blocks of its lockout and at the one block that an index of block extremes names, so rows stay in proportion to signals.
    """
    b = _blocked(bars)
    near = (lockout_days + BLOCK - 1) // BLOCK + 1
    sig = signals.withColumns({"_target": target, "_stop": stop if stop is not None else F.lit(None).cast("double")})
    start, until = _block_of(c("bar_no") + 1), _block_of(c("bar_no") + 1) + near
    sig = sig.join(reach_index(b, "_close" if by_close else "_high"), "ticker", "left").withColumn("_far", first_reach(until, c("_target"), c("_stop"))).drop("_index")
    probes = sig.withColumn("_block", F.explode(F.concat(F.sequence(start, until), F.array_compact(F.array("_far")))))
    bb = b.withColumnsRenamed({"ticker": "_ticker", "_block": "_b"})
    hit_target = (c("_close") if by_close else c("_high")) >= c("_target")
    hit_stop = F.coalesce((c("_close") <= c("_stop")) & (F.datediff("_date", "signal_date") > lockout_days), F.lit(False))
    on = (c("ticker") == c("_ticker")) & (c("_block") == c("_b")) & (c("_no") > c("bar_no")) & (hit_target | hit_stop)
    bar = F.struct(c("_no").alias("no"), c("_date").alias("date"), c("_close").alias("close"), hit_target.alias("target"))
    rest = [x for x in signals.columns if x not in key]
    first = probes.join(bb, on, "left").groupBy(*key).agg(F.any_value(F.struct(*rest)).alias("_s"), F.min_by(bar, c("_no")).alias("hit"))
    return first.select(*key, "_s.*", "hit").select(*signals.columns, "hit")


def sell_signals(signals: DataFrame, bars: DataFrame, target_pct: float = 6.0) -> DataFrame:
    """First close at or above target, however late."""
    target = c("entry_price") * (1.0 + target_pct / 100.0)
    out = _first_touch(signals, bars, target, None, True, 0).filter(c("hit").isNotNull())
    return out.select(
        c("signal_date").alias("buy_signal_date"), c("hit.date").alias("sell_signal_date"), "ticker", "pattern",
        rounded(c("entry_price"), 4).alias("entry_price"), F.lit(target_pct).alias("target_return_pct"), rounded(target, 4).alias("target_price"),
        rounded(c("hit.close"), 4).alias("sell_price"),
        rounded((c("hit.close") - c("entry_price")) / c("entry_price") * 100.0, 2).alias("realized_return_pct"),
    )


def track(signals: DataFrame, bars: DataFrame, cfg: Backtest = Backtest(), scenario: tuple = ()) -> DataFrame:
    """Position of each signal: target by the high, stop by the close after the lockout, else still held.

    Signals may come once for each *scenario* (columns that tell the copies apart); a column target_pct goes before the configured target.
    """
    held = c("hold_to_target_only") if "hold_to_target_only" in signals.columns else F.lit(False)
    target = c("entry_price") * (1.0 + (c("target_pct") if "target_pct" in scenario else F.lit(cfg.target_pct)) / 100.0)
    stop = F.coalesce("stop_price", c("entry_price") * (1.0 - cfg.stop_pct / 100.0))
    out = _first_touch(signals, bars, target, F.when(~held, stop), False, cfg.lockout_days, (*KEY, *scenario))
    last = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("_close"), F.max("date").alias("_date"))
    out = out.join(last, "ticker", "left")
    later = c("_date") > c("signal_date")
    status = F.when(c("hit").isNull(), "holding").when(c("hit.target"), "target").otherwise("stop")
    latest = F.when(c("hit").isNotNull(), c("hit.close")).when(later, c("_close")).otherwise(c("entry_price"))
    end = F.coalesce(c("hit.date"), F.when(later, c("_date")))
    out = out.withColumns({"hold_to_target_only": held, "target_price": target, "stop_price": stop, "status": status, "latest_close": latest})
    exit_price = F.when(c("status") == "target", c("target_price")).when(c("status") == "stop", c("stop_price"))
    days = F.coalesce(F.datediff(end, "signal_date"), F.lit(0)).cast("long")
    return out.withColumns({"exit_price": exit_price, "exit_date": c("hit.date"), "days_held": days}).drop("hit", "_close", "_date")
