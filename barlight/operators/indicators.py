"""Per-bar indicators. All frames share one (ticker, date) window: one shuffle for the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.config import Detection
from barlight.functions.columns import by_ticker, frame, lagged, pct_change
from barlight.functions.recursive import Ewm, add_ewm, fit_running, running_average


def number_bars(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_no", F.row_number().over(by_ticker()).cast("long"))


def true_range() -> Column:
    """Largest of the three ranges; greatest() skips the unknown ones of the first bar."""
    prev = F.col("close_prev1")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def _cover(fn, col: str, offsets: list[int]) -> Column:
    """Extreme over a wide window from lagged extremes of a narrow one; the pieces may overlap. Null until all exist."""
    pieces = [lagged(col, k) if k else F.col(col) for k in offsets]
    if len(pieces) == 1:
        return pieces[0]
    known = F.lit(True)
    for piece in pieces:
        known = known & piece.isNotNull()
    return F.when(known, fn(*pieces))


def _spread(width: int, part: int) -> list[int]:
    """Offsets at which windows of *part* bars cover *width* bars."""
    return sorted({min(k, width - part) for k in range(0, width, part)})


def _full(n: int, value: Column) -> Column:
    """Prices are never null, so a window is complete from the n-th bar on."""
    return F.when(F.col("bar_no") >= n, value)


def _run(col: str, n: int) -> Column:
    """Sum over n bars as the difference of two running sums: constant work per bar."""
    return F.col(col) - F.coalesce(lagged(col, n), F.lit(0.0))


def wilder_rsi(gain: str = "avg_gain", loss: str = "avg_loss", *, zero_loss: float | None = None, min_bars: int = 1) -> Column:
    """RSI from the two averages. *zero_loss* is the value when nothing was lost (null if None)."""
    g, l = F.col(gain), F.col(loss)
    value = 100.0 - 100.0 / (1.0 + g / F.nullif(l, F.lit(0.0)))
    if zero_loss is not None:
        value = F.when(l == 0, F.when(g.isNotNull(), F.lit(float(zero_loss)))).otherwise(value)
    return F.when(F.col("bar_no") > min_bars, value)


AVERAGES = (
    Ewm("ema12", "close", 2 / 13), Ewm("ema26", "close", 2 / 27), Ewm("ema20", "close", 2 / 21),
    Ewm("avg_gain", "_gain", 1 / 14, start=2), Ewm("avg_loss", "_loss", 1 / 14, start=2),
)
SIGNAL = Ewm("signal9", "macd", 0.2)


def _moves(df: DataFrame) -> DataFrame:
    """Gain and loss of each bar; needs close_prev1."""
    delta = F.col("close") - F.col("close_prev1")
    return df.withColumns({"_gain": F.greatest(delta, F.lit(0.0)), "_loss": F.greatest(-delta, F.lit(0.0))})


def _oscillators() -> dict[str, Column]:
    return {"macd": F.col("ema12") - F.col("ema26"), "rsi": wilder_rsi(min_bars=14), "rsi_full": wilder_rsi(zero_loss=100.0)}


def recursive_columns(numbered: DataFrame, longest: int | None = None) -> DataFrame:
    """EMA 12/26/20, MACD with its signal line, and Wilder gain/loss averages; *longest* as in ``add_ewm``."""
    known = numbered.columns
    out = _moves(numbered.withColumn("close_prev1", lagged("close")))
    out = add_ewm(out, list(AVERAGES), longest).withColumns(_oscillators())
    out = add_ewm(out, [SIGNAL], longest)
    return out.drop("_gain", "_loss", *[x for x in ("close_prev1",) if x not in known])


def frame_columns(numbered: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """Every window column that is not recursive.

    Means come from running sums and wide extremes from lagged narrow ones, so the work per bar does not grow with the
    window. Prices are non-null by contract (the readers drop incomplete bars); volume may be missing.
    """
    return _frames(numbered, cfg, averages=False)


def _turnover(bars: DataFrame) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    return bars.withColumns({"_tpv": typical * F.col("volume"), "_pv": F.col("close") * F.col("volume")})


def _frames(numbered: DataFrame, cfg: Detection, *, averages: bool) -> DataFrame:
    """Window columns in four levels: each level is one pass over the bars, whatever is computed in it, so a column stands in the first level that
    knows its inputs. Every frame of a pass is code of its own in each task, and Spark keeps a hundred classes compiled by default: a pass has few frames,
    and the same offsets serve several columns. With *averages*, the recursive ones are running sums in the same passes (histories known to be short)."""
    running = frame(Window.unboundedPreceding, 0)
    wide = cfg.breakout_days
    part = min(20, wide)
    out = numbered if "_tpv" in numbered.columns else _turnover(numbered)
    out = out.withColumns(
        {
            "_s_close": F.sum("close").over(running),
            "_s_tpv": F.sum("_tpv").over(running),
            "_s_pv": F.sum("_pv").over(running),
            "_n_volume": F.count("volume").over(running).cast("double"),
            "cum_volume": F.sum("volume").over(running),
            "close_prev1": lagged("close"),
            "open_prev1": lagged("open"),
            "high_prev1": lagged("high"),
            "low_prev1": lagged("low"),
            "_close_prev2": lagged("close", 2),
            "bb_std": _full(20, F.stddev_samp("close").over(frame(-19, 0))),
            "_top_close": _full(part, F.max("close").over(frame(-(part - 1), 0))),
            "_top_close20": _full(20, F.max("close").over(frame(-19, 0))),
            "_top_high20": _full(20, F.max("high").over(frame(-19, 0))),
            "_top_high52": _full(52, F.max("high").over(frame(-51, 0))),
            "low5_recent": F.min("low").over(frame(-4, 0)),
            "low10_recent": F.min("low").over(frame(-9, 0)),
            "next_open": F.coalesce(F.lead("open").over(by_ticker()), F.col("close")),
            "pivot_high": F.coalesce(_pivot(F.max, "high", cfg.pivot_span, high=True), F.lit(False)),
            "pivot_low": F.coalesce(_pivot(F.min, "low", cfg.pivot_span, high=False), F.lit(False)),
            **{f"ret_{k}": pct_change(F.col("close"), lagged("close", k)) for k in (1, 3, 5, 20, 60)},
        }
    )
    out = out.withColumns(
        {
            "tr": true_range(),
            "gap_pct": pct_change(F.col("open"), F.col("close_prev1")),
            "prev_gap_pct": pct_change(F.col("open_prev1"), F.col("_close_prev2")),
        }
    )
    out = _moves(out) if averages else out
    volume20 = F.nullif(_run("cum_volume", 20), F.lit(0.0))
    out = out.withColumns(
        {
            "sma20": _full(20, _run("_s_close", 20) / 20.0),
            "sma50": _full(50, _run("_s_close", 50) / 50.0),
            "sma200": _full(200, _run("_s_close", 200) / 200.0),
            "vol_avg20": F.when(_run("_n_volume", 20) == 20, _run("cum_volume", 20) / 20.0),
            "vwap": F.when(_run("_n_volume", 20) == 20, _run("_s_tpv", 20) / volume20),
            "close_vwap20": _run("_s_pv", 20) / volume20,
            "prev_high_close": _cover(F.greatest, "_top_close", [k + 1 for k in _spread(wide, part)]),
            "prev20_close": lagged("_top_close20"),
            "high20": lagged("_top_high20"),
            "swing_low10": F.when(F.col("bar_no") > 10, lagged("low10_recent")),
            "high252": _cover(F.greatest, "_top_high52", [0, 50, 100, 150, 200]),
            "atr14": _full(14, F.avg("tr").over(frame(-13, 0))),
            **({s.name: running_average(s) for s in AVERAGES} if averages else {}),
        }
    )
    mid, std = F.col("sma20"), F.col("bb_std")
    out = out.withColumns(
        {
            "bb_upper": mid + 2.0 * std,
            "bb_lower": mid - 2.0 * std,
            "bb_width": ((mid + 2.0 * std) - (mid - 2.0 * std)) / F.nullif(mid, F.lit(0.0)),
            "range_vs_atr": (F.col("high") - F.col("low")) / F.nullif(F.col("atr14"), F.lit(0.0)),
            **(_oscillators() if averages else {}),
        }
    )
    out = out.withColumns(
        {
            "_low_width": _full(79, F.min("bb_width").over(frame(-59, 0))),
            "_sma50_prev5": lagged("sma50", 5),
            "prev_range_vs_atr": lagged("range_vs_atr"),
            **({"signal9": running_average(SIGNAL), "macd_prev": lagged("macd"), "rsi_prev": lagged("rsi")} if averages else {}),
        }
    )
    narrow = [_cover(F.least, "_low_width", [k + ago for k in _spread(120, 60)]) for ago in range(3)]
    out = out.withColumns(
        {
            "sma50_slope_pct": pct_change(F.col("sma50"), F.col("_sma50_prev5")),
            "dist_52w_high_pct": pct_change(F.col("close"), F.col("high252")),
            "_width1": lagged("bb_width"),
            "_width2": lagged("bb_width", 2),
            **({"signal9_prev": lagged("signal9")} if averages else {}),
            **{f"_narrow{ago}": x for ago, x in enumerate(narrow)},
        }
    )
    squeeze = lambda width, least: F.coalesce(F.col(width) <= F.col(least) * 1.05, F.lit(False))
    out = out.withColumns({"bb_width_min": F.col("_narrow0"), "squeeze": squeeze("bb_width", "_narrow0")})
    out = out.withColumn("squeeze_recent", F.col("squeeze") | squeeze("_width1", "_narrow1") | squeeze("_width2", "_narrow2"))
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def _pivot(fn, col: str, span: int, *, high: bool) -> Column:
    """Strictly beyond the *span* bars before and at least level with the *span* bars after, both complete."""
    full = (F.col("bar_no") > span) & F.lead(col, span).over(by_ticker()).isNotNull()
    v, b, a = F.col(col), fn(col).over(frame(-span, -1)), fn(col).over(frame(1, span))
    return full & ((v > b) & (v >= a) if high else (v < b) & (v <= a))


def longest_history(bars: DataFrame) -> int:
    """Bars of the ticker that has most."""
    return bars.groupBy("ticker").count().agg(F.max("count")).first()[0] or 0


def feature_table(bars: DataFrame, cfg: Detection = Detection(), longest: int | None = None) -> DataFrame:
    """All indicators of every bar after a single shuffle by ticker; detectors then are plain filters.

    With *longest*, the bars of the longest history, the recursive averages of short histories need no sort and no pass of their own.
    """
    if fit_running(longest, (*AVERAGES, SIGNAL)):
        return _frames(number_bars(_turnover(bars)), cfg, averages=True)  # numbered in the first pass, which the turnover would split
    out = frame_columns(recursive_columns(number_bars(bars)), cfg)
    return out.withColumns({"macd_prev": lagged("macd"), "signal9_prev": lagged("signal9"), "rsi_prev": lagged("rsi")})
