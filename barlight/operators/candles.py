"""Candle shapes as flags on every bar; "in the last k bars" is a running maximum of the flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlight.functions.columns import as_flag, as_int, frame, lagged, rolling

c = F.col
SHAPES = (
    "engulfing", "engulfing_confirmed", "hammer_basic", "hammer", "marubozu_basic", "marubozu", "belt_hold", "harami",
    "dragonfly_doji", "inverted_hammer", "morning_star", "piercing_line", "piercing_variant", "three_soldiers",
)


def _prior(fn, col: str, n: int) -> Column:
    return rolling(fn, col, n, shift=1, min_periods=max(5, n // 2))


def _bar(back: int) -> dict[str, Column]:
    """Geometry of the bar *back* bars ago; shares are null when the bar has no range."""
    suffix = f"_prev{back}" if back else ""
    o, h, l, cl = (c(f"{x}{suffix}") for x in ("open", "high", "low", "close"))
    size = F.when(h - l > 0, h - l)
    return {
        "o": o, "h": h, "l": l, "c": cl, "range": size,
        "body": F.abs(cl - o) / size, "upper": (h - F.greatest(o, cl)) / size, "lower": (F.least(o, cl) - l) / size,
        "up": cl > o, "down": cl < o, "mid": (o + cl) / 2.0,
    }


def candle_flags(features: DataFrame) -> DataFrame:
    """Features plus one boolean per shape (never null)."""
    source = features.withColumns(
        {
            **{f"{x}_prev2": lagged(x, 2) for x in ("open", "high", "low", "close")},
            "_low20": _prior(F.min, "low", 20),
            "_close15": _prior(F.max, "close", 15),
            "_close20": _prior(F.max, "close", 20),
            "_high10": _prior(F.max, "high", 10),
            "_low10": _prior(F.min, "low", 10),
            "_high12": _prior(F.max, "high", 12),
            "_low12": _prior(F.min, "low", 12),
            "_high20": _prior(F.max, "high", 20),
            "_vol20": _prior(F.avg, "volume", 20),
            "_rsi_low": F.min("rsi").over(frame(-9, 0)),
        }
    )
    b, p, q = _bar(0), _bar(1), _bar(2)
    soldier = lambda x: x["up"] & (x["body"] >= 0.50) & (x["upper"] <= 0.20)
    red_then_green = lambda first, second: (
        p["down"] & (p["body"] >= first) & b["up"] & (b["body"] >= second) & (b["c"] > p["mid"]) & (b["c"] < p["o"])
    )
    shapes = {
        "engulfing": p["down"] & b["up"] & (b["o"] <= p["c"]) & (b["c"] >= p["o"]),
        "hammer_basic": (b["body"] <= 0.40) & (b["lower"] >= 0.50) & (b["upper"] <= 0.20),
        "marubozu_basic": b["up"] & (b["body"] >= 0.80) & (b["upper"] <= 0.10) & (b["lower"] <= 0.10),
        "belt_hold": b["up"] & (p["c"].isNull() | p["down"]) & (b["body"] >= 0.75) & (b["lower"] <= 0.05) & (b["upper"] <= 0.10),
        "harami": p["down"] & (p["body"] >= 0.40) & b["up"] & (b["o"] >= p["c"]) & (b["c"] <= p["o"]),
        "dragonfly_doji": (b["body"] <= 0.30) & (b["lower"] >= 0.60) & (b["upper"] <= 0.15),
        "inverted_hammer": (b["body"] <= 0.40) & (b["upper"] >= 0.45) & (b["lower"] <= 0.20),
        "morning_star": q["down"] & (q["body"] > 0.50) & ~as_flag(p["body"] >= 0.30) & b["up"] & (b["body"] > 0.40) & (b["c"] > q["mid"]),
        "piercing_line": red_then_green(0.50, 0.50) & (b["o"] < p["l"]) & (b["c"] <= p["h"]),
        "piercing_variant": red_then_green(0.25, 0.20) & (b["o"] <= p["o"]) & (b["o"] <= p["c"] * 1.03),
        "three_soldiers": soldier(q) & soldier(p) & soldier(b) & (p["c"] > q["c"]) & (b["c"] > p["c"]) & (p["h"] > q["h"])
        & (b["h"] > p["h"]) & (b["c"] / q["o"] - 1.0 >= 0.04),
    }
    out = source.withColumns({k: as_flag(v) for k, v in shapes.items()})
    trend = as_flag((c("sma50") > c("sma200")) & (b["c"] >= c("sma50")))
    near = lambda tolerance: as_flag(b["l"] <= c("_low20") * tolerance)
    pulled = lambda col: as_flag(c(col) >= b["c"] * 1.02)
    tight = lambda n, limit: as_flag((c(f"_high{n}") - c(f"_low{n}")) / F.nullif(p["c"], F.lit(0.0)) * 100.0 <= limit)
    busy = lambda times: as_flag(c("volume") >= c("_vol20") * times)
    votes = lambda *tests: sum((as_int(t) for t in tests), F.lit(0))
    p_body = F.abs(p["c"] - p["o"])
    dominant = as_flag((p_body > 0) & (F.abs(b["c"] - b["o"]) >= p_body * 1.1))
    strong_close = as_flag((b["upper"] <= 0.25) & (b["c"] >= p["h"]))
    confirmed = {
        "engulfing_confirmed": c("engulfing") & dominant & strong_close
        & (votes(trend, near(1.03) | (pulled("_close15") & trend), tight(10, 8.0), busy(1.25), as_flag(b["o"] >= p["c"] * 0.98)) >= 4),
        "hammer": c("hammer_basic") & (votes(as_flag(c("_rsi_low") <= 40.0), near(1.04), busy(1.2)) >= 2),
        "marubozu": c("marubozu_basic")
        & (votes(tight(12, 7.0), as_flag(b["c"] >= c("_high20") * 0.995) | (near(1.03) & pulled("_close20")), busy(1.5)) >= 2),
    }
    out = out.withColumns(confirmed)
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def in_last(flag: str, bars: int) -> Column:
    """Did *flag* fire on any of the last *bars* bars of the instrument?"""
    return F.max(flag).over(frame(-(bars - 1), 0))


def candle_combos(signals: DataFrame, candles: DataFrame) -> DataFrame:
    """Flags that need both a family and a candle as of the signal bar."""
    return _with_combos(signals, flags_as_of(candles, ("hammer", "engulfing", "piercing_variant")))


def _with_combos(signals: DataFrame, flags: DataFrame) -> DataFrame:
    fam = c("pattern_family")
    return signals.join(flags, ["ticker", "signal_date"]).withColumns(
        {
            "confirmed_hammer_a": (fam == "A") & c("hammer"),
            "engulfing_trend_combo": fam.isin("A", "C", "G") & c("engulfing"),
            "piercing_variant_b_combo": (fam == "B") & c("piercing_variant"),
        }
    )


def flags_as_of(candles: DataFrame, shapes: tuple) -> DataFrame:
    """Each shape as its check sees it on a bar: on the last two bars or on the newest one."""
    return candles.select("ticker", c("date").alias("signal_date"), *[(in_last(x, 2) if x in TWO_BAR else c(x)).alias(x) for x in shapes])


def scan_shapes(candles: DataFrame, bars: int = 60) -> DataFrame:
    """Plain shape hits within the last *bars* bars of each instrument, with trend context."""
    last = candles.groupBy("ticker").agg(F.max("bar_no").alias("_last"))
    names = {"dragonfly_doji": "dragonfly_doji", "hammer": "hammer_basic", "inverted_hammer": "inverted_hammer", "marubozu": "marubozu_basic"}
    hits = F.array_compact(F.array(*[F.when(c(v), F.lit(k)) for k, v in names.items()]))
    recent = candles.join(last, "ticker").filter(c("bar_no") > c("_last") - bars)
    return recent.select(
        "ticker", "date", F.explode(hits).alias("shape"), (c("close") > c("sma50")).alias("above_sma50"), (c("close") > c("sma200")).alias("above_sma200")
    )


# Shapes whose check looks at the last two bars; the others look at the newest bar only.
TWO_BAR = ("dragonfly_doji", "hammer", "hammer_basic", "inverted_hammer")
WEIGHT_FLAGS = (
    "dragonfly_doji", "hammer", "marubozu", "confirmed_hammer_a", "engulfing", "engulfing_trend_combo", "belt_hold", "harami",
    "inverted_hammer", "morning_star", "piercing_line", "piercing_variant", "piercing_variant_b_combo", "three_soldiers",
)
COMPARISON_FLAGS = ("hammer_basic", "engulfing_confirmed")


def signal_flags(signals: DataFrame, candles: DataFrame) -> DataFrame:
    """All shape and combination flags as of each signal's bar."""
    return _with_combos(signals, flags_as_of(candles, tuple(x for x in SHAPES if x != "marubozu_basic")))
