"""The seven pattern families as predicates over the feature table.

All families are evaluated in one pass: each row builds the structs of the families it triggers and the array
is inlined, so the feature table is scanned once however many detectors run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.config import FAMILIES, Detection
from barlight.functions.columns import clip_score, frame, rounded
from barlight.operators.scoring import apply_family_bonus, component_columns, slope_bonus

c = F.col


@dataclass(frozen=True)
class Hit:
    """What a family needs to emit a row."""

    name: Column
    when: Column
    stop: Column
    setup_pct: Column
    rsi: Column
    stop_for_score: Column | None = None


def _known(*cols: str) -> Column:
    out = F.lit(True)
    for name in cols:
        out = out & c(name).isNotNull()
    return out


def _volume_ratio() -> Column:
    return c("volume") / F.nullif(c("vol_avg20"), F.lit(0.0))


def _trend() -> Column:
    return _known("sma50", "sma200", "vol_avg20") & (c("sma50") > c("sma200"))


def _fixed(cfg: Detection) -> Column:
    return c("close") * (1.0 - cfg.stop_pct / 100.0)


def _rsi_or_fallback() -> Column:
    return F.coalesce(c("rsi"), rounded(c("rsi_full"), 2))


def family_a(cfg: Detection) -> Hit:
    level = c("prev_high_close") * (1.0 + cfg.breakout_buffer_pct / 100.0)
    when = (
        _trend()
        & (c("close") > c("sma50"))
        & (c("close") > c("sma200"))
        & (c("close") > level)
        & (c("volume") >= cfg.volume_multiplier * c("vol_avg20"))
    )
    if cfg.stop_mode == "atr":
        stop = F.greatest(c("close") - c("atr14") * cfg.atr_multiplier, _fixed(cfg))
    elif cfg.stop_mode == "structure_atr":
        stop = F.greatest(c("low") - c("atr14") * cfg.structure_atr_buffer, _fixed(cfg))
    else:
        stop = _fixed(cfg)
    if cfg.stop_mode != "fixed_pct":
        when = when & c("atr14").isNotNull()
    plus = cfg.stop_mode != "fixed_pct" or cfg.breakout_buffer_pct > 0
    stop = F.greatest(F.lit(0.01), stop)
    return Hit(
        F.lit(f"A_{'plus_' if plus else ''}breakout_{cfg.breakout_days}d"),
        when,
        stop,
        (c("close") / c("prev_high_close") - 1.0) * 100.0,
        rounded(c("rsi_full"), 2),
        stop_for_score=rounded((c("close") - stop) / c("close") * 100.0, 2),
    )


def family_b(cfg: Detection) -> Hit:
    when = (
        _trend()
        & _known("sma20", "close_prev1", "swing_low10")
        & (c("close") > c("sma50"))
        & (c("close") <= c("sma20") * (1.0 + cfg.pullback_buffer_pct / 100.0))
        & (c("close") >= c("close_prev1") * (1.0 + cfg.rebound_min_pct / 100.0))
        & (c("volume") >= max(1.0, cfg.volume_multiplier * 0.8) * c("vol_avg20"))
    )
    stop = F.least(c("close") * 0.995, F.greatest(_fixed(cfg), c("swing_low10")))
    return Hit(F.lit("B_pullback_rebound"), when, stop, (c("sma20") / c("close") - 1.0) * 100.0, _rsi_or_fallback())


def family_c(cfg: Detection) -> Hit:
    when = (
        _trend()
        & _known("swing_low10")
        & (c("macd_prev") <= c("signal9_prev"))
        & (c("macd") > c("signal9"))
        & (_volume_ratio() >= cfg.volume_multiplier * 0.8)
    )
    setup = (c("macd") - c("signal9")) / c("close") * 100.0 * 50.0
    return Hit(F.lit("C_macd_crossover"), when, F.greatest(_fixed(cfg), c("swing_low10")), setup, _rsi_or_fallback())


def family_d(cfg: Detection) -> Hit:
    when = (
        _trend()
        & _known("swing_low10")
        & (c("rsi_prev") < cfg.rsi_threshold)
        & (c("rsi") >= cfg.rsi_threshold)
        & (_volume_ratio() >= cfg.volume_multiplier * 0.6)
    )
    setup = (c("rsi") - c("rsi_prev")) * 1.5
    return Hit(F.lit("D_rsi_bounce"), when, F.greatest(_fixed(cfg), c("swing_low10")), setup, c("rsi"))


def family_e(cfg: Detection) -> Hit:
    when = (
        _trend()
        & _known("bb_width_min")
        & c("squeeze_recent")
        & (c("close") > c("bb_upper"))
        & (_volume_ratio() >= cfg.volume_multiplier * 0.8)
    )
    setup = c("bb_width_min") / F.greatest(c("bb_width"), F.lit(0.001)) * 8.0
    return Hit(F.lit("E_boll_squeeze"), when, F.greatest(_fixed(cfg), c("sma20")), setup, _rsi_or_fallback())


def family_f(cfg: Detection) -> Hit:
    when = (
        _trend()
        & _known("swing_low10")
        & (c("close_prev1") <= c("vwap"))
        & (c("close") > c("vwap"))
        & (_volume_ratio() >= cfg.volume_multiplier)
    )
    stop = F.greatest(_fixed(cfg), c("vwap") * 0.99, c("swing_low10"))
    return Hit(F.lit("F_vwap_reclaim"), when, stop, (c("close") / c("vwap") - 1.0) * 100.0 * 5.0, _rsi_or_fallback())


def _add_pivots(features: DataFrame, cfg: Detection) -> DataFrame:
    """Pivots inside the base before each bar, oldest first (the window holds at most base_lookback bars).

    Bars may be left out of *features* unless they are pivots: a window of as many of the bars that are left reaches at least as far back.
    """
    span = cfg.pivot_span
    pivot = F.struct(
        c("bar_no").alias("no"),
        F.when(c("pivot_high"), c("high")).alias("high"),
        F.when(c("pivot_low"), c("low")).alias("low"),
        c("cum_volume").alias("cum"),
        c("volume").alias("vol"),
    )
    first, last = cfg.base_lookback - span, span + 1
    seen = F.collect_list(F.when(c("pivot_high") | c("pivot_low"), pivot)).over(frame(-first, -1))
    inside = F.filter("_seen", lambda p: (p["no"] >= c("bar_no") - first) & (p["no"] <= c("bar_no") - last))
    return features.withColumn("_seen", seen).withColumn("_pivots", inside).drop("_seen")


def _pullbacks(pivots: Column) -> Column:
    """Array of pullbacks: each pivot high with the lowest pivot low before the next pivot high."""
    nothing = F.struct(
        F.lit(None).cast("bigint").alias("no"),
        F.lit(None).cast("double").alias("high"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("depth"),
        F.lit(None).cast("double").alias("before"),
        F.lit(None).cast("double").alias("volume"),
        F.lit(None).cast("bigint").alias("bars"),
    )
    empty = F.struct(F.filter(F.array(nothing), lambda _: F.lit(False)).alias("done"), nothing.alias("cur"))

    def step(acc, p):
        cur = acc["cur"]
        closed = F.when(cur["low"].isNotNull(), F.concat(acc["done"], F.array(cur))).otherwise(acc["done"])
        opened = F.struct(
            p["no"].alias("no"),
            p["high"].alias("high"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("depth"),
            (p["cum"] - p["vol"]).alias("before"),
            F.lit(None).cast("double").alias("volume"),
            F.lit(None).cast("bigint").alias("bars"),
        )
        deeper = F.struct(
            cur["no"].alias("no"),
            cur["high"].alias("high"),
            p["low"].alias("low"),
            ((cur["high"] - p["low"]) / cur["high"] * 100.0).alias("depth"),
            cur["before"].alias("before"),
            (p["cum"] - cur["before"]).alias("volume"),
            (p["no"] - cur["no"] + 1).alias("bars"),
        )
        is_lower = cur["no"].isNotNull() & p["low"].isNotNull() & (cur["low"].isNull() | (p["low"] < cur["low"]))
        return (
            F.when(p["high"].isNotNull(), F.struct(closed.alias("done"), opened.alias("cur")))
            .when(is_lower, F.struct(acc["done"].alias("done"), deeper.alias("cur")))
            .otherwise(acc)
        )

    def finish(acc):
        return F.when(acc["cur"]["low"].isNotNull(), F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])

    return F.aggregate(pivots, empty, step, finish)


def _breakout() -> Column:
    """Closes above its 20-bar high in an uptrend."""
    return _trend() & (c("close") > c("sma50")) & (c("close") > c("high20")) & c("swing_low10").isNotNull()


def with_contractions(features: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """Add the last three pullbacks of the base to bars that close above their 20-bar high in an uptrend."""
    out = _add_pivots(features, cfg).withColumn("_pulls", F.when(_breakout(), _pullbacks(c("_pivots"))))
    return out.withColumn("pulls", F.when(F.size("_pulls") >= 3, F.slice("_pulls", -3, 3))).drop("_pulls", "_pivots")


def _candidates(features: DataFrame, families: tuple, cfg: Detection, detectors: dict) -> DataFrame:
    """The bars at which a family may hit, with the contractions if family G is wanted: few bars, so that what follows sees few.

    The conditions of the built-in families but G need nothing but features. A plug-in may read the contractions too, so all bars stay for it.
    """
    contractions = "G" in families
    if any(f not in DETECTORS for f in families):
        return with_contractions(features, cfg) if contractions else features
    may = [_breakout() if f == "G" else detectors[f](cfg).when for f in families]
    hit = F.coalesce(reduce(or_, may), F.lit(False))
    if not contractions:
        return features.filter(hit)
    kept = features.withColumn("_may", hit).filter(c("_may") | c("pivot_high") | c("pivot_low"))
    seen = _add_pivots(kept, cfg).filter("_may").drop("_may")
    pulls = seen.withColumn("_pulls", F.when(_breakout(), _pullbacks(c("_pivots"))))
    return pulls.withColumn("pulls", F.when(F.size("_pulls") >= 3, F.slice("_pulls", -3, 3))).drop("_pulls", "_pivots")


def family_g(cfg: Detection) -> Hit:
    first, second, last = (c("pulls")[i] for i in range(3))
    resistance = F.greatest(c("high20"), first["high"], second["high"], last["high"])
    when = (
        c("pulls").isNotNull()
        & (first["depth"] > second["depth"])
        & (second["depth"] > last["depth"])
        & (second["depth"] <= first["depth"] * 0.9)
        & (last["depth"] <= second["depth"] * 0.9)
        & (c("close") > resistance)
        & (_volume_ratio() >= min(cfg.volume_multiplier, 1.2))
        & (last["volume"] / last["bars"] / c("vol_avg20") <= cfg.dryup_volume_ratio)
    )
    stop = F.least(c("close") * 0.995, F.greatest(_fixed(cfg), last["low"], c("swing_low10")))
    setup = F.greatest(F.lit(0.0), (first["depth"] - last["depth"]) / F.greatest(first["depth"], F.lit(0.01)) * 100.0)
    return Hit(F.lit("G_vcp_breakout"), when, stop, setup, _rsi_or_fallback())


DETECTORS = {"A": family_a, "B": family_b, "C": family_c, "D": family_d, "E": family_e, "F": family_f, "G": family_g}

# Feature columns a signal keeps, so later scoring steps need no second join to the bars.
CONTEXT = (
    "bar_no", "open", "high", "low", "close", "close_prev1", "prev_high_close", "sma20", "sma50", "sma200", "gap_pct",
    "prev_gap_pct", "range_vs_atr", "prev_range_vs_atr", "atr14", "ret_1", "ret_3", "ret_5", "ret_20", "ret_60",
    "dist_52w_high_pct", "prev20_close", "rsi_full", "low5_recent", "low10_recent", "ema20", "close_vwap20",
)
SIGNAL_COLUMNS = (
    "signal_date", "ticker", "pattern", "pattern_family", "entry_price", "stop_pct", "stop_price", "score_trend",
    "score_setup", "score_volume", "score_risk", "score_rsi", "sma50_slope_pct", "ma_slope_bonus", "signal_score",
)


def _emit(family: str, hit: Hit) -> Column:
    stop_pct = (c("close") - hit.stop) / c("close") * 100.0
    trend_pct = (c("sma50") / c("sma200") - 1.0) * 100.0
    parts = component_columns(
        trend_pct, hit.setup_pct, _volume_ratio(), hit.stop_for_score if hit.stop_for_score is not None else stop_pct, hit.rsi
    )
    row = F.struct(
        hit.name.alias("pattern"),
        F.lit(family).alias("pattern_family"),
        rounded(c("close"), 4).alias("entry_price"),
        rounded(stop_pct, 2).alias("stop_pct"),
        rounded(hit.stop, 4).alias("stop_price"),
        *[v.alias(k) for k, v in parts.items()],
    )
    return F.when(hit.when, row)


def detect(features: DataFrame, families: tuple = FAMILIES, cfg: Detection = Detection(), context: tuple = (), detectors: dict | None = None) -> DataFrame:
    """Signals of *families* for every date at once; *detectors* are the built-in ones unless given."""
    detectors = detectors or DETECTORS
    source = _candidates(features, families, cfg, detectors)
    hits = F.array_compact(F.array(*[_emit(f, detectors[f](cfg)) for f in families]))
    keep = list(dict.fromkeys(("ticker", "date", "sma50_slope_pct", *context)))
    rows = source.select(*keep, F.explode(hits).alias("_hit")).select(*keep, "_hit.*")
    bonus = slope_bonus(c("sma50_slope_pct"))
    rows = rows.withColumns(
        {
            "ma_slope_bonus": bonus,
            "signal_score": rounded(clip_score(c("component_score") + bonus), 1),
            "signal_date": c("date"),
            "sma50_slope_pct": F.when(c("sma50_slope_pct") > 0, rounded(c("sma50_slope_pct"), 2)),
        }
    )
    return rows.select(*SIGNAL_COLUMNS, *context)


def add_consensus(signals: DataFrame, bonus: float = 5.0) -> DataFrame:
    """Distinct families per (date, ticker), with a bonus when several agree. A group holds at most a few patterns."""
    same_day = Window.partitionBy("ticker", "signal_date")
    n = F.size(F.collect_set("pattern_family").over(same_day)).cast("long")
    out = signals.withColumn("consensus_count", n)
    lifted = clip_score(c("signal_score") + bonus)
    return out.withColumn("signal_score", F.when(c("consensus_count") > 1, lifted).otherwise(c("signal_score")))


def scan(features: DataFrame, cfg: Detection = Detection(), families: tuple = FAMILIES, context: tuple = CONTEXT,
         weights: DataFrame | None = None, from_date: str | None = None) -> DataFrame:
    """Full detection: all families, consensus bonus, and the learned family bonus when given."""
    out = detect(features, families, cfg, context)
    if from_date is not None:
        out = out.filter(c("signal_date") >= F.lit(from_date).cast("date"))
    out = add_consensus(out, cfg.consensus_bonus)
    return apply_family_bonus(out, weights) if weights is not None else out


def detect_long_term(features: DataFrame, cfg: Detection = Detection(), *, vectorised: bool = True,
                     family_weight: float = 0.0, family_score: float = 0.0) -> DataFrame:
    """Breakouts entered at the next open with a fixed stop; the component RSI is the plain value.

    ``vectorised`` weights the rounded components, the per-date form weights the unrounded ones and takes the
    RSI rounded to two digits.
    """
    hit = family_a(cfg)
    entry, stop = c("next_open"), c("next_open") * (1.0 - cfg.stop_pct / 100.0)
    raw = {
        "trend": clip_score(50.0 + (c("sma50") / c("sma200") - 1.0) * 100.0 * 5.0),
        "setup": clip_score(50.0 + (c("close") / c("prev_high_close") - 1.0) * 100.0 * 8.0),
        "volume": clip_score(40.0 + _volume_ratio() * 20.0),
        "risk": clip_score(100.0 - (entry - stop) / entry * 100.0 * 6.0),
        "rsi": clip_score(F.coalesce(c("rsi_full") if vectorised else rounded(c("rsi_full"), 2), F.lit(50.0))),
    }
    weights = {"trend": 0.20, "setup": 0.20, "volume": 0.13, "risk": 0.14, "rsi": 0.03}
    rows = features.filter(hit.when).select(
        c("date").alias("signal_date"), "ticker", F.lit(f"A_breakout_{cfg.breakout_days}d").alias("pattern"),
        F.lit("A").alias("pattern_family"), rounded(entry, 4).alias("entry_price"),
        rounded(entry * 0.99, 4).alias("entry_band_low"), rounded(entry * 1.01, 4).alias("entry_band_high"),
        F.lit(cfg.stop_pct).alias("stop_pct"), rounded(stop, 4).alias("stop_price"),
        rounded(c("close"), 4).alias("close"), rounded(c("sma50"), 4).alias("sma50"), rounded(c("sma200"), 4).alias("sma200"),
        rounded(c("prev_high_close"), 4).alias("prev_high_close"), c("volume").cast("long").alias("volume"),
        rounded(c("vol_avg20"), 2).alias("vol_avg20"), slope_bonus(c("sma50_slope_pct")).alias("ma_slope_bonus"),
        rounded(c("sma50_slope_pct"), 2).alias("sma50_slope_pct"),
        *[rounded(v, 1).alias(f"score_{k}") for k, v in raw.items()], *[v.alias(f"_raw_{k}") for k, v in raw.items()],
    )
    prefix = "score_" if vectorised else "_raw_"
    total = sum((w * c(prefix + k) for k, w in weights.items()), F.lit(0.0))
    with_bonus = rounded(clip_score(rounded(total, 1) + c("ma_slope_bonus")), 1)
    return rows.withColumns(
        {
            "score_pattern": F.lit(round(family_score, 1)),
            "pattern_bonus": F.lit(round(family_weight, 2)),
            "signal_score": rounded(clip_score(with_bonus + family_weight), 1),
            "consensus_count": F.lit(1).cast("long"),
        }
    ).drop(*[f"_raw_{k}" for k in raw])


def combo_key(signals: DataFrame) -> DataFrame:
    """Family set of each (date, ticker) as a sorted key and cohort label."""
    fams = F.array_sort(F.collect_set("pattern_family"))
    out = signals.groupBy("signal_date", "ticker").agg(fams.alias("families"))
    key = F.array_join("families", "+")
    return out.select(
        "signal_date",
        "ticker",
        key.alias("combo_key"),
        F.size("families").cast("long").alias("family_count"),
        F.arrays_overlap("families", F.array(F.lit("A"))).alias("has_a"),
        (F.size(F.array_intersect("families", F.array(F.lit("A"), F.lit("C")))) == 2).alias("has_target_pair"),
        F.when(F.size("families") == 1, F.concat(key, F.lit("_only"))).otherwise(key).alias("cohort"),
    )


def best_per_event(signals: DataFrame) -> DataFrame:
    """Highest score per (date, ticker), family order breaking ties; aggregated map-side before the shuffle."""
    others = [x for x in signals.columns if x not in ("signal_date", "ticker")]
    rank = F.struct((-F.coalesce("signal_score", F.lit(0.0))).alias("s"), c("pattern_family").alias("f"), c("pattern").alias("p"))
    best = signals.groupBy("signal_date", "ticker").agg(F.min_by(F.struct(*others), rank).alias("_b"))
    return best.select("signal_date", "ticker", "_b.*")
