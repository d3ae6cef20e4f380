"""Row-context penalty features and their bucket lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.functions.columns import business_ordinal, clip_score, pct_change, positive, rounded

c = F.col
GLOBAL = "__global__"
FEATURES = {
    "feature_recent_signal_count": "crowding",
    "feature_close_vs_prev_high_pct": "extension",
    "feature_close_vs_sma50_pct": "extension",
    "feature_exhaustion_risk": "extension",
    "feature_gap_pct": "gap_shock",
    "feature_range_vs_atr": "gap_shock",
    "feature_gap_sequence_risk": "gap_shock",
}


def recent_counts(signals: DataFrame, lookbacks: dict[str, int]) -> DataFrame:
    """Earlier signals of the instrument dated after d minus n business days, one column per lookback, in one pass.

    Rows of one instrument are ordered by (date, pattern); a group holds at most a few patterns per calendar day.
    """
    out = signals.withColumn("_u", business_ordinal(c("signal_date")))
    position = F.row_number().over(Window.partitionBy("ticker").orderBy("signal_date", "pattern")) - 1
    by_day = Window.partitionBy("ticker").orderBy("_u")
    stale = {
        name: F.count("*").over(by_day.rangeBetween(Window.unboundedPreceding, -n)) for name, n in lookbacks.items()
    }
    return out.withColumn("_p", position).withColumns({k: F.greatest(c("_p") - v, F.lit(0)).cast("long") for k, v in stale.items()}).drop("_u", "_p")


def penalty_features(signals: DataFrame, lookback: int = 20) -> DataFrame:
    """Seven features from the bar context each signal carries."""
    vs = lambda base: F.when(c(base) > 0, pct_change(c("close"), c(base)))
    out = recent_counts(signals, {"feature_recent_signal_count": lookback}).withColumns(
        {
            "_cvh": vs("prev_high_close"),
            "_c20": vs("sma20"),
            "feature_close_vs_sma50_pct": rounded(vs("sma50"), 4),
            "feature_gap_pct": rounded(c("gap_pct"), 4),
            "feature_range_vs_atr": rounded(c("range_vs_atr"), 4),
            "_gaps": positive(c("gap_pct")) + 0.7 * positive(c("prev_gap_pct")) + positive(c("range_vs_atr") - 1.0)
            + 0.7 * positive(c("prev_range_vs_atr") - 1.0),
        }
    )
    tired = (
        positive(c("_cvh")) + 0.6 * positive(c("_c20")) + 0.3 * positive(c("feature_close_vs_sma50_pct"))
        + 0.45 * positive(c("ret_3")) + 0.25 * positive(c("ret_5"))
    )
    return out.withColumns(
        {
            "feature_close_vs_prev_high_pct": rounded(c("_cvh"), 4),
            "feature_gap_sequence_risk": F.when(c("_gaps") > 0, rounded(c("_gaps"), 4)),
            "feature_exhaustion_risk": F.when(tired > 0, rounded(tired, 4)),
        }
    ).drop("_cvh", "_c20", "_gaps")


def _with_buckets(signals: DataFrame, buckets: DataFrame) -> DataFrame:
    """Signals with their buckets as one map keyed feature|family, per lookback where both tables know one.

    At most lookbacks rows of features x families x quantiles entries, joined once.
    """
    keys = ["lookback"] if "lookback" in signals.columns and "lookback" in buckets.columns else []
    entry = F.struct("lower", "upper", "include_upper", "penalty")
    per_key = buckets.groupBy(*keys, F.concat_ws("|", "feature", "family").alias("k")).agg(F.array_sort(F.collect_list(entry)).alias("v"))
    index = per_key.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_index"))
    if not keys:
        keys, signals, index = ["_all"], signals.withColumn("_all", F.lit(0)), index.withColumn("_all", F.lit(0))
    return signals.join(F.broadcast(index), keys, "left").drop("_all")


def _lookup(feature: str, index: Column) -> Column:
    family = F.upper(F.trim("pattern_family"))
    spec = F.coalesce(F.try_element_at(index, F.concat(F.lit(f"{feature}|"), family)), F.try_element_at(index, F.lit(f"{feature}|{GLOBAL}")))
    x = c(feature).cast("double")
    holds = lambda b: (x >= b["lower"]) & F.when(b["include_upper"], x <= b["upper"]).otherwise(x < b["upper"])
    return F.coalesce(F.try_element_at(F.filter(spec, holds), F.lit(1))["penalty"], F.lit(0.0))


def apply_penalties(signals: DataFrame, buckets: DataFrame) -> DataFrame:
    """Sum bucket penalties per group; a family without its own buckets uses the global ones; replay is idempotent."""
    old = F.coalesce("score_penalty_total", F.lit(0.0)) if "score_penalty_total" in signals.columns else F.lit(0.0)
    out = _with_buckets(signals.withColumn("_base", F.coalesce("signal_score", F.lit(0.0)) - old), buckets)
    parts = {g: sum((_lookup(f, c("_index")) for f, owner in FEATURES.items() if owner == g), F.lit(0.0)) for g in ("crowding", "extension", "gap_shock")}
    out = out.withColumns({f"score_penalty_{g}": rounded(v, 2) for g, v in parts.items()})
    total = rounded(c("score_penalty_crowding") + c("score_penalty_extension") + c("score_penalty_gap_shock"), 2)
    return (
        out.withColumn("score_penalty_total", total)
        .withColumn("signal_score", rounded(clip_score(c("_base") + c("score_penalty_total")), 1))
        .drop("_base", "_index")
    )
