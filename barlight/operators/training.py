"""Training table, sample weights, and the weights learned from outcomes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.config import FAMILIES, Outcome, PenaltyLearning
from barlight.functions.columns import as_int, clip, clip_score, rounded
from barlight.functions.ranks import cumulative_counts
from barlight.operators import outcomes as oc
from barlight.operators.markov import recency_weight
from barlight.operators.penalties import FEATURES, GLOBAL, apply_penalties, penalty_features, recent_counts

c = F.col


def date_window(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Inclusive date filter; rows without a date go when either bound is given."""
    out = df if start is None and end is None else df.filter(c(column).isNotNull())
    if start is not None:
        out = out.filter(c(column) >= F.lit(start).cast("date"))
    return out if end is None else out.filter(c(column) <= F.lit(end).cast("date"))


def add_recency_weight(df: DataFrame, column: str = "signal_date", half_life_months: float = 12.0, name: str = "sample_weight") -> DataFrame:
    return df.withColumn(name, recency_weight(c(column), df.agg(F.max(column)).scalar(), half_life_months))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean of known values over positive weights, 0 when there are none."""
    used = value.isNotNull() & (weight > 0)
    total = F.sum(F.when(used, weight))
    return F.coalesce(F.sum(F.when(used, weight * value)) / F.nullif(total, F.lit(0.0)), F.lit(0.0))


def training_history(signals: DataFrame, bars: DataFrame, cfg: Outcome = Outcome(), lookback: int = 20, lookbacks: tuple = (5, 10, 20, 40)) -> DataFrame:
    """Signals with features, outcome, stop labels, month and the count at every lookback.

    One forward scan serves all labels, and all lookback counts come from one window pass.
    """
    featured = recent_counts(penalty_features(signals, lookback), {f"feature_recent_signal_count_{n}d": n for n in lookbacks})
    t = oc.forward_outcome(oc.touches(featured, bars, cfg))
    before = c("stop_day").isNotNull() & (c("target_day").isNull() | (c("stop_day") <= c("target_day")))
    seen = c("bars_available") > 0
    old_penalty = F.coalesce("score_penalty_total", F.lit(0.0)) if "score_penalty_total" in signals.columns else F.lit(0.0)
    return t.withColumns(
        {
            "stop_before_target": F.when(seen, as_int(before)),
            "stop_within_5d": F.when(seen, as_int(before & (c("stop_day") <= 5))),
            "gap_through_stop": F.when(seen, as_int(c("first_open") <= c("stop"))),
            "mae_exceeds_stop": F.when(seen, as_int(c("lowest_low") <= c("stop"))),
            "target_price": rounded(c("target"), 6),
            "effective_stop_price": rounded(c("stop"), 6),
            "signal_score_pre_penalty": rounded(c("signal_score") - old_penalty, 4),
            "month": F.date_format("signal_date", "yyyy-MM"),
        }
    )


def _rate(outcome: str) -> Column:
    return weighted_mean(as_int(c("outcome") == outcome).cast("double"), c("_w"))


def _weighted(df: DataFrame, weight: str | None) -> DataFrame:
    return df.withColumn("_w", F.coalesce(c(weight), F.lit(0.0)) if weight else F.lit(1.0))


def family_weights(outcomes: DataFrame, weight: str | None = None, min_samples: int = 5, scale: float = 4.0, cap: float = 30.0, confidence: int = 100) -> DataFrame:
    """One row per family: rates against the overall baseline, confidence, score and weight."""
    known = _weighted(outcomes.filter(c("pattern_family").isin(*FAMILIES)), weight)
    # Global and per-family statistics in one aggregation over doubled keys; at most eight groups.
    scoped = known.withColumn("family", F.explode(F.array(c("pattern_family"), F.lit(GLOBAL))))
    stats = scoped.groupBy("family").agg(F.count("*").alias("n"), _rate("win").alias("wr"), _rate("loss").alias("lr"))
    base = F.first(F.when(c("family") == GLOBAL, c("wr")), ignorenulls=True).over(Window.partitionBy(F.lit(1)))
    total = F.max(F.when(c("family") == GLOBAL, c("n"))).over(Window.partitionBy(F.lit(1)))
    out = stats.withColumns({"baseline": base, "total": total}).filter(c("family") != GLOBAL)
    conf = F.least(F.lit(1.0), c("n") / float(max(1, confidence)))
    edge = (c("wr") - c("baseline")) * 100.0
    score = rounded(clip_score(50.0 + edge * conf * scale), 1)
    enough = c("n") >= min_samples
    out = out.withColumn("score_pattern", F.when(enough, score).otherwise(F.lit(0.0)))
    weight_col = F.when(enough, rounded(F.least(F.lit(cap), c("score_pattern") / 100.0 * cap), 1)).otherwise(F.lit(0.0))
    return out.select(
        "family", c("n").alias("count"), rounded(c("n") / c("total") * 100.0, 1).alias("pct_of_signals"),
        rounded(c("wr") * 100.0, 1).alias("win_rate"), rounded(c("lr") * 100.0, 1).alias("loss_rate"), rounded(edge, 1).alias("edge_pp"),
        rounded(conf, 2).alias("confidence"), "score_pattern", weight_col.alias("weight"),
    )


# ---- penalty buckets ----------------------------------------------------------------------------------------------
def long_features(training: DataFrame, weight: str | None = None) -> DataFrame:
    """One row per (signal, feature, scope) with a known value; scope is the family and the global pool."""
    keys = ["lookback"] if "lookback" in training.columns else []
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), c(f).cast("double").alias("x")) for f in FEATURES])
    scopes = F.array(c("pattern_family"), F.lit(GLOBAL))
    rows = _weighted(training, weight).select(*keys, "outcome", "_w", scopes.alias("scopes"), F.explode(cells).alias("cell"))
    return rows.select(*keys, "outcome", "_w", F.explode("scopes").alias("family"), "cell.feature", "cell.x").filter(c("x").isNotNull())


def quantile_edges(long: DataFrame, keys: list[str], buckets: int = 5, min_samples: int = 1) -> DataFrame:
    """Equal-frequency edges per group: keys, n, anchor (median) and the distinct edges in order.

    The number of buckets falls to the number of distinct values; repeated edges are dropped.
    """
    cum = cumulative_counts(long, keys, "x")
    stats = cum.groupBy(*keys).agg(F.max("total").alias("_n"), F.least(F.lit(buckets), F.count("*")).cast("int").alias("_q"))
    stats = stats.filter(c("_n") >= min_samples)
    # Groups are few (features x families x lookbacks), so their sizes travel to the slices.
    rows = cum.join(F.broadcast(stats), keys)
    wanted = F.concat(F.transform(F.sequence(F.lit(0), c("_q")), lambda i: i / c("_q")), F.array(F.lit(0.5)))
    rows = rows.withColumn("_w", F.arrays_zip(F.sequence(F.lit(0), c("_q") + 1).alias("i"), wanted.alias("p"))).withColumn("_w", F.explode("_w"))
    pos = c("_w.p") * (c("total") - 1)
    inside = lambda k: (c("below") <= k) & (k < c("below") + c("n"))
    at = lambda k: F.max(F.when(inside(k), c("x")))
    hit = rows.filter(inside(F.floor(pos + 1e-9)) | inside(F.ceil(pos - 1e-9)))
    points = hit.groupBy(*keys, "_n", "_q", c("_w.i").alias("i")).agg(
        at(F.floor(pos + 1e-9)).alias("lo"), at(F.ceil(pos - 1e-9)).alias("hi"), F.max(pos - F.floor(pos + 1e-9)).alias("t")
    )
    value = rounded(c("lo") + (c("hi") - c("lo")) * F.greatest(c("t"), F.lit(0.0)), 6)
    edge = F.when(c("i") <= c("_q"), value)
    return points.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.array_sort(F.collect_set(edge)).alias("edges"), F.max(F.when(c("i") > c("_q"), value)).alias("anchor")
    )


def bucket_ranges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive edges as half-open buckets, the last one closed; a single value is one closed bucket."""
    last = F.size("edges") - 1
    pairs = F.when(last == 0, F.array(F.struct(c("edges")[0].alias("lower"), c("edges")[0].alias("upper"), F.lit(True).alias("include_upper")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))),
            lambda i: F.struct(F.get("edges", i).alias("lower"), F.get("edges", i + 1).alias("upper"), (i == last - 1).alias("include_upper")),
        )
    )
    return edges.select(*keys, "n", "anchor", F.explode(pairs).alias("b")).select(*keys, "n", "anchor", "b.*")


def penalty_buckets(training: DataFrame, cfg: PenaltyLearning = PenaltyLearning(), weight: str | None = None) -> DataFrame:
    """Loss-heavy buckets of every feature, per family and overall, in one job."""
    keys = [*(["lookback"] if "lookback" in training.columns else []), "feature", "family"]
    long = long_features(training, weight)
    ranges = bucket_ranges(quantile_edges(long, keys, cfg.quantiles, cfg.min_samples), keys)
    inside = (c("x") >= c("lower")) & F.when(c("include_upper"), c("x") <= c("upper")).otherwise(c("x") < c("upper"))
    # Bounded: lookbacks x features x (families + 1) x quantiles rows.
    matched = long.join(F.broadcast(ranges), keys).filter(inside)
    stats = matched.groupBy(*keys, "lower", "upper", "include_upper", "anchor").agg(
        F.count("*").alias("count"), _rate("win").alias("win"), _rate("loss").alias("loss")
    )
    edge, conf = c("win") - c("loss"), F.least(F.lit(1.0), c("count") / float(max(1, cfg.confidence_samples)))
    adverse = (c("lower") + c("upper")) / 2.0 >= c("anchor")
    raw = F.when(adverse & (edge < 0), -edge * cfg.edge_scale * conf).otherwise(F.lit(0.0))
    return stats.select(
        *keys, "lower", "upper", "include_upper", "count", rounded(c("win"), 4).alias("win_rate"), rounded(c("loss"), 4).alias("loss_rate"),
        rounded(edge, 4).alias("edge"), rounded(conf, 4).alias("confidence"), adverse.alias("is_adverse_tail"), (0.0 - rounded(raw, 2)).alias("penalty"),
    )


def by_lookback(training: DataFrame, lookbacks: tuple) -> DataFrame:
    """Training rows once per candidate lookback, with that lookback's signal count."""
    options = F.array(*[F.struct(F.lit(n).cast("long").alias("lookback"), c(f"feature_recent_signal_count_{n}d").alias("v")) for n in lookbacks])
    out = training.withColumn("_o", F.explode(options))
    return out.withColumns({"lookback": c("_o.lookback"), "feature_recent_signal_count": c("_o.v")}).drop("_o")


def select_lookback(training: DataFrame, cfg: PenaltyLearning = PenaltyLearning(), weight: str | None = None) -> DataFrame:
    """Score every lookback by the edge of the best signal per day and of signals above the threshold; flag the winner."""
    options = by_lookback(training, cfg.lookbacks)
    scored = _weighted(apply_penalties(options, penalty_buckets(options, cfg, weight)), weight)
    rates = lambda p: {f"{p}_win": _rate("win"), f"{p}_loss": _rate("loss")}
    best = F.min_by(F.struct("outcome", "_w"), F.struct((-c("signal_score")).alias("s"), "ticker", "pattern"))
    top = scored.groupBy("lookback", "signal_date").agg(best.alias("b")).select("lookback", "b.*")
    top = top.groupBy("lookback").agg(*[v.alias(k) for k, v in rates("top1").items()])
    high = scored.filter(c("signal_score") >= cfg.score_threshold)
    high = high.groupBy("lookback").agg(F.count("*").alias("threshold_count"), *[v.alias(k) for k, v in rates("thr").items()])
    size = scored.groupBy("lookback").agg(F.count("*").alias("signals"))
    out = size.join(top, "lookback").join(high, "lookback", "left").na.fill(0, ["threshold_count", "thr_win", "thr_loss"])
    score = cfg.top1_weight * (c("top1_win") - c("top1_loss")) + cfg.threshold_weight * (c("thr_win") - c("thr_loss"))
    out = out.withColumn("selection_score", rounded(score, 6))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("selection_score"), "lookback")
    return out.select(
        "lookback", "signals", "selection_score", *[rounded(c(x), 4).alias(x) for x in ("top1_win", "top1_loss", "thr_win", "thr_loss")],
        "threshold_count", (F.row_number().over(order) == 1).alias("selected"),
    )


# ---- candle weights -----------------------------------------------------------------------------------------------
def half_points(x: Column) -> Column:
    return rounded(x * 2, 0) / 2


def candle_marginals(rows: DataFrame, flags: tuple, weight: str | None = None, min_samples: int = 3, scale: float = 0.5, cap: float = 10.0) -> DataFrame:
    """Win rate with and without each flag, per family and overall: one aggregation over unpivoted flags."""
    cells = F.array(*[F.struct(F.lit(f).alias("flag"), c(f).alias("on")) for f in flags])
    long = _weighted(rows, weight).select("outcome", "_w", "pattern_family", F.explode(cells).alias("cell"))
    long = long.select("outcome", "_w", F.explode(F.array("pattern_family", F.lit(GLOBAL))).alias("scope"), "cell.flag", "cell.on")
    win, loss = as_int(c("outcome") == "win").cast("double"), as_int(c("outcome") == "loss").cast("double")
    side = lambda cond, v: weighted_mean(F.when(cond, v), c("_w"))
    on, off = c("on"), ~c("on")
    s = long.groupBy("scope", "flag").agg(
        F.count_if(on).alias("count"), F.count("*").alias("total"), weighted_mean(win, c("_w")).alias("base"), F.count_if(off).alias("n_off"),
        side(on, win).alias("wr_on"), side(on, loss).alias("lr_on"), side(off, win).alias("wr_off"), side(off, loss).alias("lr_off"),
    )
    edge = (c("wr_on") - c("base")) * 100.0
    enough = c("count") >= min_samples
    pct = lambda v: F.when(enough, rounded(v * 100.0, 1))
    return s.select(
        "scope", "flag", "count", pct(c("wr_on")).alias("win_rate_with"), pct(c("lr_on")).alias("loss_rate_with"),
        pct(F.when(c("n_off") > 0, c("wr_off")).otherwise(c("base"))).alias("win_rate_without"),
        pct(F.when(c("n_off") > 0, c("lr_off")).otherwise(0.0)).alias("loss_rate_without"),
        F.when(enough, rounded(edge, 1)).alias("edge_pp"),
        F.when(enough, F.least(half_points(F.greatest(F.lit(0.0), edge * scale)), F.lit(cap))).otherwise(F.lit(0.0)).alias("weight"),
    )


def candle_compare(marginals: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Old and new definition of a shape side by side (overall scope)."""
    pool = marginals.filter(c("scope") == GLOBAL)
    names = F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in pairs.items()])
    rows = pool.withColumn("_p", F.explode(names)).filter(c("flag").isin(*{x for p in pairs.values() for x in p}))
    pick = lambda side, col: F.max(F.when(c("flag") == c(f"_p.{side}"), c(col)))
    out = rows.groupBy(c("_p.pair").alias("pair")).agg(
        *[pick(s, x).alias(f"{n}_{x}") for s, n in (("a", "old"), ("b", "new")) for x in ("count", "win_rate_with", "edge_pp", "weight")]
    )
    return out.withColumns(
        {
            "sample_change": c("new_count") - c("old_count"),
            "win_rate_lift_pp": rounded(c("new_win_rate_with") - c("old_win_rate_with"), 1),
            "edge_lift_pp": rounded(c("new_edge_pp") - c("old_edge_pp"), 1),
        }
    )


def gram(df: DataFrame, columns: list[str], label: str, weight: Column, keys: list[str]) -> list:
    """Weighted second moments of [1, columns, label] per key in one aggregation. Few keys, (k+2)^2/2 sums each."""
    names = ["_one", *columns, label]
    cells = {x: c(x).cast("double") for x in (*columns, label)} | {"_one": F.lit(1.0)}
    sums = [F.sum(weight * cells[a] * cells[b]).alias(f"m{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return df.groupBy(*keys).agg(*sums).collect()


def solve_ridge(row, size: int, alpha: float) -> np.ndarray:
    """Coefficients of a ridge fit (free intercept) from one row of gram()."""
    m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], dtype=float)
    penalty = np.eye(size - 1) * alpha
    penalty[0, 0] = 0.0
    return np.linalg.pinv(m[:-1, :-1] + penalty) @ m[:-1, -1]


def _closed_by_scope(rows: DataFrame, weight: str | None) -> DataFrame:
    closed = _weighted(rows.filter(c("outcome").isin("win", "loss")), weight).withColumn("_y", as_int(c("outcome") == "win"))
    return closed.withColumn("scope", F.explode(F.array("pattern_family", F.lit(GLOBAL))))


def overlap_coefficients(rows: DataFrame, flags: tuple, weight: str | None = None, alpha: float = 8.0, digits: int = 10) -> dict[str, list[float]]:
    """Intercept and flag coefficients of the ridge model of each scope."""
    fits = gram(_closed_by_scope(rows, weight), list(flags), "_y", c("_w"), ["scope"])
    return {row["scope"]: [round(float(b), digits) for b in solve_ridge(row, len(flags) + 2, alpha)] for row in sorted(fits, key=lambda r: r["scope"])}


def candle_overlap(rows: DataFrame, flags: tuple, weight: str | None = None, scale: float = 0.5, cap: float = 10.0, alpha: float = 8.0, shrink: float = 6.0, coefficients: dict[str, list[float]] | None = None) -> DataFrame:
    """Ridge linear probability model on all flags at once, shrunk by sample size, per family and overall.

    *coefficients* come from a stored fit; without them the model is fitted here. Column residual says how far each is from the optimum
    on these rows: X'W(y - Xb) - alpha b over the sum of weights, zero (to the digits of the coefficients) where it is one.
    """
    out = []
    for row in gram(_closed_by_scope(rows, weight), list(flags), "_y", c("_w"), ["scope"]):
        beta = solve_ridge(row, len(flags) + 2, alpha) if coefficients is None else coefficients.get(row["scope"])
        if beta is None:
            continue
        m = lambda i, j: float(row[f"m{min(i, j)}_{max(i, j)}"])
        for i, flag in enumerate(flags, start=1):
            n = m(i, i)
            share = n / (n + shrink) if n > 0 else 0.0
            pp = float(beta[i]) * 100.0
            half = round(max(-cap, min(cap, pp * share * scale)) * 2) / 2
            rest = (m(i, len(flags) + 1) - sum(m(i, j) * float(b) for j, b in enumerate(beta)) - alpha * float(beta[i])) / m(0, 0)
            out.append((row["scope"], flag, n, round(pp, 2), round(pp * share, 2), round(share, 3), half, rest))
    return rows.sparkSession.createDataFrame(
        out, "scope string, flag string, fit_weight double, coef_pp double, coef_pp_shrunk double, shrinkage double, weight double, residual double"
    )
