"""Ranking metrics, blends, walk-forward evaluation and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.functions.columns import as_int, business_ordinal, rounded
from barlight.functions.ranks import add_average_rank, quantiles, rank_auc, spearman
from barlight.session import durable

c = F.col


def ranking_metrics(rows: DataFrame, keys: list[str], score: str, ret: str = "return_pct", status: str = "status") -> DataFrame:
    """AUC, rank correlation with return, and top/bottom quintile spreads for every group in one set of jobs.

    *rows* must be materialised by the caller when it is expensive: it is read by four aggregations.
    """
    closed = rows.filter(c(status).isin("target", "stop")).withColumn("_hit", as_int(c(status) == "target"))
    auc = rank_auc(closed, score, "_hit", tuple(keys)).select(*keys, "auc")
    ic = spearman(rows, score, ret, tuple(keys)).select(*keys, c("rank_corr").alias("rank_ic"))
    cuts = quantiles(rows, keys, score, {"q_low": 0.2, "q_high": 0.8}).select(*keys, "q_low", "q_high")
    joined = rows.join(cuts, keys)
    top, bottom, done = c(score) >= c("q_high") - 1e-9, c(score) <= c("q_low") + 1e-9, c(status).isin("target", "stop")
    hit = F.when(done, as_int(c(status) == "target") * 100.0)
    spread = joined.groupBy(*keys).agg(
        F.count("*").alias("n_scored"),
        F.count_if(done).alias("n_closed_scored"),
        (F.avg(F.when(top, hit)) - F.avg(F.when(bottom, hit))).alias("win_rate_lift_pp"),
        (F.avg(F.when(top, c(ret))) - F.avg(F.when(bottom, c(ret)))).alias("return_spread_pct"),
    )
    return spread.join(auc, keys, "left").join(ic, keys, "left")


METRICS = ("auc", "rank_ic", "win_rate_lift_pp", "return_spread_pct")


def add_deltas(metrics: DataFrame, key: str, baseline: str) -> DataFrame:
    """Difference of every metric to the baseline row."""
    base = lambda m: F.max(F.when(c(key) == baseline, c(m))).over(Window.partitionBy(F.lit(1)))
    return metrics.withColumns({f"{m}_delta": c(m) - base(m) for m in METRICS})


def explode_scores(rows: DataFrame, scores: dict[str, Column], keep: tuple = ("return_pct", "status"), key: str = "mode") -> DataFrame:
    """One row per (row, score definition): a whole comparison becomes a grouping key."""
    cells = F.array(*[F.struct(F.lit(k).alias(key), v.cast("double").alias("score")) for k, v in scores.items()])
    return rows.select(*keep, F.explode(cells).alias("_c")).select(*keep, f"_c.{key}", "_c.score").filter(c("score").isNotNull())


def blend_grid(two: list[tuple[str, str]], three: tuple[str, str, str] | None = None, step2: float = 0.05, step3: float = 0.1) -> dict[str, dict[str, float]]:
    """Named weight vectors: pairs on a fine grid and one triple on a coarse simplex."""
    grid: dict[str, dict[str, float]] = {}
    n = round(1 / step2)
    for a, b in two:
        for i in range(n + 1):
            grid[f"{a}+{b}@{i * step2:.2f}"] = {a: round(1 - i * step2, 2), b: round(i * step2, 2)}
    if three:
        m = round(1 / step3)
        for i in range(m + 1):
            for j in range(m + 1 - i):
                w = (round(i * step3, 1), round(j * step3, 1), round(1 - i * step3 - j * step3, 1))
                grid["+".join(three) + f"@{w[0]:.1f}/{w[1]:.1f}"] = dict(zip(three, w))
    return grid


def score_counts(rows: DataFrame, scores: dict[str, Column], key: str, ret: str = "return_pct", status: str = "status") -> DataFrame:
    """One row per (score definition, score): rows, rows with a return, closed rows, hits, and sums of returns and of their ranks.

    For scores on a known grid, whose number of values doesn't grow with the rows: each task merges its rows into counts before anything moves. Returns are
    ranked once, for all definitions.
    """
    ranked = add_average_rank(rows, ret, "_rank")
    share = c("_rank") / c("_rank_n")
    long = explode_scores(ranked.withColumn("_share", share), scores, (ret, status, "_share"), key)
    done = c(status).isin("target", "stop")
    return long.groupBy(key, "score").agg(
        F.count("*").alias("n"), F.count(ret).alias("n_ret"), F.count_if(done).alias("closed"), F.count_if(c(status) == "target").alias("hits"), F.sum(ret).alias("sum_ret"),
        F.sum("_share").alias("sum_rank"), F.sum(c("_share") * c("_share")).alias("sum_rank2"),
    )


def count_metrics(counts: DataFrame, key: str) -> DataFrame:
    """The measures of ranking_metrics from a table of score_counts. A definition's rows are bounded by the grid of its scores."""
    whole = Window.partitionBy(key)
    before = whole.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    table = counts.withColumns({
        "_below": below("n"), "_total": F.sum("n").over(whole), "_n": F.sum("n_ret").over(whole),
        "_score_rank": below("n_ret") + (c("n_ret") + 1) / 2, "_closed_rank": below("closed") + (c("closed") + 1) / 2,
    })

    def quantile(p: float) -> Column:
        at = F.lit(p) * (c("_total") - 1)
        value = lambda i: F.max(F.when((c("_below") <= i) & (i < c("_below") + c("n")), c("score"))).over(whole)
        low, high = value(F.floor(at)), value(F.ceil(at))
        return low + (high - low) * (at - F.floor(at))

    table = table.withColumns({"q_low": quantile(0.2), "q_high": quantile(0.8), "_x": c("_score_rank") / c("_n")})
    top, bottom = c("score") >= c("q_high") - 1e-9, c("score") <= c("q_low") + 1e-9
    part = lambda where, x: F.sum(F.when(where, c(x)))
    rate = lambda where: part(where, "hits") * 100.0 / F.nullif(part(where, "closed"), F.lit(0))
    mean = lambda where: part(where, "sum_ret") / F.nullif(part(where, "n_ret"), F.lit(0))
    s = table.groupBy(key).agg(
        F.sum("n").alias("n_scored"), F.sum("closed").alias("n_closed_scored"), F.sum("hits").alias("_p"), F.sum(c("hits") * c("_closed_rank")).alias("_r"),
        F.sum("n_ret").alias("_n"), F.sum(c("n_ret") * c("_x")).alias("_sx"), F.sum("sum_rank").alias("_sy"), F.sum(c("_x") * c("sum_rank")).alias("_sxy"),
        F.sum(c("n_ret") * c("_x") * c("_x")).alias("_sxx"), F.sum("sum_rank2").alias("_syy"),
        (rate(top) - rate(bottom)).alias("win_rate_lift_pp"), (mean(top) - mean(bottom)).alias("return_spread_pct"),
    )
    p, q, n = c("_p"), c("n_closed_scored") - c("_p"), c("_n")
    spread = F.sqrt((n * c("_sxx") - c("_sx") * c("_sx")) * (n * c("_syy") - c("_sy") * c("_sy")))
    return s.select(
        key, "n_scored", "n_closed_scored", "win_rate_lift_pp", "return_spread_pct", ((c("_r") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0))).alias("auc"),
        ((n * c("_sxy") - c("_sx") * c("_sy")) / F.nullif(spread, F.lit(0.0))).alias("rank_ic"),
    )


def blend_sweep(rows: DataFrame, grid: dict[str, dict[str, float]]) -> DataFrame:
    """Ranking metrics of every blend of *grid*. Rows are counted per blend and score where they lie; no copy of them is written."""
    scores = {k: rounded(sum((F.coalesce(c(m), F.lit(0.0)) * w for m, w in v.items()), F.lit(0.0)), 6) for k, v in grid.items()}
    members = dict.fromkeys(m for v in grid.values() for m in v)
    counts = score_counts(rows.select("return_pct", "status", *members), scores, "blend_id")
    return count_metrics(durable(counts), "blend_id")


def tail_rates(rows: DataFrame, score: str, label: str, q: float = 0.2, keys: tuple = ()) -> DataFrame:
    """Label rate in the lowest and highest *q* of a score."""
    cuts = quantiles(rows, list(keys), score, {"low_cut": q, "high_cut": 1 - q})
    joined = rows.join(cuts, list(keys)) if keys else rows.withColumns({x: cuts.select(x).scalar() for x in ("low_cut", "high_cut")})
    low, high = c(score) <= c("low_cut") + 1e-9, c(score) >= c("high_cut") - 1e-9
    return joined.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.first("low_cut").alias("low_cut"), F.first("high_cut").alias("high_cut"),
        F.avg(F.when(low, c(label))).alias("low_rate"), F.avg(F.when(high, c(label))).alias("high_rate"), F.avg(label).alias("overall_rate"),
    )


def complete_only(signals: DataFrame, bars: DataFrame, hold_days: int) -> DataFrame:
    """Drop signals too recent for their horizon: newer than the last bar minus *hold_days* business days."""
    last = bars.agg(F.max(business_ordinal(c("date")))).scalar()
    return signals.filter(business_ordinal(c("signal_date")) <= last - hold_days)


BUCKETS = ((30.0, "<30"), (50.0, "30-50"), (70.0, "50-70"), (85.0, "70-85"), (101.0, ">=85"))


def score_bucket(score: Column) -> Column:
    out = F.when(score < 0, F.lit(None).cast("string"))
    for upper, name in BUCKETS:
        out = out.when(score < upper, name)
    return out


def bucket_win_rates(rows: DataFrame, scores: tuple, hit: str = "hit") -> DataFrame:
    long = explode_scores(rows, {s: c(s) for s in scores}, (hit,), "score_name").withColumn("bucket", score_bucket(c("score")))
    return long.filter(c("bucket").isNotNull()).groupBy("score_name", "bucket").agg(
        F.sum(hit).alias("targets"), F.count("*").alias("total"), rounded(F.avg(hit) * 100.0, 1).alias("win_rate")
    )


def top_k_metrics(rows: DataFrame, ks: tuple = (1, 3), key: str = "mode") -> DataFrame:
    """Win rate of the k best rows per group, stop breaches, and the drawdown of exit prices in date order.

    Top rows come from a bounded merge (k rows per partial aggregate), and the running maximum is carried over daily
    extremes, whose number is bounded by the calendar.
    """
    order = F.struct((-c("signal_score")).alias("s"), "signal_date", "ticker", "pattern")
    k = max(ks)
    rank = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(order))
    local = rows.withColumn("_salt", F.pmod(F.xxhash64("ticker", "signal_date", "pattern"), F.lit(64))).withColumn("_r", rank).filter(c("_r") <= k)
    best = local.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(c("_r") <= k)
    top = best.groupBy(key).agg(
        *[F.sum(F.when(c("_r") <= n, c("win"))).alias(f"top{n}_wins") for n in ks], *[F.count_if(c("_r") <= n).alias(f"top{n}_total") for n in ks]
    )
    daily = rows.filter(c("exit_price").isNotNull()).groupBy(key, "signal_date").agg(F.max("exit_price").alias("hi"), F.min("exit_price").alias("lo"))
    peak = F.max("hi").over(Window.partitionBy(key).orderBy("signal_date").rowsBetween(Window.unboundedPreceding, 0))
    drawdown = daily.withColumn("_p", peak).groupBy(key).agg(F.min((c("lo") - c("_p")) / c("_p") * 100.0).alias("dd"))
    size = rows.groupBy(key).agg(F.count("*").alias("total_signals"), (F.avg(as_int(c("exit_price") <= c("stop_price"))) * 100.0).alias("breach"))
    out = size.join(top, key).join(drawdown, key, "left")
    return out.select(
        key, "total_signals", *[c(f"top{n}_{x}") for n in ks for x in ("wins", "total")],
        *[rounded(c(f"top{n}_wins") / c(f"top{n}_total") * 100.0, 2).alias(f"top{n}_win_pct") for n in ks],
        rounded(c("breach"), 2).alias("stop_breach_pct"), rounded(c("dd"), 2).alias("max_drawdown_pct"),
    )


def mode_gates(metrics: DataFrame, baseline: str = "baseline", key: str = "mode") -> DataFrame:
    """Five acceptance gates of every mode against the baseline."""
    base = lambda m: F.max(F.when(c(key) == baseline, c(m))).over(Window.partitionBy(F.lit(1)))
    names = ("top1_win_pct", "top3_win_pct", "stop_breach_pct", "max_drawdown_pct", "total_signals")
    out = metrics.withColumns({f"_b_{m}": base(m) for m in names}).filter(c(key) != baseline)
    d = lambda m: c(m) - c(f"_b_{m}")
    gates = {
        "gate_top1": d("top1_win_pct") >= 1.5,
        "gate_top3": d("top3_win_pct") >= 1.0,
        "gate_stop_breach": d("stop_breach_pct") <= 0.5,
        "gate_drawdown": (c("_b_max_drawdown_pct") < 0) & (d("max_drawdown_pct") / c("_b_max_drawdown_pct") * 100.0 <= 3.0),
        "gate_retention": c("total_signals") / c("_b_total_signals") >= 0.70,
    }
    out = out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in gates.items()})
    passed = F.lit(True)
    for g in gates:
        passed = passed & c(g)
    return out.select(key, *gates, passed.alias("all_passed"))


def combo_summary(trades: DataFrame) -> DataFrame:
    """Per cohort: counts, rates, means and exact medians."""
    hit, stop = as_int(c("trade_status") == "target"), as_int(c("trade_status") == "stop")
    s = trades.groupBy("cohort").agg(
        F.count("*").alias("events"), F.count_distinct("month").alias("months"), F.sum(hit).alias("target_hits"), F.sum(stop).alias("stop_hits"),
        F.avg("trade_return_pct").alias("r"), F.avg("trade_days_held").alias("d"), F.avg("signal_score").alias("sc"),
    )
    names = {"trade_return_pct": 4, "trade_days_held": 2, "signal_score": 2}
    cells = F.array(*[F.struct(F.lit(x).alias("m"), c(x).cast("double").alias("x")) for x in names])
    med = quantiles(trades.select("cohort", F.explode(cells).alias("_c")).select("cohort", "_c.m", "_c.x"), ["cohort", "m"], "x", {"q": 0.5})
    wide = med.groupBy("cohort").agg(*[rounded(F.max(F.when(c("m") == x, c("q"))), n).alias(f"median_{x}") for x, n in names.items()])
    closed = c("target_hits") + c("stop_hits")
    return s.join(wide, "cohort", "left").select(
        "cohort", "events", "months", "target_hits", "stop_hits", (c("events") - closed).alias("holds"),
        rounded(c("target_hits") / F.nullif(closed, F.lit(0)) * 100.0, 2).alias("win_rate_closed_pct"),
        rounded(c("target_hits") / c("events") * 100.0, 2).alias("target_hit_rate_pct"), rounded(c("stop_hits") / c("events") * 100.0, 2).alias("stop_hit_rate_pct"),
        rounded(c("r"), 4).alias("avg_trade_return_pct"), rounded(c("d"), 2).alias("avg_trade_days_held"), rounded(c("sc"), 2).alias("avg_signal_score"),
        *[f"median_{x}" for x in names],
    )


def pair_compare(summary: DataFrame) -> DataFrame:
    """Every family pair cohort against the cohorts of its two families alone (cohorts are a bounded set of names)."""
    pairs = summary.filter(F.size(F.split("cohort", r"\+")) == 2).select(
        c("cohort").alias("pair"), c("events").alias("pair_events"), c("avg_trade_return_pct").alias("pr"), c("win_rate_closed_pct").alias("pw"),
        F.explode(F.split("cohort", r"\+")).alias("family"),
    )
    single = summary.select(c("cohort").alias("_s"), c("avg_trade_return_pct").alias("sr"), c("win_rate_closed_pct").alias("sw"))
    joined = pairs.join(single, F.concat("family", F.lit("_only")) == c("_s"))
    a = joined.groupBy("pair", "pair_events", "pr", "pw").agg(F.avg("sr").alias("ar"), F.max("sr").alias("br"), F.avg("sw").alias("aw"), F.max("sw").alias("bw"))
    return a.select(
        "pair", "pair_events", c("pr").alias("pair_avg_return_pct"), c("pw").alias("pair_win_rate_pct"), rounded(c("ar"), 4).alias("avg_single_return_pct"),
        rounded(c("br"), 4).alias("best_single_return_pct"), rounded(c("aw"), 2).alias("avg_single_win_rate_pct"), rounded(c("bw"), 2).alias("best_single_win_rate_pct"),
        rounded(c("pr") - c("ar"), 4).alias("minus_avg_return_pct"), rounded(c("pr") - c("br"), 4).alias("minus_best_return_pct"),
        rounded(c("pw") - c("aw"), 2).alias("minus_avg_win_rate_pct"), rounded(c("pw") - c("bw"), 2).alias("minus_best_win_rate_pct"),
    )


def score_histogram(rows: DataFrame, score: str, thresholds: tuple = (70, 72, 75, 80, 85, 90)) -> DataFrame:
    top = F.max_by(F.struct("ticker", "pattern"), F.struct(score, "signal_date", "ticker", "pattern"))
    return rows.filter(c(score).isNotNull()).agg(
        F.count("*").alias("n"), *[F.count_if(c(score) >= t).alias(f"ge_{t}") for t in thresholds], rounded(F.avg(score), 2).alias("mean_score"),
        F.max(score).alias("max_score"), F.min(score).alias("min_score"), top.alias("top"),
    ).select("*", c("top.ticker").alias("top_ticker"), c("top.pattern").alias("top_pattern")).drop("top")
