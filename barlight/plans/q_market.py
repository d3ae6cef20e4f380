"""Queries over evaluation, views, gates, the selector and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.functions.columns import as_int, rounded
from barlight.functions.ranks import quantiles, rank_auc, spearman
from barlight.operators import catalysts, evaluate, outcomes as oc, patterns, quality, selector, views
from barlight.plans import inputs
from barlight.plans.q_learn import st_rows
from barlight.plans.q_score import _regime, adjusted, short_term
from barlight.plans.queries import query
from barlight.session import durable

c = F.col
K = ("ticker", "signal_date", "pattern")


@query
def ev_spearman(spark, sf):
    out = spearman(st_rows(spark, sf), "signal_score", "return_pct", ("pattern_family",))
    return out.select("pattern_family", rounded(c("rank_corr"), 6).alias("rank_corr"), "n")


@query
def ev_rank_auc(spark, sf):
    out = rank_auc(st_rows(spark, sf), "signal_score", "st_hit_target_7d", ("pattern_family",))
    return out.select("pattern_family", rounded(c("auc"), 6).alias("auc"), "positives", "negatives")


def _metric_columns():
    return [rounded(c(m), 6).alias(m) for m in evaluate.METRICS]


@query
def ev_quintile_lift(spark, sf):
    """Three score definitions side by side with deltas to the first."""
    scores = {"total": c("signal_score"), "trend": c("score_trend"), "setup": c("score_setup")}
    rows = durable(evaluate.explode_scores(st_rows(spark, sf), scores))
    out = evaluate.add_deltas(evaluate.ranking_metrics(rows, ["mode"], "score"), "mode", "total")
    return out.select("mode", "n_scored", "n_closed_scored", *_metric_columns(), *[rounded(c(f"{m}_delta"), 6).alias(f"{m}_delta") for m in evaluate.METRICS])


@query
def ev_blend_sweep(spark, sf):
    grid = evaluate.blend_grid([("signal_score", "score_trend"), ("signal_score", "score_setup")], ("signal_score", "score_trend", "score_setup"))
    out = evaluate.blend_sweep(st_rows(spark, sf), grid)
    return out.select("blend_id", "n_scored", "n_closed_scored", *_metric_columns())


@query
def ev_complete_cutoff(spark, sf):
    return evaluate.complete_only(inputs.signals(spark, sf), inputs.stored_bars(spark, sf), 30).select(*K)


@query
def ev_bucket_winrate(spark, sf):
    closed = st_rows(spark, sf).filter(c("status") != "holding").withColumn("hit", as_int(c("status") == "target"))
    return evaluate.bucket_win_rates(closed, ("signal_score", "score_setup"))


def _mode_rows(spark, sf):
    """Trades of every catalyst mode: the mode is a grouping key."""
    s = durable(adjusted(spark, sf))
    trades = oc.combo_trade(oc.touches(s.select(*K, "pattern_family", "entry_price", "stop_price", "bar_no"), inputs.stored_bars(spark, sf)))
    trades = trades.select(*K, c("trade_exit_price").alias("exit_price"), c("trade_return_pct").alias("ret"))
    parts = [catalysts.rank_by_mode(s, m).select(*K, "stop_price", "signal_score", F.lit(m).alias("mode")) for m in ("baseline", "market_only", "market_and_events")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(trades, list(K))
    return durable(rows.withColumn("win", as_int(c("ret") > 0)))


@query
def ev_top_k_winrate(spark, sf):
    return evaluate.top_k_metrics(_mode_rows(spark, sf))


@query
def ev_mode_gates(spark, sf):
    return evaluate.mode_gates(evaluate.top_k_metrics(_mode_rows(spark, sf)))


def _cohorts(spark, sf):
    s = inputs.signals(spark, sf)
    best = patterns.best_per_event(s.select(*K, "pattern_family", "signal_score", "entry_price", "stop_price", "bar_no"))
    trades = oc.combo_trade(oc.touches(best, inputs.stored_bars(spark, sf)))
    keys = patterns.combo_key(s).select("signal_date", "ticker", "cohort")
    return evaluate.combo_summary(durable(trades.join(keys, ["signal_date", "ticker"]).withColumn("month", F.date_format("signal_date", "yyyy-MM"))))


@query
def ev_combo_summary(spark, sf):
    return _cohorts(spark, sf)


@query
def ev_pair_compare(spark, sf):
    return evaluate.pair_compare(_cohorts(spark, sf))


@query
def ev_markov_summary(spark, sf):
    a = F.coalesce("score_markov_adjustment", F.lit(0.0))
    rows = durable(_regime(spark, sf).select(a.alias("a")))
    median = quantiles(rows, [], "a", {"q": 0.5}).select("q").scalar()
    return rows.agg(
        F.count("*").alias("markov_rows"), F.count_if(c("a") != 0).alias("adjusted_rows"), F.count_if(c("a") > 0).alias("positive_rows"),
        F.count_if(c("a") < 0).alias("negative_rows"), rounded(F.sum("a"), 2).alias("adjustment_sum"), rounded(F.avg("a"), 6).alias("avg_adjustment"),
    ).withColumn("median_adjustment", rounded(median, 4))


@query
def ev_baseline_profile(spark, sf):
    s = inputs.signals(spark, sf)
    recent = s.filter(c("signal_date") >= F.date_sub(s.agg(F.max("signal_date")).scalar(), 365))
    median = quantiles(recent, [], "signal_score", {"q": 0.5}).select("q").scalar()
    fams = [F.count_if(c("pattern_family") == x).alias(f"family_{x.lower()}") for x in "ABCDEFG"]
    return recent.agg(
        F.count("*").alias("total_signals"), F.count_distinct("ticker").alias("tickers"), F.count_distinct("signal_date").alias("dates"),
        rounded(F.avg("signal_score"), 2).alias("score_mean"), rounded(F.stddev_samp("signal_score"), 2).alias("score_std"),
        F.min("signal_score").alias("score_min"), F.max("signal_score").alias("score_max"), *fams,
    ).withColumn("score_median", rounded(median, 2))


@query
def ev_score_hist(spark, sf):
    return evaluate.score_histogram(inputs.signals(spark, sf), "signal_score")


# ---- views --------------------------------------------------------------------------------------------------------
@query
def vw_coverage(spark, sf):
    s = inputs.signals(spark, sf)
    out = views.coverage(s, inputs.stored_bars(spark, sf), s.filter(c("pattern_family") != "C"), threshold=60.0)
    return out.select(*K, c("target_day").alias("first_target_hit_day"), "saved_score", "captured", "recognised", "pending_count")


@query
def vw_latest_scores(spark, sf):
    s = inputs.signals(spark, sf)
    universe = inputs.table(spark, sf, "supplier").select(F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("ticker"))
    return views.universe_scores(universe, s.filter(c("pattern_family") == "A"), s, score_st="score_setup")


@query
def vw_recency_months(spark, sf):
    return views.last_months(inputs.signals(spark, sf), 24).select(*K)


@query
def vw_default_lt(spark, sf):
    out = views.default_long_term(inputs.signals(spark, sf), inputs.stored_bars(spark, sf), min_score=50.0)
    return out.select(*K, "signal_score", "stop_price", "status", "qty", "pnl", "return_pct", "days_held")


@query
def vw_default_st(spark, sf):
    s = durable(short_term(spark, sf))
    as_of = s.agg(F.max("signal_date")).scalar()
    out = views.default_short_term(s, inputs.stored_bars(spark, sf), as_of)
    return out.select(*K, "st_score", "stop_price", "status", "qty", "pnl", "return_pct", "days_held")


@query
def vw_daily_alert(spark, sf):
    s = inputs.signals(spark, sf)
    exits = oc.sell_signals(s, inputs.stored_bars(spark, sf))
    return views.daily_alert(s, exits, exits.agg(F.max("sell_signal_date")).scalar(), 40.0)


@query
def vw_case_studies(spark, sf):
    return views.case_studies(inputs.signals(spark, sf))


# ---- gates --------------------------------------------------------------------------------------------------------
@query
def qa_dup_gate(spark, sf):
    factors = quality.duplicate_gate(inputs.factors(spark, sf), ["date"], "factors")
    return factors.unionByName(quality.duplicate_gate(inputs.calendar(spark, sf), ["ticker", "event_date"], "events"))


@query
def qa_join_coverage(spark, sf):
    return quality.join_coverage(inputs.signals(spark, sf), inputs.factors(spark, sf), inputs.calendar(spark, sf))


@query
def qa_leakage(spark, sf):
    return quality.leakage(inputs.signals(spark, sf), inputs.calendar(spark, sf))


# ---- selector -----------------------------------------------------------------------------------------------------
def _fundamentals(spark, sf):
    """Parts as instruments: price, size and volume from the catalogue, returns and quality from their sales."""
    sales = inputs.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.count("*").alias("n")
    )
    p = inputs.table(spark, sf, "part").join(sales, c("p_partkey") == c("l_partkey"))
    return p.select(
        F.concat(F.lit("P"), c("p_partkey").cast("string")).alias("ticker"), c("p_name").alias("name"), c("p_type").alias("sector"),
        c("p_retailprice").cast("string").alias("price"), F.when(c("p_size") == 7, F.lit("n/a")).otherwise((c("p_size") * 100).cast("string")).alias("market_cap"),
        (c("q") * 100).cast("string").alias("avg_volume"), F.when(c("p_size") == 9, 0.0).otherwise(rounded(c("q") / c("n"), 4)).alias("pe"), rounded(c("q") / 50, 4).alias("pb"),
        rounded(c("t") * 100, 4).alias("roe"), rounded(c("d") * 100, 4).alias("return_6m"), rounded((c("d") + c("t")) * 100, 4).alias("return_12m"),
        c("p_size").cast("double").alias("volatility_1y"),
    )


@query
def sel_filter(spark, sf):
    return selector.basic_filter(_fundamentals(spark, sf)).select("ticker", "price", "market_cap", "avg_volume")


@query
def sel_minmax(spark, sf):
    out = selector.min_max(_fundamentals(spark, sf), {"roe": (c("roe"), True), "vol": (c("volatility_1y"), False), "flat": (F.lit(1.0), True)})
    return out.select("ticker", *[rounded(c(f"score_{x}"), 6).alias(f"score_{x}") for x in ("roe", "vol", "flat")])


def _ranked(spark, sf):
    return selector.composite(selector.basic_filter(_fundamentals(spark, sf)))


@query
def sel_composite(spark, sf):
    return _ranked(spark, sf).select("ticker", "pe_clean", *[rounded(c(x), 6).alias(x) for x in ("momentum", "score_momentum", "score_profit", "score_valuation", "score_vol", "composite_score")])


@query
def sel_allocate(spark, sf):
    return selector.allocate(_ranked(spark, sf)).select("ticker", rounded(c("composite_score"), 6).alias("composite_score"), "allocation", "expected_return_amount")


