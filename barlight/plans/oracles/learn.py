"""Statements for training tables and learned weights."""

from __future__ import annotations

from barlight.plans.oracles import cte, oracle, r
from barlight.plans.oracles import score
from barlight.plans.oracles.base import clip
from barlight.plans.oracles.outcome import STOPPED

K = score.K
cte("q_hist", f"""
select t.*, strftime(signal_date, '%Y-%m') as month, {r('tgt', 6)} as target_price, {r('stp', 6)} as effective_stop_price, td as first_target_hit_day, sd as first_stop_hit_day,
  (outcome = 'win')::bigint as win_flag, (outcome = 'loss')::bigint as loss_flag, (outcome = 'hold')::bigint as hold_flag,
  case when bars_available > 0 then {STOPPED}::bigint end as stop_before_target, case when bars_available > 0 then ({STOPPED} and sd <= 5)::bigint end as stop_within_5d,
  case when bars_available > 0 then (o1 <= stp)::bigint end as gap_through_stop, case when bars_available > 0 then (lo <= stp)::bigint end as mae_exceeds_stop,
  {r('signal_score', 4)} as signal_score_pre_penalty, k.* exclude ({K}) from q_train t join (
    pivot (select {K}, 'feature_recent_signal_count_' || n || 'd' as n, cnt from q_counts)
    on n in ('feature_recent_signal_count_5d', 'feature_recent_signal_count_10d', 'feature_recent_signal_count_20d', 'feature_recent_signal_count_40d') using max(cnt)) k using ({K})""")
oracle("tr_history", f"""select {K}, month, pattern_family, target_price, effective_stop_price, bars_available, first_target_hit_day, first_stop_hit_day, outcome, win_flag, loss_flag, hold_flag,
  stop_before_target, stop_within_5d, gap_through_stop, mae_exceeds_stop, signal_score_pre_penalty, {', '.join(score.FEATURES)}, feature_recent_signal_count_5d,
  feature_recent_signal_count_10d, feature_recent_signal_count_20d, feature_recent_signal_count_40d from q_hist""")
oracle("tr_date_window", f"select {K}, signal_score from q_sig where signal_date between date '1998-01-01' and date '1999-12-31'")
WEIGHT = "exp(-ln(2) / 12 * ((select max(signal_date) from q_sig) - signal_date) / 30.4375::double)"
oracle("tr_recency_weight", f"select {K}, {r(WEIGHT, 8)} as sample_weight from q_sig")
_mean = lambda x: f"{r(f'coalesce(sum(w * {x}) / nullif(sum(case when {x} is not null then w end), 0), 0)', 6)}"
oracle("tr_weighted_mean", f"""select pattern_family, {_mean("(outcome = 'win')::int")} as win_flag, {_mean('signal_score')} as signal_score, {_mean('feature_gap_pct')} as feature_gap_pct
  from (select *, {WEIGHT} as w from q_train) group by 1""")
oracle("wt_family", "from q_fam")
oracle("wt_penalty_buckets", "from q_buckets")
oracle("wt_quantile_buckets", score.ranges_sql("q_train") + " select feature, family, lower, upper, include_upper from b")
cte("q_byl", f"select t.* exclude (feature_recent_signal_count), k.n::bigint as lookback, k.cnt as feature_recent_signal_count from q_train t join q_counts k using ({K})")
cte("q_buckets_l", score.bucket_sql("q_byl", "lookback"))
cte("q_pen_l", score.penalised("q_byl", "q_buckets_l", "lookback"))
oracle("wt_lookback_select", f"""
with s as (select b.lookback, {K}, outcome, {r(clip('signal_score + score_penalty_total'), 1)} as sc from q_byl b join q_pen_l p using (lookback, {K})),
t as (select lookback, avg((outcome = 'win')::int) as tw, avg((outcome = 'loss')::int) as tl from (
  select *, row_number() over (partition by lookback, signal_date order by sc desc, ticker, pattern) as k from s) where k = 1 group by 1),
h as (select lookback, count(*)::bigint as signals, count(*) filter (where sc >= 80)::bigint as hc, coalesce(avg((outcome = 'win')::int) filter (where sc >= 80), 0) as hw,
  coalesce(avg((outcome = 'loss')::int) filter (where sc >= 80), 0) as hl from s group by 1),
j as (select *, {r('0.65::double * (tw - tl) + 0.35::double * (hw - hl)', 6)} as sel from t join h using (lookback))
select lookback, signals, sel as selection_score, {r('tw', 4)} as top1_win, {r('tl', 4)} as top1_loss, {r('hw', 4)} as thr_win, {r('hl', 4)} as thr_loss, hc as threshold_count,
  row_number() over (order by sel desc, lookback) = 1 as selected from j""")

# ---- candles
SHAPES = ("engulfing", "engulfing_confirmed", "hammer_basic", "hammer", "marubozu", "belt_hold", "harami", "dragonfly_doji", "inverted_hammer",
          "morning_star", "piercing_line", "piercing_variant", "three_soldiers")
TWO = ("dragonfly_doji", "hammer", "hammer_basic", "inverted_hammer")
_recent = ", ".join(f"{x} or coalesce(lag({x}) over (partition by ticker order by date), false) as {x}" if x in TWO else x for x in SHAPES)
cte("q_flags", f"""
with f as (select ticker, date, {_recent} from q_candle)
select s.ticker, s.signal_date, s.pattern, s.pattern_family, f.* exclude (ticker, date), s.pattern_family = 'A' and f.hammer as confirmed_hammer_a,
  s.pattern_family in ('A', 'C', 'G') and f.engulfing as engulfing_trend_combo, s.pattern_family = 'B' and f.piercing_variant as piercing_variant_b_combo,
  case when td is not null and (sd is null or td <= sd) then 'win' when sd is not null then 'loss' else 'hold' end as outcome
from q_sig s join f on f.ticker = s.ticker and f.date = s.signal_date join q_t30_pct t on t.ticker = s.ticker and t.signal_date = s.signal_date and t.pattern = s.pattern""")
FLAGS = (*SHAPES, "confirmed_hammer_a", "engulfing_trend_combo", "piercing_variant_b_combo")
cte("q_marg", f"""
with l as ({' union all '.join(f"select outcome, unnest([pattern_family, '__global__']) as scope, '{f}' as flag, {f} as on_ from q_flags" for f in FLAGS)}),
a as (select scope, flag, count(*) filter (where on_)::bigint as n, count(*) filter (where not on_) as n_off, avg((outcome = 'win')::int) as base,
  avg((outcome = 'win')::int) filter (where on_) as w1, avg((outcome = 'loss')::int) filter (where on_) as l1,
  avg((outcome = 'win')::int) filter (where not on_) as w0, avg((outcome = 'loss')::int) filter (where not on_) as l0 from l group by 1, 2)
select scope, flag, n as count, case when n >= 3 then {r('w1 * 100', 1)} end as win_rate_with, case when n >= 3 then {r('l1 * 100', 1)} end as loss_rate_with,
  case when n >= 3 then {r('case when n_off > 0 then w0 else base end * 100', 1)} end as win_rate_without, case when n >= 3 then {r('case when n_off > 0 then l0 else 0 end * 100', 1)} end as loss_rate_without,
  case when n >= 3 then {r('(w1 - base) * 100', 1)} end as edge_pp,
  (case when n >= 3 then least(round(greatest(0, (w1 - base) * 50) * 2 + 1e-9, 0) / 2, 10) else 0 end)::double as weight from a""")
oracle("wt_candle_marginal", "from q_marg")
oracle("wt_candle_compare", f"""
select p.pair, {', '.join(f'{s}.{x} as {n}_{x}' for s, n in (('a', 'old'), ('b', 'new')) for x in ('count', 'win_rate_with', 'edge_pp', 'weight'))},
  b.count - a.count as sample_change, {r('b.win_rate_with - a.win_rate_with', 1)} as win_rate_lift_pp, {r('b.edge_pp - a.edge_pp', 1)} as edge_lift_pp
from (values ('hammer', 'hammer_basic', 'hammer'), ('engulfing', 'engulfing', 'engulfing_confirmed')) p(pair, o, n)
join q_marg a on a.flag = p.o and a.scope = '__global__' join q_marg b on b.flag = p.n and b.scope = '__global__'""")
PREP = ("signal_score", "score_trend", "score_setup", "feature_close_vs_prev_high_pct", "feature_gap_pct", "feature_range_vs_atr", "feature_gap_sequence_risk")
oracle("md_feature_prep", f"""
with l as ({' union all '.join(f"select '{f}' as feature, {f}::double as x from q_train" for f in PREP)}), m as (select feature, coalesce(median(x), 0) as med from l group by 1)
select feature, {r('any_value(med)', 6)} as median, {r('avg(coalesce(x, med))', 6)} as mean,
  case when stddev_pop(coalesce(x, med)) <= 1e-8 then 1 else {r('stddev_pop(coalesce(x, med))', 6)} end::double as std from l join m using (feature) group by 1""")
# Isotonic fit in closed form: the largest, over starts, of the smallest mean of any run from there through the point.
oracle("md_isotonic", f"""
with p as (select signal_score / 100 as x, count(*) as w, sum(st_hit_target_7d) as s from q_st_trade group by 1),
i as (select x, row_number() over (order by x) as i, sum(w) over (order by x) as cw, sum(s) over (order by x) as cs, w, s from p),
m as (select a.i as j, b.i as k, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)::double as mean from i a join i b on b.i >= a.i),
n as (select j, k, min(mean) over (partition by j order by k desc) as low from m),
f as (select k as i, max(low) as v from n group by 1)
select {K}, {r('v', 6)} as calibrated from q_st_trade join i on x = signal_score / 100 join f using (i)""")
oracle("md_logistic_optimum", "select count(*)::bigint as train_rows, sum(st_hit_target_7d)::bigint as positives, true as at_optimum from q_st_trade")
oracle("md_stop_risk_presets", """
select preset, families, count(*)::bigint as train_rows, sum(stop_before_target)::bigint as positives, true as at_optimum
from q_hist, (select unnest(['full', 'scores_only', 'scores_plus_row_context', 'scores_plus_regime']) as preset) p, (select unnest([true, false]) as families) f
where bars_available >= 30 group by all""")
