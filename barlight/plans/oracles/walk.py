"""Statements for walk-forward evaluation: folds, expanding statistics, and all measures of a score table that needs no fit."""

from __future__ import annotations

from barlight.plans.oracles import cte, oracle, r
from barlight.plans.oracles.learn import PREP
from barlight.plans.oracles.market import avg_rank

# Weekdays between a signal and the last bar; a signal needs thirty.
cte("q_eval", """
select h.*, case when bars_available >= 30 then stop_before_target end as y from q_hist h where (
  select count(*) from (select unnest(generate_series(signal_date, (select max(date) from q_bars) - 1, interval 1 day))::date as d) where isodow(d) < 6) >= 30""")
cte("q_folds", """
with m as (select month, count(*) as n, count(y) as labelled, coalesce(sum(y), 0) as p from q_eval group by 1),
b as (select month, sum(n) over w as earlier, sum(labelled) over w as train_rows, sum(p) over w as positives, row_number() over (order by month) as k
  from m window w as (order by month rows between unbounded preceding and 1 preceding))
select month as fold, earlier::bigint as earlier_rows, train_rows::bigint as train_rows, positives::bigint as positives from b where k > 1 and earlier >= 250 and train_rows > 0""")
SPECIFICATIONS = "(values ('full', 'full', true), ('full_no_family', 'full', false), ('scores_only', 'scores_only', true), ('scores_plus_row_context', 'scores_plus_row_context', true), ('scores_plus_regime', 'scores_plus_regime', true)) s(candidate_name, feature_set, include_family_features)"
oracle("ev_walk_forward_folds", f"""
with t as (select month as fold, count(*)::bigint as test_rows, {r('avg(y)', 4)} as realized_stop_rate from q_eval where y is not null group by 1)
select s.*, f.*, t.* exclude (fold) from {SPECIFICATIONS}, q_folds f join t using (fold)""")
oracle("ev_walk_forward_statistics", f"""
with e as (select f.fold, h.* from q_folds f join q_eval h on h.month < f.fold and h.y is not null),
l as ({' union all '.join(f"select fold, '{f}' as feature, {f}::double as x from e" for f in PREP)}), m as (select fold, feature, coalesce(median(x), 0) as med from l group by 1, 2)
select fold, feature, {r('any_value(med)', 6)} as median, {r('avg(coalesce(x, med))', 6)} as mean,
  case when stddev_pop(coalesce(x, med)) <= 1e-8 then 1 else {r('stddev_pop(coalesce(x, med))', 6)} end::double as std from l join m using (fold, feature) group by 1, 2""")
cte("q_raw_scores", " union all ".join(f"select '{x}' as candidate_name, month as fold, train_rows, y, signal_score, {r(f'1 - {x} / 100::double', 4)} as score from q_eval join q_folds on month = fold where y is not null" for x in ("signal_score", "score_risk")))


def tails(column: str, keys: str, prefix: str = "") -> str:
    """Cuts, label rates beyond them and the rank correlation of *column*, per *keys*."""
    return f"""
(with q as (select {keys}, quantile_cont({column}, 0.2) as lo, quantile_cont({column}, 0.8) as hi from q_raw_scores group by all),
k as (select {keys}, {avg_rank(column, keys)} as a, {avg_rank('y', keys)} as b from q_raw_scores)
select {keys}, count(*)::bigint as {prefix}n, any_value(lo) as {prefix}lo, any_value(hi) as {prefix}hi, avg(y) filter (where {column} <= lo + 1e-9) as {prefix}low, avg(y) filter (where {column} >= hi - 1e-9) as {prefix}high,
  avg(y) as {prefix}rate, avg({column}) as {prefix}mean, max(train_rows)::bigint as {prefix}train, count(distinct fold)::bigint as {prefix}folds, any_value(rho) as {prefix}rho
from q_raw_scores join q using ({keys}) join (select {keys}, case when stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end as rho from k group by all) using ({keys}) group by {keys})"""


oracle("ev_score_table_monthly", f"""
select candidate_name, fold, train as train_rows, n as test_rows, {r('rho', 4)} as spearman_stop_risk_vs_stop, {r('mean', 4)} as avg_signal_stop_risk, {r('rate', 4)} as realized_stop_rate,
  {r('lo', 4)} as low20_stop_risk_cutoff, {r('hi', 4)} as high20_stop_risk_cutoff, {r('low', 4)} as low20_stop_rate, {r('high', 4)} as high20_stop_rate from {tails('score', 'candidate_name, fold')}""")
oracle("ev_score_table_summary", f"""
select candidate_name, n as oos_rows, folds as months, {r('rho', 4)} as spearman_stop_risk_vs_stop, {r('lo', 4)} as low20_stop_risk_cutoff, {r('hi', 4)} as high20_stop_risk_cutoff, {r('low', 4)} as low20_stop_rate,
  {r('high', 4)} as high20_stop_rate, {r('high - low', 4)} as stop_rate_gap_high20_minus_low20, {r('high / nullif(low, 0) - 1', 4)} as relative_lift_high_vs_low,
  {r('b_rho', 4)} as baseline_spearman_signal_score_vs_stop, {r('b_hi', 4)} as baseline_top_cut, {r('b_lo', 4)} as baseline_bottom_cut, {r('b_high', 4)} as baseline_top_stop_rate, {r('b_low', 4)} as baseline_bottom_stop_rate
from {tails('score', 'candidate_name')} join {tails('signal_score', 'candidate_name', 'b_')} using (candidate_name)""")

