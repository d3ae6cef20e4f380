"""Statements for evaluation, views, gates, the selector and streams."""

from __future__ import annotations

from barlight.plans.oracles import cte, oracle, r
from barlight.plans.oracles import learn, score  # noqa: F401
from barlight.plans.oracles.outcome import CONFLUENCE, lab_stop, track, value, with_stop

K = score.K
cte("q_str", "select t.*, s.score_trend, s.score_setup from q_st_trade t join q_sig s using (ticker, signal_date, pattern)")


def avg_rank(col: str, keys: str = "") -> str:
    part = f"partition by {keys} " if keys else ""
    both = f"{keys}, {col}" if keys else col
    return f"(rank() over ({part}order by {col}) + (count(*) over (partition by {both}) - 1) / 2)"


oracle("ev_spearman", f"""
with k as (select pattern_family, {avg_rank('signal_score', 'pattern_family')} as a, {avg_rank('return_pct', 'pattern_family')} as b from q_st_trade where return_pct is not null)
select pattern_family, case when stddev_pop(a) > 0 and stddev_pop(b) > 0 then {r('corr(a, b)', 6)} end as rank_corr, count(*)::bigint as n from k group by 1""")


def auc(source: str, key: str, sc: str, label: str) -> str:
    return f"""select {key}, (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) as auc, sum(y)::bigint as p, sum(1 - y)::bigint as q
      from (select {key}, {label} as y, {avg_rank(sc, key)} as rk from {source}) group by 1"""


oracle("ev_rank_auc", f"select pattern_family, {r('auc', 6)} as auc, p as positives, q as negatives from ({auc('q_st_trade', 'pattern_family', 'signal_score', 'st_hit_target_7d')})")


def metrics(source: str, key: str) -> str:
    """source: rows with key, score, return_pct, status."""
    return f"""
with b as ({source}), q as (select {key}, quantile_cont(score, 0.2) - 1e-9 as ql, quantile_cont(score, 0.8) + 0 as qh from b group by 1),
j as (select b.*, score <= ql + 2e-9 as bot, score >= qh - 1e-9 as top, status in ('target', 'stop') as closed, (status = 'target')::int * 100 as hit from b join q using ({key})),
s as (select {key}, count(*)::bigint as n_scored, count(*) filter (where closed)::bigint as n_closed_scored, avg(hit) filter (where top and closed) - avg(hit) filter (where bot and closed) as lift,
  avg(return_pct) filter (where top) - avg(return_pct) filter (where bot) as spread from j group by 1),
a as ({auc("(select * from b where status in ('target', 'stop'))", key, 'score', "(status = 'target')::int")}),
i as (select {key}, case when stddev_pop(x) > 0 and stddev_pop(y) > 0 then corr(x, y) end as ic from (select {key}, {avg_rank('score', key)} as x, {avg_rank('return_pct', key)} as y from b) group by 1)
select {key}, n_scored, n_closed_scored, auc, ic as rank_ic, lift as win_rate_lift_pp, spread as return_spread_pct from s left join a using ({key}) left join i using ({key})"""


M = ("auc", "rank_ic", "win_rate_lift_pp", "return_spread_pct")
cte("q_metrics", metrics(" union all ".join(f"select '{k}' as mode, {v} as score, return_pct, status from q_str" for k, v in {"total": "signal_score", "trend": "score_trend", "setup": "score_setup"}.items()), "mode"))
oracle("ev_quintile_lift", f"""select mode, n_scored, n_closed_scored, {', '.join(f'{r(m, 6)} as {m}' for m in M)},
  {', '.join(f"{r(f'{m} - (select {m} from q_metrics where mode = ' + chr(39) + 'total' + chr(39) + ')', 6)} as {m}_delta" for m in M)} from q_metrics""")


def blend_rows() -> str:
    parts = []
    for a, b in (("signal_score", "score_trend"), ("signal_score", "score_setup")):
        parts.append(f"select printf('{a}+{b}@%.2f', i * 0.05) as blend_id, {r(f'{a} * round(1 - i * 0.05::double, 2) + {b} * round(i * 0.05::double, 2)', 6)} as score, return_pct, status from q_str, (select range as i from range(21))")
    parts.append(f"""select printf('signal_score+score_trend+score_setup@%.1f/%.1f', i * 0.1, j * 0.1) as blend_id,
      {r('signal_score * round(i * 0.1::double, 1) + score_trend * round(j * 0.1::double, 1) + score_setup * round(1 - i * 0.1::double - j * 0.1::double, 1)', 6)} as score, return_pct, status
      from q_str, (select a.range as i, b.range as j from range(11) a, range(11) b where a.range + b.range <= 10)""")
    return " union all ".join(parts)


oracle("ev_blend_sweep", f"select blend_id, n_scored, n_closed_scored, {', '.join(f'{r(m, 6)} as {m}' for m in M)} from ({metrics(blend_rows(), 'blend_id')})")
oracle("ev_complete_cutoff", f"""
select {K} from q_sig where signal_date <= (select max(x) from (select x, row_number() over (order by x desc) as k from (
  select unnest(generate_series(m - 100, m - 1, interval 1 day))::date as x from (select max(date) as m from q_bars)) where isodow(x) < 6) where k = 30)
  or (select count(*) from (select unnest(generate_series(signal_date, (select max(date) from q_bars) - 1, interval 1 day))::date as y) where isodow(y) < 6) >= 30""")
_B = "case when sc < 30 then '<30' when sc < 50 then '30-50' when sc < 70 then '50-70' when sc < 85 then '70-85' else '>=85' end"
oracle("ev_bucket_winrate", f"""
select score_name, {_B} as bucket, sum(hit)::bigint as targets, count(*)::bigint as total, {r('avg(hit) * 100', 1)} as win_rate from (
  select 'signal_score' as score_name, signal_score as sc, (status = 'target')::int as hit from q_str where status <> 'holding'
  union all select 'score_setup', score_setup, (status = 'target')::int from q_str where status <> 'holding') group by 1, 2""")
cte("q_mode_rows", f"""
select m.m.mode as mode, {K}, m.m.v as signal_score, s.stop_price, t.trade_exit_price as exit_price, (t.trade_return_pct > 0)::int as win
from q_modes m join q_trade t using ({K}) join q_sig s using ({K}) where m.m.mode <> 'mid_band_event_rerank'""")
cte("q_topk", f"""
with k as (select *, row_number() over (partition by mode order by signal_score desc, signal_date, ticker, pattern) as rk from q_mode_rows),
d as (select mode, min((lo - pk) / pk * 100) as dd from (select mode, lo, max(hi) over (partition by mode order by signal_date) as pk from (
  select mode, signal_date, max(exit_price) as hi, min(exit_price) as lo from q_mode_rows group by 1, 2)) group by 1)
select k.mode, count(*)::bigint as total_signals, sum(win) filter (where rk <= 1)::bigint as top1_wins, count(*) filter (where rk <= 1)::bigint as top1_total,
  sum(win) filter (where rk <= 3)::bigint as top3_wins, count(*) filter (where rk <= 3)::bigint as top3_total, {r('sum(win) filter (where rk <= 1) / count(*) filter (where rk <= 1)::double * 100', 2)} as top1_win_pct,
  {r('sum(win) filter (where rk <= 3) / count(*) filter (where rk <= 3)::double * 100', 2)} as top3_win_pct, {r('avg(coalesce((exit_price <= stop_price)::int, 0)) * 100', 2)} as stop_breach_pct, {r('any_value(dd)', 2)} as max_drawdown_pct
from k join d using (mode) group by 1""")
oracle("ev_top_k_winrate", "from q_topk")
oracle("ev_mode_gates", """
with g as (select m.mode, m.top1_win_pct - b.top1_win_pct >= 1.5 as gate_top1, m.top3_win_pct - b.top3_win_pct >= 1 as gate_top3, m.stop_breach_pct - b.stop_breach_pct <= 0.5 as gate_stop_breach,
  b.max_drawdown_pct < 0 and (m.max_drawdown_pct - b.max_drawdown_pct) / b.max_drawdown_pct * 100 <= 3 as gate_drawdown, m.total_signals / b.total_signals::double >= 0.7 as gate_retention
  from q_topk m, q_topk b where b.mode = 'baseline' and m.mode <> 'baseline')
select *, gate_top1 and gate_top3 and gate_stop_breach and gate_drawdown and gate_retention as all_passed from g""")
cte("q_cohort", f"""
with b as (select * from (select *, row_number() over (partition by signal_date, ticker order by signal_score desc, pattern_family, pattern) as rk from q_sig) where rk = 1),
f as (select signal_date, ticker, string_agg(distinct pattern_family, '+' order by pattern_family) as k, count(distinct pattern_family) as n from q_sig group by 1, 2)
select t.*, strftime(signal_date, '%Y-%m') as month, case when f.n = 1 then f.k || '_only' else f.k end as cohort from b join q_trade t using ({K}) join f using (signal_date, ticker)""")
cte("q_csum", f"""
with s as (select cohort, count(*)::bigint as events, count(distinct month)::bigint as months, count(*) filter (where trade_status = 'target')::bigint as target_hits,
  count(*) filter (where trade_status = 'stop')::bigint as stop_hits, count(*) filter (where trade_status = 'hold')::bigint as holds, avg(trade_return_pct) as ar, avg(trade_days_held) as ad,
  avg(signal_score) as sc, median(trade_return_pct) as mr, median(trade_days_held) as md, median(signal_score) as ms from q_cohort group by 1)
select cohort, events, months, target_hits, stop_hits, holds, case when target_hits + stop_hits > 0 then {r('target_hits / (target_hits + stop_hits)::double * 100', 2)} end as win_rate_closed_pct,
  {r('target_hits / events::double * 100', 2)} as target_hit_rate_pct, {r('stop_hits / events::double * 100', 2)} as stop_hit_rate_pct, {r('ar', 4)} as avg_trade_return_pct,
  {r('ad', 2)} as avg_trade_days_held, {r('sc', 2)} as avg_signal_score, {r('mr', 4)} as median_trade_return_pct, {r('md', 2)} as median_trade_days_held, {r('ms', 2)} as median_signal_score from s""")
oracle("ev_combo_summary", "from q_csum")
oracle("ev_pair_compare", f"""
with p as (select *, unnest(string_split(cohort, '+')) as fam from q_csum where len(string_split(cohort, '+')) = 2),
j as (select p.cohort as pair, p.events as pair_events, p.avg_trade_return_pct as pr, p.win_rate_closed_pct as pw, avg(s.avg_trade_return_pct) as ar, max(s.avg_trade_return_pct) as br,
  avg(s.win_rate_closed_pct) as aw, max(s.win_rate_closed_pct) as bw from p join q_csum s on s.cohort = p.fam || '_only' group by 1, 2, 3, 4)
select pair, pair_events, pr as pair_avg_return_pct, pw as pair_win_rate_pct, {r('ar', 4)} as avg_single_return_pct, {r('br', 4)} as best_single_return_pct, {r('aw', 2)} as avg_single_win_rate_pct,
  {r('bw', 2)} as best_single_win_rate_pct, {r('pr - ar', 4)} as minus_avg_return_pct, {r('pr - br', 4)} as minus_best_return_pct, {r('pw - aw', 2)} as minus_avg_win_rate_pct,
  {r('pw - bw', 2)} as minus_best_win_rate_pct from j""")
oracle("ev_markov_summary", f"""select count(*)::bigint as markov_rows, count(*) filter (where adj <> 0)::bigint as adjusted_rows, count(*) filter (where adj > 0)::bigint as positive_rows,
  count(*) filter (where adj < 0)::bigint as negative_rows, {r('sum(adj)', 2)} as adjustment_sum, {r('avg(adj)', 6)} as avg_adjustment, {r('median(adj)', 4)} as median_adjustment from q_mk""")
oracle("ev_baseline_profile", f"""select count(*)::bigint as total_signals, count(distinct ticker)::bigint as tickers, count(distinct signal_date)::bigint as dates, {r('avg(signal_score)', 2)} as score_mean,
  {r('stddev_samp(signal_score)', 2)} as score_std, min(signal_score) as score_min, max(signal_score) as score_max,
  {', '.join(f"count(*) filter (where pattern_family = '{x}')::bigint as family_{x.lower()}" for x in 'ABCDEFG')}, {r('median(signal_score)', 2)} as score_median
  from q_sig where signal_date >= (select max(signal_date) from q_sig) - 365""")
oracle("ev_score_hist", f"""select count(*)::bigint as n, {', '.join(f'count(*) filter (where signal_score >= {t})::bigint as ge_{t}' for t in (70, 72, 75, 80, 85, 90))},
  {r('avg(signal_score)', 2)} as mean_score, max(signal_score) as max_score, min(signal_score) as min_score,
  (select ticker from q_sig order by signal_score desc, signal_date desc, ticker desc, pattern desc limit 1) as top_ticker,
  (select pattern from q_sig order by signal_score desc, signal_date desc, ticker desc, pattern desc limit 1) as top_pattern from q_sig""")

# ---- views
oracle("vw_coverage", f"""
with b as (select signal_date, ticker, pattern_family, max(signal_score) as saved_score from q_sig where pattern_family <> 'C' group by 1, 2, 3)
select {K}, td as first_target_hit_day, saved_score, saved_score is not null as captured, coalesce(saved_score >= 60, false) as recognised,
  (select count(*) from q_t60 where td is null and n < 60)::bigint as pending_count from q_t60 left join b using (signal_date, ticker, pattern_family) where td is not null""")
oracle("vw_latest_scores", f"""
with l as (select ticker, signal_score as v, signal_date as d from (select *, row_number() over (partition by ticker order by signal_date desc, signal_score desc) as k from q_sig where pattern_family = 'A') where k = 1),
s as (select ticker, score_setup as v, signal_date as d from (select *, row_number() over (partition by ticker order by signal_date desc, score_setup desc) as k from q_sig) where k = 1)
select 'S' || s_suppkey as ticker, {r('coalesce(l.v, 0)', 1)} as lt_score, l.d as lt_signal_date, {r('coalesce(s.v, 0)', 1)} as st_score, s.d as st_signal_date, l.v is not null as has_lt_signal,
  s.v is not null as has_st_signal, (select max(signal_date) from q_sig) as as_of_date from supplier left join l on l.ticker = 'S' || s_suppkey left join s on s.ticker = 'S' || s_suppkey""")
oracle("vw_recency_months", f"select {K} from q_sig where signal_date >= (select max(signal_date) from q_sig) - interval 24 month")
_recent = "(select * from q_sig where signal_date >= (select max(signal_date) from q_sig) - interval 24 month)"
VIEW = f"{K}, {{score}}, stop_price, status, qty, pnl, return_pct, days_held"
cte("q_lt_pick", f"select * from ({with_stop(lab_stop('structure_atr', '2.5'), _recent)}) where signal_score >= 50")
cte("q_lt_track", track("q_lt_pick"))
oracle("vw_default_lt", f"select {VIEW.format(score='signal_score')} from ({value('q_lt_track')}) where days_held <= 60")
_st = f"(select s.*, t.st_score from {_recent} s join q_st t using ({K}) where t.st_score >= 10 or s.signal_date >= (select max(signal_date) from q_sig) - 7)"
cte("q_st_pick", with_stop(CONFLUENCE, _st))
cte("q_st_track", track("q_st_pick", 3.0))
oracle("vw_default_st", f"select {VIEW.format(score='st_score')} from ({value('q_st_track')}) where days_held <= 7")
oracle("vw_daily_alert", f"""
with d as (select max(sell_signal_date) as d from q_sells)
select 'entry' as kind, ticker, pattern, {r('signal_score', 0)} as score, entry_price, stop_price as exit_price, null::double as return_pct from q_sig, d where signal_date = d and signal_score >= 40
union all select 'exit', ticker, pattern, null, entry_price, sell_price, realized_return_pct from q_sells, d where sell_signal_date = d""")
PARTS = ("score_setup", "score_trend", "score_volume", "score_risk", "score_rsi", "ma_slope_bonus")
oracle("vw_case_studies", f"""
with b as (select * from (select *, row_number() over (partition by ticker order by signal_date desc, signal_score desc, pattern desc) as k from q_sig) where k = 1),
p as ({' union all '.join(f"select ticker, '{x}' as name, {x} as v from b" for x in PARTS)}),
o as (select ticker, list(name order by v desc, name) as names from p group by 1)
select b.ticker, signal_date, pattern_family, signal_score, array_to_string(names[1:3], ',') as top, array_to_string(names[5:6], ',') as weak from b join o using (ticker)""")

# ---- gates
oracle("qa_dup_gate", """
with f as (select count(*) as n from q_factors group by date), e as (select count(*) as n from q_events group by ticker, event_date)
select 'factors' as gate, coalesce(sum(n) filter (where n > 1), 0)::bigint as duplicate_count, coalesce(sum(n) filter (where n > 1), 0) = 0 as passed from f
union all select 'events', coalesce(sum(n) filter (where n > 1), 0)::bigint, coalesce(sum(n) filter (where n > 1), 0) = 0 from e""")
oracle("qa_join_coverage", f"""
with j as (select (exists (select 1 from q_factors f where f.date = s.signal_date))::int as m, (exists (select 1 from q_events e where e.ticker = s.ticker and e.event_date = s.signal_date))::int as e from q_sig s)
select {r('avg(m) * 100', 2)} as market_coverage_pct, avg(m) >= 0.7 as market_passed, {r('avg(e) * 100', 2)} as event_coverage_pct, avg(e) >= 0.5 as event_passed from j""")
oracle("qa_leakage", """select count(*)::bigint as attached_events, count(*) filter (where e.event_date > s.signal_date)::bigint as future_event_count, count(*) filter (where e.event_date > s.signal_date) = 0 as passed
  from q_sig s join q_events e on e.ticker = s.ticker and abs(e.event_date - s.signal_date) <= 3""")

# ---- selector
cte("q_fund", f"""
select 'P' || p_partkey as ticker, p_retailprice as price, case when p_size <> 7 then p_size * 100 end::double as market_cap, q * 100 as avg_volume,
  nullif(case when p_size = 9 then 0 else {r('q / n', 4)} end, 0)::double as pe_clean, {r('t * 100', 4)} as roe, {r('d * 100', 4)} as r6, {r('(d + t) * 100', 4)} as r12, p_size::double as vol
from part join (select l_partkey, sum(l_quantity) as q, avg(l_discount) as d, avg(l_tax) as t, count(*) as n from lineitem group by 1) on l_partkey = p_partkey""")
cte("q_fil", "select * from q_fund where price >= 50 and market_cap >= 500 and avg_volume >= 50000")
oracle("sel_filter", "select ticker, price, market_cap, avg_volume from q_fil")
oracle("sel_minmax", f"""select ticker, {r('(roe - min(roe) over ()) / (max(roe) over () - min(roe) over ())', 6)} as score_roe,
  {r('(max(vol) over () - vol) / (max(vol) over () - min(vol) over ())', 6)} as score_vol, 1::double as score_flat from q_fund""")
cte("q_comp", """
with m as (select *, 0.5 * r6 + 0.5 * r12 as mom from q_fil),
s as (select *, (mom - min(mom) over ()) / (max(mom) over () - min(mom) over ()) as s1, (roe - min(roe) over ()) / (max(roe) over () - min(roe) over ()) as s2,
  (max(pe_clean) over () - pe_clean) / (max(pe_clean) over () - min(pe_clean) over ()) as s3, (max(vol) over () - vol) / (max(vol) over () - min(vol) over ()) as s4 from m)
select *, 0.35::double * s1 + 0.25::double * s2 + 0.2::double * s3 + 0.2::double * s4 as comp from s""")
oracle("sel_composite", f"""select ticker, pe_clean, {r('mom', 6)} as momentum, {r('s1', 6)} as score_momentum, {r('s2', 6)} as score_profit, {r('s3', 6)} as score_valuation,
  {r('s4', 6)} as score_vol, {r('comp', 6)} as composite_score from q_comp""")
oracle("sel_allocate", f"""
with t as (select * from q_comp order by comp desc nulls last, ticker limit 10), a as (select *, {r('50000 * comp / sum(comp) over ()', 2)} as al from t)
select ticker, {r('comp', 6)} as composite_score, al as allocation, {r('al * r12 / 100', 2)} as expected_return_amount from a""")

# ---- streams
oracle("str_bars", """
with d as (select 'U' || user_id as ticker, cast(ts as date) as date, ts, event_id, value from events)
select date, ticker, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*)::double as volume
from d group by 1, 2 having date + interval 1 day <= (select max(ts) - interval 1 day from events)""")
oracle("str_incremental", "select signal_date, ticker, pattern, pattern_family, entry_price, stop_pct, stop_price, score_trend, score_setup, score_volume, score_risk, score_rsi, "
       "sma50_slope_pct, ma_slope_bonus, signal_score, consensus_count from q_sig")
oracle("str_open_positions", f"select {K}, status, exit_date, {r('exit_price', 4)} as exit_price from q_lab_track")
