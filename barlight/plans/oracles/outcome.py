"""Statements for forward outcomes and positions."""

from __future__ import annotations

from barlight.plans.oracles import cte, oracle, r

ROW_STOP = "case when stop_price > 0 and stop_price < entry_price then stop_price else entry_price * (1 - {s}::double / 100) end"


def touch(h: int, t: float, s: float, row_stop: bool = True, source: str = "q_sig") -> str:
    stop = ROW_STOP.format(s=s) if row_stop else f"entry_price * (1 - {s}::double / 100)"
    return f"""
select s.ticker, s.signal_date, s.pattern, s.pattern_family, s.entry_price, s.signal_score, s.tgt, s.stp, count(b.bar_no)::bigint as n,
  min(case when b.high >= s.tgt then b.bar_no - s.bar_no end)::bigint as td, min(case when b.low <= s.stp then b.bar_no - s.bar_no end)::bigint as sd,
  min(case when b.close <= s.stp then b.bar_no - s.bar_no end)::bigint as cd, arg_min(b.open, b.bar_no) as o1, min(b.low) as lo,
  arg_max(b.close, b.bar_no) as lc, max(b.date) as ld, min(case when b.high >= s.tgt then b.date end) as tdate, min(case when b.low <= s.stp then b.date end) as sdate
from (select *, entry_price * (1 + {t}::double / 100) as tgt, {stop} as stp from {source}) s
left join q_nb b on b.ticker = s.ticker and b.bar_no between s.bar_no + 1 and s.bar_no + {h} group by all"""


WIN = "case when td is not null and (sd is null or td <= sd) then 'win' when sd is not null then 'loss' else 'hold' end"
STOPPED = "(sd is not null and (td is null or sd <= td))"
cte("q_t30", touch(30, 6, 7))
cte("q_t7", touch(7, 3, 2, False))
cte("q_out", f"select *, {WIN} as outcome from q_t30")
K = "ticker, signal_date, pattern"
oracle("ot_family_outcome", f"select {K}, pattern_family, outcome from q_out")
oracle("ot_penalty_outcome", f"select {K}, pattern_family, outcome from q_out where n > 0")
oracle("ot_forward_30d", f"""select {K}, pattern_family, outcome, (outcome = 'win')::bigint as win_flag, (outcome = 'loss')::bigint as loss_flag,
  (outcome = 'hold')::bigint as hold_flag, n as bars_available, {r('tgt', 6)} as target_price, {r('stp', 6)} as effective_stop_price,
  td as first_target_hit_day, sd as first_stop_hit_day from q_out""")
oracle("ot_stop_labels", f"""select {K}, {STOPPED}::bigint as stop_before_target, ({STOPPED} and sd <= 5)::bigint as stop_within_5d,
  (o1 <= stp)::bigint as gap_through_stop, (lo <= stp)::bigint as mae_exceeds_stop from q_t30 where n > 0""")
oracle("ot_st_label", f"select {K}, (td is not null and sd is null)::bigint as st_hit_target_7d from q_t7 where n >= 7")
cte("q_t30_pct", touch(30, 6, 7, False))
oracle("ot_candle_outcome", f"select {K}, {WIN} as outcome from q_t30_pct")
cte("q_trade", f"""
with s as (select *, case when {STOPPED} then 'stop' when td is not null then 'target' else 'hold' end as st from q_t30)
select {K}, signal_score, st as trade_status, case st when 'stop' then sdate when 'target' then tdate else ld end as trade_exit_date,
  {r("case st when 'stop' then stp when 'target' then tgt else lc end", 4)} as trade_exit_price,
  case st when 'stop' then sd when 'target' then td else n end as trade_days_held,
  {r("(case st when 'stop' then stp when 'target' then tgt else lc end / entry_price - 1) * 100", 4)} as trade_return_pct from s""")
oracle("ot_combo_trade", "select * exclude (signal_score) from q_trade")
cte("q_st_trade", f"""
with s as (select *, case when {STOPPED} then 'stop' when td is not null then 'target' else 'holding' end as st from q_t7 where n >= 7)
select {K}, pattern_family, signal_score, st as status, {r("case st when 'target' then 3 when 'stop' then -2 else (lc / entry_price - 1) * 100 end", 4)} as return_pct,
  (st = 'target')::bigint as st_hit_target_7d from s""")
oracle("ot_model_compare", f"select {K}, status, return_pct, st_hit_target_7d from q_st_trade")
oracle("ot_close_stop", f"select {K}, case when td is not null and (cd is null or td <= cd) then 'target' when cd is not null then 'stop' else 'holding' end as outcome from q_t7")
cte("q_t60", touch(60, 6, 7))
oracle("ot_coverage_target", f"""select {K}, {r('tgt', 4)} as target_price, n as bars_available, td as first_target_hit_day, td is not null as is_breakout,
  td is null and n < 60 as is_pending from q_t60""")
cte("q_sells", f"""
with h as (select s.ticker, s.signal_date, s.pattern, s.entry_price, min(b.bar_no) as hit from q_sig s join q_nb b on b.ticker = s.ticker and b.bar_no > s.bar_no
  and b.close >= s.entry_price * (1 + 6.0::double / 100) group by all)
select h.signal_date as buy_signal_date, b.date as sell_signal_date, h.ticker, h.pattern, {r('h.entry_price', 4)} as entry_price, 6.0::double as target_return_pct,
  {r('h.entry_price * (1 + 6.0::double / 100)', 4)} as target_price, {r('b.close', 4)} as sell_price,
  {r('(b.close - h.entry_price) / h.entry_price * 100', 2)} as realized_return_pct from h join q_nb b on b.ticker = h.ticker and b.bar_no = h.hit""")
oracle("ot_sell_signal", "from q_sells")


def track(source: str, target: float = 6.0, lockout: int = 7) -> str:
    """Brute force: every later bar of the instrument."""
    return f"""
with s as (select *, entry_price * (1 + {target}::double / 100) as tgt from {source}),
h as (select s.ticker, s.signal_date, s.pattern, min(b.bar_no) as hit from s join q_nb b on b.ticker = s.ticker and b.bar_no > s.bar_no
  where b.high >= s.tgt or (not s.held and b.date - s.signal_date > {lockout} and b.close <= s.stop_price) group by all),
l as (select ticker, arg_max(close, date) as last_close, max(date) as last_date from q_nb group by 1)
select s.* exclude (close), s.held as hold_to_target_only, case when h.hit is null then 'holding' when b.high >= s.tgt then 'target' else 'stop' end as status,
  b.date as exit_date, case when h.hit is null then null when b.high >= s.tgt then s.tgt else s.stop_price end as exit_price,
  case when h.hit is not null then b.close when l.last_date > s.signal_date then l.last_close else s.entry_price end as latest_close,
  coalesce(coalesce(b.date, case when l.last_date > s.signal_date then l.last_date end) - s.signal_date, 0)::bigint as days_held
from s left join h using (ticker, signal_date, pattern) left join q_nb b on b.ticker = s.ticker and b.bar_no = h.hit left join l on l.ticker = s.ticker"""


cte("q_held", "select *, signal_score > 90 as held from q_sig")
cte("q_track_held", track("q_held"))
oracle("ot_tracker", f"select {K}, hold_to_target_only, status, exit_date, {r('exit_price', 4)} as exit_price, latest_close, days_held from q_track_held")


def lab_stop(mode: str, buffer: str = "0.5", pct: str = "9.0") -> str:
    fixed = f"entry_price * (1 - {pct}::double / 100)"
    raw = {"fixed_pct": fixed, "atr": f"case when atr14 is null then {fixed} else greatest(entry_price - atr14 * 2.5, {fixed}) end",
           "structure_atr": f"case when atr14 is null then {fixed} else greatest(low5_recent - atr14 * {buffer}, {fixed}) end"}[mode]
    return f"case when ({raw}) > 0 and ({raw}) < entry_price then ({raw}) else {fixed} end"


def with_stop(stop: str, source: str = "q_sig", extra: str = "") -> str:
    return f"""select * exclude (stop_price, stop_pct, stop_raw), {r('stop_raw', 4)} as stop_price,
      {r('(entry_price - stop_raw) / entry_price * 100', 2)} as stop_pct, false as held {extra} from (select *, {stop} as stop_raw from {source})"""


oracle("stop_lab_modes", " union all ".join(f"select {K}, stop_price, stop_pct, '{m}' as mode from ({with_stop(lab_stop(m))})" for m in ("fixed_pct", "atr", "structure_atr")))
LOWEST = "greatest(least(low10_recent, ema20, close_vwap20) * (1 - 0.5::double / 100), entry_price * 0.9)"
CONFLUENCE = f"case when {LOWEST} > 0 and {LOWEST} < entry_price then {LOWEST} else entry_price * (1 - 2.0::double / 100) end"
oracle("stop_confluence", f"select {K}, stop_price, stop_pct from ({with_stop(CONFLUENCE)})")
oracle("stop_hold_flag", f"""select {K}, mode, case mode when 'fixed_pct' then false when 'score_gt_90_hold_to_target' then signal_score > 90 else signal_score > 95 end
  as hold_to_target_only from q_sig, (select unnest(['fixed_pct', 'score_gt_90_hold_to_target', 'score_gt_95_hold_to_target']) as mode)""")


def value(source: str, capital: str = "10000") -> str:
    return f"""
select *, {r('cur - invested', 2)} as pnl, {r('(cur / invested - 1) * 100', 2)} as return_pct, cur as current_value from (
  select *, {r('qty * entry_price', 2)} as invested, {r('qty * coalesce(exit_price, latest_close)', 2)} as cur from (
    select *, floor({capital} / entry_price)::bigint as qty from {source}) where qty > 0)"""


cte("q_lab", with_stop(lab_stop("structure_atr")))
cte("q_lab_track", track("q_lab"))
cte("q_port", value("q_lab_track"))
oracle("pos_value", f"select {K}, status, qty, invested, current_value, pnl, return_pct, days_held, exit_date from q_port")
oracle("pos_filter_days", f"select {K}, status, days_held from q_port where days_held <= 60")


def summary(source: str, keys: str = "") -> str:
    closed = "filter (where status <> 'holding')"
    return f"""select {keys + ',' if keys else ''} count(*)::bigint as n_total, count(*) filter (where status = 'target')::bigint as n_target,
  count(*) filter (where status = 'stop')::bigint as n_stop, count(*) filter (where status = 'holding')::bigint as n_holding,
  {r('coalesce(sum(invested), 0)', 2)} as total_invested, {r('coalesce(sum(current_value), 0)', 2)} as total_current, {r('coalesce(sum(pnl), 0)', 2)} as total_pnl,
  {r('coalesce((sum(current_value) / nullif(sum(invested), 0) - 1) * 100, 0)', 4)} as overall_return,
  {r(f'coalesce(sum(invested) {closed}, 0)', 2)} as closed_invested, {r(f'coalesce(sum(current_value) {closed}, 0)', 2)} as closed_current,
  {r(f'coalesce(sum(pnl) {closed}, 0)', 2)} as closed_pnl,
  {r(f'coalesce((sum(current_value) {closed} / nullif(sum(invested) {closed}, 0) - 1) * 100, 0)', 4)} as closed_return,
  {r("coalesce(count(*) filter (where status = 'target') / nullif(count(*) filter (where status <> 'holding'), 0)::double * 100, 0)", 4)} as win_rate
from {source} {f'group by {keys}' if keys else ''}"""


oracle("pos_summary", summary("q_port"))
oracle("pos_monthly", f"""
with m as (select strftime(signal_date, '%Y-%m') as month, count(*)::bigint as trades, sum(invested) as inv, sum(current_value) as cur, sum(pnl) as ret,
  avg(return_pct) as a from q_port group by 1),
s as (select *, {r(f"100000 + coalesce(sum({r('ret', 2)}) over (order by month rows between unbounded preceding and 1 preceding), 0)", 2)} as st from m)
select month, st as start_capital, trades, {r('inv', 2)} as invested, {r('greatest(inv - st, 0)', 2)} as recycled_capital, {r('greatest(st - inv, 0)', 2)} as idle_cash,
  case when st > 0 then {r('inv / st * 100', 1)} else 0 end::double as utilization_pct, {r('cur', 2)} as current_value, {r('ret', 2)} as return_value,
  case when inv > 0 then {r('ret / inv * 100', 2)} else 0 end::double as return_pct, case when st > 0 then {r('ret / st * 100', 2)} else 0 end::double as pool_return_pct,
  {r('a', 2)} as avg_trade_return_pct, {r('st + ret', 2)} as end_capital from s""")
oracle("pos_yearly", f"""
with y as (select year(exit_date)::bigint as year, sum(pnl) as p from q_port where status <> 'holding' group by 1),
s as (select *, 100000 + coalesce(sum(p) over (order by year rows between unbounded preceding and 1 preceding), 0) as st from y)
select year, {r('st', 2)} as starting_capital, {r('p', 2)} as realized_pnl, {r('st + p', 2)} as ending_capital, case when st > 0 then {r('p / st * 100', 3)} else 0 end::double as realized_return_pct from s""")
oracle("pos_score_buckets", f"""
with b as (select range as i from range(10)),
g as (select least(floor(greatest(least(signal_score, 100), 0) / 10), 9)::bigint as i, * from q_port)
select (b.i * 10)::varchar || '-' || (b.i * 10 + 10)::varchar as score_bucket, count(status)::bigint as signals,
  count(*) filter (where status <> 'holding')::bigint as closed, count(*) filter (where status = 'target')::bigint as target_hit,
  count(*) filter (where status = 'stop')::bigint as stop_hit, count(*) filter (where status = 'holding')::bigint as holding,
  coalesce({r("count(*) filter (where status = 'target') / nullif(count(*) filter (where status <> 'holding'), 0)::double * 100", 1)}, 0)::double as win_rate_pct,
  coalesce({r('avg(return_pct)', 2)}, 0)::double as avg_return_pct from b left join g on g.i = b.i group by b.i""")


def grid() -> str:
    parts = []
    for mode in ("fixed_pct", "structure_atr"):
        for target in (3.0, 6.0):
            tracked = f"select *, '{mode}' as stop_mode, {target}::double as target_pct from ({track(f'({with_stop(lab_stop(mode))})', target)})"
            parts.append(f"({tracked})")
    every = " union all ".join(f"select * from {p}" for p in parts)
    scen = f"select t.*, s.min_score, k.capital from ({every}) t, (select unnest([0.0, 60.0])::double as min_score) s, (select unnest([1000.0, 10000.0])::double as capital) k where t.signal_score >= s.min_score"
    return summary(f"({value(f'({scen})', 'capital')})", "stop_mode, target_pct, min_score, capital")


oracle("pos_grid", grid())
oracle("pos_quality_gate", """
with s as (select case when o_orderpriority <> '5-LOW' then cast(o_orderdate as date) end as d,
  case when o_orderstatus = 'P' then 'X' || o_custkey else 'S' || o_custkey end as t from orders),
j as (select case when d is null then 'invalid_date' when t not in (select ticker from q_bars) then 'no_price_history'
  when not exists (select 1 from q_bars b where b.ticker = s.t and b.date = s.d) then 'missing_price_on_date' else 'valid' end as reason from s)
select reason, count(*)::bigint as n from j group by 1""")
oracle("pos_oos_scope", f"select {K}, {r('signal_score / 100', 4)} as risk from q_sig where signal_score >= 40")
