"""Statements for score components, penalties, regimes, risk and short-term scores."""

from __future__ import annotations

from barlight.plans.oracles import cte, oracle, r
from barlight.plans.oracles.base import clip
from barlight.plans.oracles import outcome, parameters, source  # noqa: F401  (their tables come first)

K = "ticker, signal_date, pattern"
FEATURES = {
    "feature_recent_signal_count": "crowding", "feature_close_vs_prev_high_pct": "extension", "feature_close_vs_sma50_pct": "extension",
    "feature_exhaustion_risk": "extension", "feature_gap_pct": "gap_shock", "feature_range_vs_atr": "gap_shock", "feature_gap_sequence_risk": "gap_shock",
}


def pos(e: str) -> str:
    return f"greatest(coalesce({e}, 0), 0)"


# Business days by brute force: strictly later than d minus n weekdays.
cte("q_bday", """
with d as (select distinct signal_date as d from q_sig)
select d, n from d, (select unnest([5, 10, 20, 40]) as n)""")
cte("q_thr", """
select d, n, max(x) as threshold from (
  select b.d, b.n, s.x, row_number() over (partition by b.d, b.n order by s.x desc) as k from q_bday b,
    lateral (select unnest(generate_series(b.d - 100, b.d - 1, interval 1 day))::date as x) s where isodow(s.x) < 6)
where k = n group by 1, 2""")
cte("q_counts", """
with p as (select ticker, signal_date, pattern, row_number() over (partition by ticker order by signal_date, pattern) - 1 as pos from q_sig)
select p.ticker, p.signal_date, p.pattern, t.n, greatest(p.pos - count(o.pattern), 0)::bigint as cnt
from p join q_thr t on t.d = p.signal_date left join q_sig o on o.ticker = p.ticker and o.signal_date <= t.threshold group by p.ticker, p.signal_date, p.pattern, t.n, p.pos""")
oracle("ft_recent_count", "pivot (select ticker, signal_date, pattern, 'n' || n as n, cnt from q_counts) on n in ('n5', 'n10', 'n20', 'n40') using max(cnt)")
cte("q_pf", f"""
with a as (
  select s.*, k.cnt as feature_recent_signal_count, case when prev_high_close > 0 then (close / prev_high_close - 1) * 100 end as cvh,
    case when sma20 > 0 then (close / sma20 - 1) * 100 end as c20, {r('case when sma50 > 0 then (close / sma50 - 1) * 100 end', 4)} as feature_close_vs_sma50_pct,
    {r('gap_pct', 4)} as feature_gap_pct, {r('range_vs_atr', 4)} as feature_range_vs_atr,
    {pos('gap_pct')} + 0.7::double * {pos('prev_gap_pct')} + {pos('range_vs_atr - 1')} + 0.7::double * {pos('prev_range_vs_atr - 1')} as gaps
  from q_sig s join q_counts k using (ticker, signal_date, pattern) where k.n = 20),
b as (select *, {pos('cvh')} + 0.6::double * {pos('c20')} + 0.3::double * {pos('feature_close_vs_sma50_pct')} + 0.45::double * {pos('ret_3')} + 0.25::double * {pos('ret_5')} as tired from a)
select * exclude (cvh, c20, gaps, tired), {r('cvh', 4)} as feature_close_vs_prev_high_pct, case when gaps > 0 then {r('gaps', 4)} end as feature_gap_sequence_risk,
  case when tired > 0 then {r('tired', 4)} end as feature_exhaustion_risk from b""")
oracle("ft_penalty_features", f"select {K}, {', '.join(FEATURES)} from q_pf")
cte("q_train", f"""
select f.*, o.outcome, o.n as bars_available, o.td, o.sd, o.o1, o.lo, o.stp, o.tgt from q_pf f join q_out o using ({K})""")

# ---- family weights and penalty buckets
cte("q_fam", f"""
with b as (select avg((outcome = 'win')::int) as base, count(*) as total from q_train),
f as (select pattern_family as family, count(*)::bigint as n, avg((outcome = 'win')::int) as wr, avg((outcome = 'loss')::int) as lr from q_train group by 1),
s as (select *, least(1, n / 100.0::double) as conf, (wr - base) * 100 as edge from f, b),
p as (select *, case when n >= 5 then {r(clip('50 + edge * conf * 4'), 1)} else 0 end::double as score_pattern from s)
select family, n as count, {r('n / total::double * 100', 1)} as pct_of_signals, {r('wr * 100', 1)} as win_rate, {r('lr * 100', 1)} as loss_rate, {r('edge', 1)} as edge_pp,
  {r('conf', 2)} as confidence, score_pattern, case when n >= 5 then {r('least(30, score_pattern / 100 * 30)', 1)} else 0 end::double as weight from p""")


def long(source: str, keys: str = "") -> str:
    k = keys + ", " if keys else ""
    every = " union all ".join(f"select {k}outcome, pattern_family, '{f}' as feature, {f}::double as x from {source}" for f in FEATURES)
    return f"select {k}outcome, feature, x, unnest([pattern_family, '__global__']) as family from ({every}) where x is not null"


def ranges_sql(source: str, keys: str = "") -> str:
    """Equal-frequency ranges per (feature, family) from sorted value lists."""
    k = keys + ", " if keys else ""
    return f"""
with l as ({long(source, keys)}),
g as (select {k}feature, family, count(*) as n, least(5, count(distinct x)) as q, median(x) as med, list_sort(list(x)) as xs from l group by all having count(*) >= 25),
e as (select {k}feature, family, {r('med', 6)} as anchor, list_distinct(list_transform(range(0, q + 1), lambda i:
    (round(xs[floor((n - 1) * i / q::double + 1e-9)::int + 1] + (xs[ceil((n - 1) * i / q::double - 1e-9)::int + 1] - xs[floor((n - 1) * i / q::double + 1e-9)::int + 1])
      * greatest((n - 1) * i / q::double - floor((n - 1) * i / q::double + 1e-9), 0) + 1e-9, 6)))) as es from g),
s as (select {k}feature, family, anchor, list_sort(es) as es, len(es) as m from e),
b as (select {k}feature, family, anchor, es[i] as lower, es[case when m = 1 then 1 else i + 1 end] as upper, (i = m - 1 or m = 1) as include_upper
  from (select *, unnest(range(1, greatest(m, 2))) as i from s))"""


def bucket_sql(source: str, keys: str = "") -> str:
    k = keys + ", " if keys else ""
    return f"""{ranges_sql(source, keys)},
c as (select {k}feature, family, anchor, lower, upper, include_upper, count(*)::bigint as n, avg((outcome = 'win')::int) as w, avg((outcome = 'loss')::int) as lo
  from l join b using ({k}feature, family) where x >= lower and (x < upper or (include_upper and x <= upper)) group by all)
select {k}feature, family, lower, upper, include_upper, n as count, {r('w', 4)} as win_rate, {r('lo', 4)} as loss_rate, {r('w - lo', 4)} as edge,
  {r('least(1, n / 100.0::double)', 4)} as confidence, (lower + upper) / 2 >= anchor as is_adverse_tail,
  (0::double - {r('case when (lower + upper) / 2 >= anchor and w < lo then (lo - w) * 50 * least(1, n / 100.0::double) else 0 end', 2)}) as penalty from c"""


cte("q_buckets", bucket_sql("q_train"))


def penalised(source: str, buckets: str, keys: str = "") -> str:
    """Long form: every feature looks up its bucket, falling back to the global specification."""
    k = keys + ", " if keys else ""
    on = f" and v.{keys} = b.{keys}" if keys else ""
    every = " union all ".join(f"select {k}{K}, pattern_family, '{f}' as feature, '{g}' as grp, {f}::double as x from {source}" for f, g in FEATURES.items())
    return f"""
with v as ({every}),
u as (select v.*, case when exists (select 1 from {buckets} b where b.feature = v.feature and b.family = v.pattern_family{on}) then v.pattern_family else '__global__' end as spec from v),
p as (select {', '.join('v.' + x for x in ([keys] if keys else []) + ['ticker', 'signal_date', 'pattern', 'grp'])}, coalesce(sum(b.penalty), 0) as pen from u v
  left join {buckets} b on b.feature = v.feature and b.family = v.spec{on} and v.x >= b.lower and (v.x < b.upper or (b.include_upper and v.x <= b.upper)) group by all),
w as (select {k}{K}, {', '.join(r(f"max(case when grp = '{g}' then pen end)", 2) + f' as score_penalty_{g}' for g in ('crowding', 'extension', 'gap_shock'))} from p group by all)
select *, {r('score_penalty_crowding + score_penalty_extension + score_penalty_gap_shock', 2)} as score_penalty_total from w"""


cte("q_pen", penalised("q_pf", "q_buckets"))
oracle("sc_bucket_penalty", f"""select {K}, score_penalty_crowding, score_penalty_extension, score_penalty_gap_shock, score_penalty_total,
  {r(clip('signal_score + score_penalty_total'), 1)} as signal_score from q_sig join q_pen using ({K})""")
oracle("sc_family_bonus", f"""select {K}, score_pattern, {r('weight', 2)} as pattern_bonus, {r(clip('signal_score + weight'), 1)} as signal_score
  from q_sig join q_fam on family = pattern_family""")
HEALTH = """case when sma50 is null or sma200 is null or ret_20 is null or ret_60 is null or dist_52w_high_pct is null then null
  else (sma50 > sma200)::int + (ret_20 > 0)::int + (ret_60 > 0)::int + (dist_52w_high_pct >= -12)::int end"""
cte("q_health", f"select {K}, {HEALTH} as pts from q_sig")
HB = "(case when pts is null then 0 else (pts - 2) * 1.5 end)::double"
oracle("sc_lt_health", f"""select {K}, {r('signal_score', 4)} as signal_score_pre_lt_health, coalesce(pts, 2)::bigint as lt_health_points, {HB} as lt_health_bonus,
  {r(clip(f'signal_score + {HB}'), 1)} as signal_score from q_sig join q_health using ({K})""")

# ---- regimes
STATE = """case when vs50 <= -4 or (ret_20 <= -8 and vs50 < 0) then 'breakdown_risk' when gap >= -0.5 and (vs20 >= 6 or rsi_full >= 72) then 'extended_breakout'
  when gap >= -0.5 and vs50 >= 0 and rsi_full < 72 then 'fresh_breakout' when vs50 >= 0 and ret_20 >= 2 and vs20 between -2 and 6 then 'constructive_trend' else 'sideways' end"""
cte("q_states", f"""select ticker, date, bar_no, {STATE} as state from (select *, (close / sma20 - 1) * 100 as vs20, (close / sma50 - 1) * 100 as vs50,
  (close / prev20_close - 1) * 100 as gap from q_feat)""")
oracle("mk_state", "select ticker, date, state from q_states")
oracle("mk_alias_rows", "select ticker, date, state from q_states")
cte("q_trans", f"""
with m as (select a.state, b.state as next_state, a.date from q_states a join q_states b on b.ticker = a.ticker and b.bar_no = a.bar_no + 5),
w as (select state, next_state, sum(exp(-ln(2) / 12 * ((select max(date) from m) - date) / 30.4375::double)) as weight from m group by 1, 2),
t as (select *, sum(weight) over (partition by state) as total from w)
select state, next_state, {r('weight', 4)} as weight, {r('weight / total', 6)} as prob from t where total >= 25""")
oracle("mk_train", "from q_trans")
cte("q_prob", """
select state, least(sum(case when next_state in ('constructive_trend', 'fresh_breakout') then prob else 0 end), 1) as pc,
  least(sum(case when next_state in ('extended_breakout', 'breakdown_risk') then prob else 0 end), 1) as pa from q_trans group by 1""")
cte("q_mk", f"""
select s.ticker, s.signal_date, s.pattern, t.state as markov_state, coalesce(pc, 0) as pc, coalesce(pa, 0) as pa,
  {r(clip('greatest(0, coalesce(pc, 0) - 0.55::double) / 0.45::double * 4 - greatest(0, coalesce(pa, 0) - 0.35::double) / 0.65::double * 6', '-6', '4'), 2)} as adj
from q_sig s join q_states t on t.ticker = s.ticker and t.date = s.signal_date left join q_prob p on p.state = t.state""")
oracle("mk_adjust", f"""select {K}, markov_state, {r('pc', 4)} as markov_p_continuation, {r('pa', 4)} as markov_p_adverse, adj as score_markov_adjustment,
  {r('signal_score', 4)} as signal_score_pre_markov, {r(clip('signal_score + adj'), 1)} as signal_score from q_sig join q_mk using ({K})""")
cte("q_breadth", f"""
select date, {r('avg(coalesce((close > sma50)::int, 0)) * 100', 4)} as regime_pct_above_sma50, {r('avg(coalesce((close > sma200)::int, 0)) * 100', 4)} as regime_pct_above_sma200,
  {r('median(ret_20)', 6)} as regime_median_ret_20d_pct, {r('median((close / sma50 - 1) * 100)', 6)} as regime_median_close_vs_sma50_pct from q_frames group by 1""")
oracle("rg_breadth", "from q_breadth")
oracle("sr_features", f"""select {K}, {', '.join(FEATURES)}, regime_pct_above_sma50, regime_pct_above_sma200, regime_median_ret_20d_pct, regime_median_close_vs_sma50_pct
  from q_pf left join q_breadth on date = signal_date""")
BETA = {"signal_score": -0.6, "score_trend": -0.2, "score_volume": 0.1, "score_risk": -0.3, "consensus_count": -0.1}
FAMILY = {"A": -0.2, "B": 0.1, "C": 0.0, "D": 0.3, "E": 0.2, "F": 0.1, "G": -0.1}
_z = " + ".join(f"(({f} - (select avg({f}) from q_sig)) / (select stddev_pop({f}) from q_sig)) * {b}::double" for f, b in BETA.items())
_fam = "case pattern_family " + " ".join(f"when '{k}' then {v}" for k, v in FAMILY.items()) + " end::double"
cte("q_risk", f"""
with z as (select *, {r(f'1 / (1 + exp(-(-0.4::double + {_z} + {_fam})))', 8)} as p from q_sig)
select *, (case when p <= 0.2 then 0.08 when p <= 0.3 then 0.2 when p <= 0.35 then 0.31 when p <= 0.4 then 0.42 when p <= 0.5 then 0.55 else 0.8 end)::double as risk from z""")
oracle("sr_predict", f"select {K}, {r('p', 6)} as raw_probability, {r('risk', 4)} as signal_stop_risk from q_risk")
PEN = f"(24 * pow({clip('(risk - 0.25::double) / 0.35::double', '0', '1')}, 1.6::double))"
oracle("sr_penalty", f"""
with a as (select *, round((1 - risk) * 100 + 1e-9)::bigint as rel, {PEN} as pen from q_risk)
select {K}, {r('risk', 4)} as signal_stop_risk, rel as signal_reliability_score, {r('pen', 4)} as score_penalty_stop_risk, false as score_penalty_stop_risk_gated,
  {r('signal_score', 4)} as signal_score_pre_stop_risk_penalty, {r(f"case when rel < 75 then least({clip('signal_score - pen')}, 97) else {clip('signal_score - pen')} end", 1)} as signal_score from a""")

# ---- short term
INTRA = f"{r('(close - open) / open * 100', 4)} as gap_intraday_pct, {r('(high - low) / close * 100', 4)} as volatility_pct"
oracle("st_intraday", f"select {K}, {INTRA} from q_sig")
oracle("st_markov_fill", f"""select {K}, markov_state, case when pattern_family = 'B' then 0.5 else {r('pc', 4)} end::double as markov_p_continuation,
  {r('pa', 4)} as markov_p_adverse from q_sig join q_mk using ({K})""")
LEVELS = ("constructive_trend", "fresh_breakout", "extended_breakout", "sideways", "breakdown_risk")
oracle("st_onehot_state", f"""select ticker, date, {', '.join(f"(state = '{x}')::bigint as {x}_encoded" for x in LEVELS)},
  {" || '|' || ".join(f"(state = '{x}')::int::varchar" for x in LEVELS)} as markov_state_encoded from q_states""")
_L, _M, _R, _G = "p_logistic", "p_margin", "p_random_forest", "p_gbt"
FOUR = f"0.25::double * {_L} + 0.25::double * {_M} + 0.25::double * {_R} + 0.25::double * {_G}"
oracle("st_blend", f"""select {K}, {r(FOUR, 6)} as p_four,
  {r(f'0.05::double * {_L} + 0.95::double * 0.8 / 1.4 * {_M} + 0.95::double * 0.6 / 1.4 * {_R}', 6)} as p_rescaled, {r(f'0.5::double * {_L} + 0.5::double * {_G}', 6)} as p_missing from q_four""")
cte("q_uplift", f"""
with p as (select s.*, {r(FOUR, 6)} as probability from q_sig s join q_four using ({K})),
k as (select *, rank() over (order by probability) + (count(*) over (partition by probability) - 1) / 2 as rk, count(*) over () as n from p)
select *, {r(clip('probability * 100'), 1)} as st_score_pre_model, 0.75::double * {clip('probability * 100')} + 0.25::double * rk / n * 100 as blended from k""")
oracle("st_rank_uplift", f"select {K}, st_score_pre_model, {r('blended', 4)} as blended_score from q_uplift")
cte("q_st", f"""
with j as (select u.*, m.markov_state, {r('m.pc', 4)} as p, {r('m.pa', 4)} as q, coalesce(f.feature_gap_pct, 0) as gap, coalesce(f.feature_exhaustion_risk, 0) as ex,
    coalesce(f.feature_close_vs_prev_high_pct, 0) as hi, coalesce(f.feature_range_vs_atr, 1) as rg, n.score_penalty_extension as ext,
    coalesce(b.regime_median_ret_20d_pct, 0) as mr, coalesce(b.regime_pct_above_sma50, 50) as wide
  from q_uplift u join q_mk m using ({K}) join q_pf f using ({K}) join q_pen n using ({K}) left join q_breadth b on b.date = u.signal_date),
b as (select *, (case when p >= 0.65 and q <= 0.2 then 8 else 0 end + case when markov_state = 'fresh_breakout' and p >= 0.6 then case when p >= 0.68 then 7 else 5 end else 0 end
    + case when markov_state = 'constructive_trend' and p >= 0.58 then 3 else 0 end - case when markov_state in ('extended_breakout', 'breakdown_risk') then 2 else 0 end)::double as boost_regime,
  (case when consensus_count >= 3 then 6 when consensus_count = 2 then 3 else 0 end)::double as boost_consensus,
  (case when gap between -0.5 and 1.5 then 3 else 0 end + case when ex < 8 then 2 else 0 end + case when hi >= -1 then 1 else 0 end - case when gap >= 3 then 2 else 0 end)::double as boost_entry,
  (case when mr > 1.5 and rg < 1.2 then 4 else 0 end + case when wide > 75 then 2 else 0 end - case when mr < -1.5 then 2 else 0 end)::double as boost_volatility,
  (case when p >= 0.58 and q <= 0.22 then 2 else 0 end + case when gap between -0.8 and 1.8 then 1.5 else 0 end + case when ex <= 8.5 then 2 else 0 end + case when hi >= -1.2 then 1 else 0 end
    - case when gap >= 3.5 then 2 else 0 end - case when ex >= 16 then 2.5 else 0 end - case when ext <= -0.35 then 1.5 else 0 end)::double as boost_precision from j)
select *, {r(clip('blended + ' + clip('boost_regime + boost_consensus + boost_entry + boost_volatility + boost_precision', '-6', '18')), 1)} as st_score from b""")
oracle("st_boosters", f"select {K}, boost_regime, boost_consensus, boost_entry, boost_volatility, boost_precision, st_score from q_st")
MOVE = "coalesce(round((lead(close, {n}) over (partition by ticker order by date) - close) / close * 100 + 1e-9, 4) + 0::double, 0)"
cte("q_move", f"select ticker, date, {', '.join(MOVE.format(n=n) + f' as momentum_{n}d_pct' for n in (1, 3, 5))} from q_nb")
oracle("md_st_features", f"""select s.ticker, s.signal_date, s.pattern, t.state as markov_state, {INTRA}, momentum_1d_pct, momentum_3d_pct, momentum_5d_pct
  from q_sig s join q_states t on t.ticker = s.ticker and t.date = s.signal_date join q_move m on m.ticker = s.ticker and m.date = s.signal_date""")
oracle("rescore_history", f"""
with a as (select s.*, f.weight, {HB} as hb, n.score_penalty_total as pen, m.adj from q_sig s join q_fam f on f.family = s.pattern_family
  join q_health using ({K}) join q_pen n using ({K}) join q_mk m using ({K})),
b as (select *, {r(clip('signal_score + weight'), 1)} as s1 from a), c as (select *, {r(clip('s1 + hb'), 1)} as s2 from b), d as (select *, {r(clip('s2 + pen'), 1)} as s3 from c)
select {K}, {r('weight', 2)} as pattern_bonus, hb as lt_health_bonus, pen as score_penalty_total, adj as score_markov_adjustment, {r(clip('s3 + adj'), 1)} as signal_score from d""")

# ---- catalysts
oracle("cat_factor_join", f"select {K}, vix_close, fx_close, oil_close, net_flow from q_sig left join q_factors on date = signal_date")
cte("q_ev", f"""
with j as (select s.ticker, s.signal_date, s.pattern, s.open, s.close, s.signal_date - e.event_date as dd, e.event_type from q_sig s left join q_events e on e.ticker = s.ticker and abs(s.signal_date - e.event_date) <= 3)
select {K}, coalesce(bool_or(event_type = 'earnings'), false) as within_earnings_window, coalesce(bool_or(event_type = 'dividend'), false) as within_dividend_window,
  coalesce(bool_or(dd = 1 and {r('(close - open) / open * 100', 4)} > 2), false) as post_event_gap_risk, {r('coalesce(max(1 - abs(dd) / 3.0::double), 0)', 2)} as event_proximity_score
from j group by 1, 2, 3""")
oracle("cat_event_window", "from q_ev")
cte("q_reg", """
with n as (select *, row_number() over (order by date) as i, (oil_close / lag(oil_close, 1) over (order by date) - 1) * 100 as oil from q_factors)
select a.date, a.vix_close > quantile_cont(b.vix_close, 0.9) as vix_regime_high, a.net_flow < quantile_cont(b.net_flow, 0.25) as flow_regime_weak,
  coalesce(a.oil < -5, false) as energy_regime_shock from n a join n b on b.i between a.i - 59 and a.i group by a.date, a.vix_close, a.net_flow, a.oil""")
oracle("cat_regimes", "from q_reg")
cte("q_cat", f"""select s.*, e.* exclude ({K}), coalesce(vix_regime_high, false) as vh, coalesce(flow_regime_weak, false) as fw, coalesce(energy_regime_shock, false) as es
  from q_sig s join q_ev e using ({K}) left join q_reg g on g.date = s.signal_date""")
cte("q_adj", f"""
with a as (select *, case when within_earnings_window and (score_trend >= 50 or score_setup >= 50) and score_volume >= 50 and not vh then 4 else 0 end
  + case when within_dividend_window and signal_score >= 60 and not vh then 2 else 0 end as bonus, case when post_event_gap_risk then 2 else 0 end as pen from q_cat)
select *, {clip('bonus - pen', '-6', '6')} as total, {r(clip('signal_score + ' + clip('bonus - pen', '-6', '6')), 1)} as scored from a""")
# The second pass starts from the first result minus the stored adjustment.
oracle("cat_event_adjust", f"""
with b as (select *, {clip('scored - total')} as base2 from q_adj),
c as (select *, case when within_earnings_window and (score_trend >= 50 or score_setup >= 50) and score_volume >= 50 and not vh then 4 else 0 end
  + case when within_dividend_window and base2 >= 60 and not vh then 2 else 0 end as bonus2 from b)
select {K}, {r('base2', 2)} as signal_score_pre_catalyst_event, bonus2::double as score_bonus_catalyst_event, pen::double as score_penalty_catalyst_event,
  {clip('bonus2 - pen', '-6', '6')} as score_adjustment_catalyst_event, {r(clip('base2 + ' + clip('bonus2 - pen', '-6', '6')), 1)} as signal_score from c""")
SOFT = "(case when vh then -0.5 else 0 end + case when fw then -0.25 else 0 end + case when es then -0.25 else 0 end)::double"
cte("q_modes", f"""
with m as (select *, {r('signal_score', 2)} as pre from q_adj), n as (select *, {r(clip('pre + case when pre >= 70 and pre < 85 then bonus else 0 end - pen'), 1)} as mid, {SOFT} as soft from m)
select {K}, unnest([{{'mode': 'baseline', 'v': scored}}, {{'mode': 'market_only', 'v': {r(clip('scored + soft'), 1)}}}, {{'mode': 'mid_band_event_rerank', 'v': mid}},
  {{'mode': 'market_and_events', 'v': {r(clip('mid + soft'), 1)}}}]) as m from n""")
oracle("cat_mode_rerank", f"select {K}, m.mode as mode, m.v as signal_score from q_modes")
DOT = clip("case when vh then -1.5 else 0 end + case when fw then -0.75 else 0 end + case when es then -3 else 0 end + case when within_earnings_window then 2 else 0 end "
           "+ case when within_dividend_window then 1 else 0 end + case when post_event_gap_risk then -4 else 0 end + 0.5 * event_proximity_score", "-8", "8")
oracle("cat_penalty_apply", f"select {K}, {r(DOT, 4)} as catalyst_penalty, {r(clip(f'signal_score + {DOT}'), 1)} as signal_score from q_cat")
oracle("rescore_full", f"select {K}, true as replay_equal, true as in_range from q_sig")
