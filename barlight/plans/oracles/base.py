"""Bars, features and signals: the shared ground of most statements, with the indicator, pattern and candle checks."""

from __future__ import annotations

from barlight.plans.oracles import cte, oracle, r


def win(fn: str, n: int, shift: int = 0, min_periods: int | None = None) -> str:
    """Guarded rolling window, fn with {} for the windowed column."""
    name, col = fn.split(":")
    over = f"over (partition by ticker order by date rows between {n - 1 + shift} preceding and {shift} preceding)"
    if shift == 0:
        over = f"over (partition by ticker order by date rows between {n - 1} preceding and current row)"
    return f"case when count({col}) {over} >= {min_periods or n} then {name}({col}) {over} end"


def lag(col: str, n: int = 1) -> str:
    return f"lag({col}, {n}) over (partition by ticker order by date)"


cte("q_bars", """
with d as (
  select concat('S', cast(l_suppkey as varchar)) as ticker, cast(l_shipdate as date) as dt,
         avg(l_extendedprice / l_quantity) as p, sum(l_quantity) as v, max(l_discount) as hi, max(l_tax) as lo
  from lineitem group by 1, 2),
z as (select *, (p - avg(p) over (partition by ticker)) / nullif(stddev_samp(p) over (partition by ticker), 0) as z from d),
w as (select *, 100 * exp(sum(0.02 * coalesce(z, 0) + 0.0005)
        over (partition by ticker order by dt rows between unbounded preceding and current row)) as close from z),
o as (select *, coalesce(lag(close) over (partition by ticker order by dt), close) * (1 + (lo - 0.04) / 10) as open from w)
select dt as date, ticker, round(open, 4) as open, round(greatest(open, close) * (1 + hi / 10), 4) as high,
       round(least(open, close) * (1 - lo / 10), 4) as low, round(close, 4) as close, v * 100 as volume from o""")

cte("q_nb", "select *, row_number() over (partition by ticker order by date) as bar_no from q_bars")

cte("q_ema", """
select ticker, bar_no, close, close as ema12, close as ema26, close as ema20, cast(0 as double) as signal9,
       cast(null as double) as g, cast(null as double) as l from q_nb where bar_no = 1
union all
select n.ticker, n.bar_no, n.close, n.close * (2.0/13)::double + e.ema12 * (1 - (2.0/13)::double), n.close * (2.0/27)::double + e.ema26 * (1 - (2.0/27)::double),
       n.close * (2.0/21)::double + e.ema20 * (1 - (2.0/21)::double),
       ((n.close * (2.0/13)::double + e.ema12 * (1 - (2.0/13)::double)) - (n.close * (2.0/27)::double + e.ema26 * (1 - (2.0/27)::double))) * 0.2::double + e.signal9 * 0.8::double,
       case when e.g is null then greatest(n.close - e.close, 0) else greatest(n.close - e.close, 0) * (1.0/14)::double + e.g * (1 - (1.0/14)::double) end,
       case when e.l is null then greatest(e.close - n.close, 0) else greatest(e.close - n.close, 0) * (1.0/14)::double + e.l * (1 - (1.0/14)::double) end
from q_ema e join q_nb n on n.ticker = e.ticker and n.bar_no = e.bar_no + 1""")

cte("q_frames", f"""
with a as (
  select *, {lag('close')} as close_prev1, {lag('open')} as open_prev1, {lag('high')} as high_prev1, {lag('low')} as low_prev1,
    {win('avg:close', 20)} as sma20, {win('avg:close', 50)} as sma50, {win('avg:close', 200)} as sma200,
    {win('stddev_samp:close', 20)} as bb_std, {win('avg:volume', 20)} as vol_avg20,
    {win('max:close', 40, 1)} as prev_high_close, {win('max:close', 20, 1)} as prev20_close,
    {win('min:low', 10, 1)} as swing_low10, {win('max:high', 20, 1)} as high20, {win('max:high', 252)} as high252,
    min(low) over (partition by ticker order by date rows 4 preceding) as low5_recent,
    min(low) over (partition by ticker order by date rows 9 preceding) as low10_recent,
    sum(close * volume) over (partition by ticker order by date rows 19 preceding)
      / sum(volume) over (partition by ticker order by date rows 19 preceding) as close_vwap20,
    coalesce(lead(open) over (partition by ticker order by date), close) as next_open,
    case when count(*) over (partition by ticker order by date rows 19 preceding) = 20 then
      sum((high + low + close) / 3.0 * volume) over (partition by ticker order by date rows 19 preceding)
      / nullif(sum(volume) over (partition by ticker order by date rows 19 preceding), 0) end as vwap,
    (close / {lag('close', 1)} - 1) * 100 as ret_1, (close / {lag('close', 3)} - 1) * 100 as ret_3,
    (close / {lag('close', 5)} - 1) * 100 as ret_5, (close / {lag('close', 20)} - 1) * 100 as ret_20,
    (close / {lag('close', 60)} - 1) * 100 as ret_60,
    sum(volume) over (partition by ticker order by date rows unbounded preceding) as cum_volume,
    coalesce(count(*) over pre = 3 and count(*) over nxt = 3 and high > max(high) over pre and high >= max(high) over nxt, false) as pivot_high,
    coalesce(count(*) over pre = 3 and count(*) over nxt = 3 and low < min(low) over pre and low <= min(low) over nxt, false) as pivot_low
  from q_nb
  window pre as (partition by ticker order by date rows between 3 preceding and 1 preceding),
         nxt as (partition by ticker order by date rows between 1 following and 3 following)),
b as (
  select *, sma20 + 2 * bb_std as bb_upper, sma20 - 2 * bb_std as bb_lower,
    ((sma20 + 2 * bb_std) - (sma20 - 2 * bb_std)) / nullif(sma20, 0) as bb_width,
    case when close_prev1 is null then high - low else greatest(high - low, abs(high - close_prev1), abs(low - close_prev1)) end as tr,
    (open / close_prev1 - 1) * 100 as gap_pct, (close / high252 - 1) * 100 as dist_52w_high_pct,
    (sma50 / nullif({lag('sma50', 5)}, 0) - 1) * 100 as sma50_slope_pct from a),
c as (select *, {win('avg:tr', 14)} as atr14, {win('min:bb_width', 120)} as bb_width_min, {lag('gap_pct')} as prev_gap_pct from b),
d as (select *, (high - low) / nullif(atr14, 0) as range_vs_atr, coalesce(bb_width <= bb_width_min * 1.05, false) as squeeze from c)
select *, {lag('range_vs_atr')} as prev_range_vs_atr,
  squeeze or coalesce({lag('squeeze')}, false) or coalesce({lag('squeeze', 2)}, false) as squeeze_recent from d""")

cte("q_feat", f"""
with j as (
  select f.*, e.ema12, e.ema26, e.ema20, e.ema12 - e.ema26 as macd, e.signal9, e.g as avg_gain, e.l as avg_loss,
    case when f.bar_no > 14 then 100 - 100 / (1 + e.g / nullif(e.l, 0)) end as rsi,
    case when e.g is null then null when e.l = 0 then 100 else 100 - 100 / (1 + e.g / e.l) end as rsi_full
  from q_frames f join q_ema e using (ticker, bar_no))
select *, {lag('macd')} as macd_prev, {lag('signal9')} as signal9_prev, {lag('rsi')} as rsi_prev from j""")


# ---- indicators -------------------------------------------------------------------------------------------------
def picks(source: str, exact: str = "", digits: int = 6, **cols: str) -> str:
    out = ", ".join(f"{r(e, digits)} as {n}" for n, e in cols.items())
    return f"select ticker, date{', ' + exact if exact else ''}, {out} from {source}"


def same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


oracle("ind_sma", picks("q_frames", **same("sma20", "sma50", "sma200", "vol_avg20")))
oracle("ind_prev_high_close", picks("q_frames", **same("prev_high_close")))
oracle("ind_swing_low", picks("q_frames", **same("swing_low10")))
oracle("ind_prev_high_high", picks("q_frames", **same("high20")))
oracle("ind_lag", f"select ticker, date, close_prev1, open_prev1, {r(lag('gap_pct'), 6)} as prev_gap_pct, "
       f"{r(lag('macd'), 6)} as macd_prev, {r(lag('rsi'), 6)} as rsi_prev, {r(lag('bb_width', 2), 6)} as bb_width_lag2, "
       f"{lag('close', 5)} as close_prev5 from q_feat")
oracle("ind_true_range_atr", picks("q_frames", **same("tr", "atr14")))
oracle("ind_ema", picks("q_ema join q_nb using (ticker, bar_no)", **same("ema12", "ema26", "ema20")))
oracle("ind_macd", picks("q_feat", **same("macd", "signal9", "macd_prev", "signal9_prev")))
oracle("ind_rsi_wilder", f"""
select ticker, date, {r('rsi', 6)} as rsi_null_on_zero_loss, {r('rsi_full', 6)} as rsi_full,
  case when bar_no >= 15 then {r('case when avg_loss = 0 then 100 else rsi_full end', 2)} end as rsi_latest,
  case when avg_loss > 0 then {r('rsi_full', 6)} else 100 end::double as rsi_epsilon from q_feat""")
oracle("ind_bollinger", picks("q_frames", **same("sma20", "bb_upper", "bb_lower", "bb_width", "bb_width_min")))
oracle("ind_vwap", picks("q_frames", **same("vwap")))
oracle("ind_ma_slope", picks("q_frames", **same("sma50_slope_pct")))
oracle("ind_returns", picks("q_frames", **same("ret_1", "ret_3", "ret_5", "ret_20", "ret_60")))
oracle("ind_dist_52w_high", picks("q_frames", **same("high252", "dist_52w_high_pct")))
oracle("ind_gap_range", picks("q_frames", **same("gap_pct", "range_vs_atr", "prev_gap_pct", "prev_range_vs_atr")))
oracle("ind_pivots", "select ticker, date, bar_no, high, low, pivot_high, pivot_low from q_frames where pivot_high or pivot_low")
oracle("ind_next_open_entry", "select ticker, date, next_open as entry_price from q_frames")
FEATURE_REPORT = (
    "sma20", "sma50", "sma200", "vol_avg20", "prev_high_close", "swing_low10", "high20", "atr14", "macd", "signal9", "rsi",
    "bb_upper", "bb_width", "bb_width_min", "vwap", "sma50_slope_pct", "gap_pct", "range_vs_atr",
)
oracle("ind_feature_table", picks("q_feat", "bar_no, squeeze_recent, pivot_high, pivot_low", **same(*FEATURE_REPORT)))


# ---- detectors --------------------------------------------------------------------------------------------------
def clip(e: str, lo: str = "0", hi: str = "100") -> str:
    return f"(case when ({e}) < {lo} then {lo} when ({e}) > {hi} then {hi} else ({e}) end)::double"


def sweet(e: str) -> str:
    return (
        f"(case when ({e}) is null then 50 when ({e}) < 50 then {clip(f'({e}) / 50 * 100')} "
        f"when ({e}) > 60 then {clip(f'(100 - ({e})) / 40 * 100')} else 100 end)::double"
    )


FIXED = "close * (1 - 7.0::double / 100)"
TREND = "sma50 is not null and sma200 is not null and vol_avg20 is not null and sma50 > sma200"
VR = "(volume / nullif(vol_avg20, 0))"
RSI = f"coalesce(rsi, {r('rsi_full', 2)})"


def family(code: str, name: str, cond: str, stop: str, setup: str, rsi: str = RSI, source: str = "q_feat", rounded_stop: bool = False) -> str:
    sp = "(close - stop) / close * 100"
    return f"""
with h as (select *, {stop} as stop, {setup} as setup, {rsi} as rsi_in from {source} where {TREND} and {cond}),
p as (select *, {clip('50 + (sma50 / sma200 - 1) * 100 * 5')} as pt, {clip('50 + setup * 8')} as ps, {clip(f'40 + {VR} * 20')} as pv,
  {clip('100 - ' + (r(sp, 2) if rounded_stop else f'({sp})') + ' * 6')} as pr, {sweet('rsi_in')} as pi,
  case when sma50_slope_pct > 0 then {r('least(3, sma50_slope_pct * 4)', 2)} else 0 end as bonus from h)
select date as signal_date, ticker, '{name}' as pattern, '{code}' as pattern_family, {r('close', 4)} as entry_price,
  {r(sp, 2)} as stop_pct, {r('stop', 4)} as stop_price, {r('pt', 1)} as score_trend, {r('ps', 1)} as score_setup,
  {r('pv', 1)} as score_volume, {r('pr', 1)} as score_risk, {r('pi', 1)} as score_rsi,
  case when sma50_slope_pct > 0 then {r('sma50_slope_pct', 2)} end as sma50_slope_pct, bonus::double as ma_slope_bonus,
  {r(clip(r('0.20 * pt + 0.20 * ps + 0.13 * pv + 0.14 * pr + 0.03 * pi', 1) + ' + bonus'), 1)} as signal_score, CONTEXT
from p"""


CONTEXT = (
    "bar_no", "open", "high", "low", "close", "close_prev1", "prev_high_close", "sma20", "sma50", "sma200", "gap_pct",
    "prev_gap_pct", "range_vs_atr", "prev_range_vs_atr", "atr14", "ret_1", "ret_3", "ret_5", "ret_20", "ret_60",
    "dist_52w_high_pct", "prev20_close", "rsi_full", "low5_recent", "low10_recent", "ema20", "close_vwap20",
)

# Pullbacks of the 100-bar base, for bars that break out: band join of candidates to pivots.
cte("q_cand", f"select * from q_feat where {TREND} and close > sma50 and close > high20 and swing_low10 is not null")
cte("q_pulls", """
with p as (
  select c.ticker, c.bar_no as sig_no, v.bar_no as no, v.pivot_high, v.pivot_low, v.high, v.low, v.cum_volume, v.volume
  from q_cand c join q_feat v on v.ticker = c.ticker and v.bar_no between c.bar_no - 97 and c.bar_no - 4
  where v.pivot_high or v.pivot_low),
s as (select *, sum(case when pivot_high then 1 else 0 end) over (partition by ticker, sig_no order by no) as seg from p),
h as (select ticker, sig_no, seg, no as hno, high as hprice, cum_volume - volume as before from s where pivot_high),
l as (select s.ticker, s.sig_no, s.seg, h.hno, h.hprice, h.before, s.no as lno, s.low as lprice, s.cum_volume as upto,
        row_number() over (partition by s.ticker, s.sig_no, s.seg order by s.low, s.no) as rk
      from s join h using (ticker, sig_no, seg) where s.pivot_low and s.no > h.hno),
k as (select *, (hprice - lprice) / hprice * 100 as depth, (upto - before) / (lno - hno + 1) as dry,
        row_number() over (partition by ticker, sig_no order by hno desc) as back from l where rk = 1)
select ticker, sig_no as bar_no, max(case when back = 3 then depth end) as d1, max(case when back = 2 then depth end) as d2,
  max(case when back = 1 then depth end) as d3, max(case when back <= 3 then hprice end) as top,
  max(case when back = 1 then lprice end) as last_low, max(case when back = 1 then dry end) as dry,
  max(case when back = 1 then hno end) as last_high_no, max(case when back = 1 then lno end) as last_low_no
from k group by 1, 2 having count(*) >= 3""")
cte("q_vcp", "select c.*, p.d1, p.d2, p.d3, p.top, p.last_low, p.dry from q_cand c join q_pulls p using (ticker, bar_no)")


def detectors(m: float) -> dict[str, str]:
    swing = "swing_low10 is not null"
    return {
        "A": family("A", "A_breakout_40d", f"close > sma50 and close > sma200 and close > prev_high_close and volume >= {m} * vol_avg20",
                    f"greatest(0.01, {FIXED})", "(close / prev_high_close - 1) * 100", r("rsi_full", 2), rounded_stop=True),
        "B": family("B", "B_pullback_rebound", f"""{swing} and close > sma50 and close <= sma20 * (1 + 1.5::double / 100)
                    and close >= close_prev1 * (1 + 0.2::double / 100) and volume >= {max(1.0, m * 0.8)} * vol_avg20""",
                    f"least(close * 0.995, greatest({FIXED}, swing_low10))", "(sma20 / close - 1) * 100"),
        "C": family("C", "C_macd_crossover", f"{swing} and macd_prev <= signal9_prev and macd > signal9 and {VR} >= {m * 0.8}",
                    f"greatest({FIXED}, swing_low10)", "(macd - signal9) / close * 100 * 50"),
        "D": family("D", "D_rsi_bounce", f"{swing} and rsi_prev < 30 and rsi >= 30 and {VR} >= {m * 0.6}",
                    f"greatest({FIXED}, swing_low10)", "(rsi - rsi_prev) * 1.5", "rsi"),
        "E": family("E", "E_boll_squeeze", f"bb_width_min is not null and squeeze_recent and close > bb_upper and {VR} >= {m * 0.8}",
                    f"greatest({FIXED}, sma20)", "bb_width_min / greatest(bb_width, 0.001) * 8"),
        "F": family("F", "F_vwap_reclaim", f"{swing} and close_prev1 <= vwap and close > vwap and {VR} >= {m}",
                    f"greatest({FIXED}, vwap * 0.99, swing_low10)", "(close / vwap - 1) * 100 * 5"),
        "G": family("G", "G_vcp_breakout", f"""d1 > d2 and d2 > d3 and d2 <= d1 * 0.9 and d3 <= d2 * 0.9 and close > top
                    and {VR} >= {min(m, 1.2)} and dry / vol_avg20 <= 1""",
                    f"least(close * 0.995, greatest({FIXED}, last_low, swing_low10))",
                    "greatest(0, (d1 - d3) / greatest(d1, 0.01) * 100)", source="q_vcp"),
    }


def plain(sql: str) -> str:
    return sql.replace(", CONTEXT", "")


def rich(sql: str) -> str:
    return sql.replace("CONTEXT", ", ".join("close as close" if x == "close" else x for x in CONTEXT))


STANDARD, LOOSE = detectors(1.5), detectors(1.0)
for _key, _code in {"pat_b_pullback": "B", "pat_c_macd": "C", "pat_d_rsi": "D", "pat_e_squeeze": "E", "pat_f_vwap": "F", "pat_g_vcp": "G"}.items():
    oracle(_key, plain(LOOSE[_code]))


def family_a_modes() -> str:
    base = plain(LOOSE["A"])
    modes = {"fixed_pct": base}
    atr = base.replace(f"greatest(0.01, {FIXED})", f"greatest(0.01, greatest(close - atr14 * 2.5, {FIXED}))")
    structure = base.replace(f"greatest(0.01, {FIXED})", f"greatest(0.01, greatest(low - atr14 * 0.5, {FIXED}))")
    modes["atr"] = atr.replace("A_breakout", "A_plus_breakout")
    modes["structure_atr"] = structure.replace("A_breakout", "A_plus_breakout")
    return " union all ".join(f"select '{k}' as stop_mode, * from ({v})" for k, v in modes.items())


oracle("pat_a_breakout", family_a_modes())


def long_term(vectorised: bool) -> str:
    rsi = "coalesce(rsi_full, 50)" if vectorised else f"coalesce({r('rsi_full', 2)}, 50)"
    w = lambda a: f"r{a}" if vectorised else f"p{a}"
    return f"""
with h as (select *, next_open as entry, next_open * (1 - 7.0::double / 100) as stop from q_feat
  where {TREND} and close > sma50 and close > sma200 and close > prev_high_close and volume >= 1.0 * vol_avg20),
p as (select *, {clip('50 + (sma50 / sma200 - 1) * 100 * 5')} as pt, {clip('50 + (close / prev_high_close - 1) * 100 * 8')} as ps,
  {clip('40 + volume / vol_avg20 * 20')} as pv, {clip('100 - (entry - stop) / entry * 100 * 6')} as pr, {clip(rsi)} as pi,
  case when sma50_slope_pct > 0 then {r('least(3, sma50_slope_pct * 4)', 2)} else 0 end as bonus from h),
q as (select *, {r('pt', 1)} as rt, {r('ps', 1)} as rs, {r('pv', 1)} as rv, {r('pr', 1)} as rr, {r('pi', 1)} as ri from p)
select {'true' if vectorised else 'false'} as vectorised, date as signal_date, ticker, 'A_breakout_40d' as pattern, 'A' as pattern_family,
  {r('entry', 4)} as entry_price, {r('entry * 0.99', 4)} as entry_band_low, {r('entry * 1.01', 4)} as entry_band_high,
  7.0::double as stop_pct, {r('stop', 4)} as stop_price, {r('close', 4)} as close, {r('sma50', 4)} as sma50, {r('sma200', 4)} as sma200,
  {r('prev_high_close', 4)} as prev_high_close, volume::bigint as volume, {r('vol_avg20', 2)} as vol_avg20, bonus::double as ma_slope_bonus,
  {r('sma50_slope_pct', 2)} as sma50_slope_pct, rt as score_trend, rs as score_setup, rv as score_volume, rr as score_risk, ri as score_rsi,
  0.0::double as score_pattern, 0.0::double as pattern_bonus,
  {r(clip(r(f'0.20 * {w("t")} + 0.20 * {w("s")} + 0.13 * {w("v")} + 0.14 * {w("r")} + 0.03 * {w("i")}', 1) + ' + bonus'), 1)} as signal_score,
  1::bigint as consensus_count from q"""


oracle("pat_a_lt", f"select * from ({long_term(True)}) union all select * from ({long_term(False)})")
cte("q_hits", " union all ".join(f"select * from ({rich(v)})" for v in LOOSE.values()))
cte("q_sig", f"""
with n as (select signal_date, ticker, count(distinct pattern_family)::bigint as consensus_count from q_hits group by 1, 2)
select q_hits.* exclude (signal_score), n.consensus_count,
  case when n.consensus_count > 1 then {clip('signal_score + 5')} else signal_score end as signal_score
from q_hits join n using (signal_date, ticker)""")
SIGNAL = (
    "signal_date, ticker, pattern, pattern_family, entry_price, stop_pct, stop_price, score_trend, score_setup, score_volume, "
    "score_risk, score_rsi, sma50_slope_pct, ma_slope_bonus, signal_score"
)
oracle("pat_multi", f"select {SIGNAL}, consensus_count from q_sig")
oracle("pat_all_dates", f"select {SIGNAL}, consensus_count from q_sig where signal_date >= date '1999-01-01'")
oracle("pat_consensus", "select signal_date, ticker, pattern, consensus_count, signal_score from q_sig where consensus_count > 1")
oracle("pat_combo_key", """
with f as (select signal_date, ticker, string_agg(distinct pattern_family, '+' order by pattern_family) as k,
  count(distinct pattern_family)::bigint as n, bool_or(pattern_family = 'A') as has_a, bool_or(pattern_family = 'C') as has_c
  from q_sig group by 1, 2)
select signal_date, ticker, k as combo_key, n as family_count, has_a, has_a and has_c as has_target_pair,
  case when n = 1 then k || '_only' else k end as cohort from f""")
oracle("pat_event_top", f"""
select {SIGNAL}, consensus_count from (
  select *, row_number() over (partition by signal_date, ticker order by signal_score desc, pattern_family, pattern) as rk from q_sig) where rk = 1""")
oracle("vw_family_counts", "select pattern_family, count(*)::bigint as signals from q_sig group by 1")
oracle("sc_components", f"select {SIGNAL} from q_hits")
oracle("sc_rsi_sweet_spot", f"select ticker, date, {r(sweet('rsi_full'), 1)} as score_rsi from q_feat")
oracle("sc_ma_slope_bonus", f"""select ticker, date, (case when sma50_slope_pct > 0 then {r('least(3, sma50_slope_pct * 4)', 2)} else 0 end)::double
  as ma_slope_bonus from q_frames where sma50_slope_pct is not null""")


# ---- candles ----------------------------------------------------------------------------------------------------
def prior(fn: str, n: int) -> str:
    return win(fn, n, 1, max(5, n // 2))


cte("q_candle", f"""
with a as (
  select *, high - low as rng, abs(close - open) as body, high - greatest(open, close) as upper, least(open, close) - low as lower,
    {lag('open', 2)} as o2, {lag('high', 2)} as h2, {lag('low', 2)} as l2, {lag('close', 2)} as c2,
    {prior('min:low', 20)} as p_low20, {prior('max:close', 15)} as p_close15, {prior('max:close', 20)} as p_close20,
    {prior('max:high', 10)} as p_high10, {prior('min:low', 10)} as p_low10, {prior('max:high', 12)} as p_high12,
    {prior('min:low', 12)} as p_low12, {prior('max:high', 20)} as p_high20, {prior('avg:volume', 20)} as p_vol20,
    min(rsi) over (partition by ticker order by date rows 9 preceding) as rsi_low
  from q_feat),
b as (select *, open_prev1 as o1, high_prev1 as h1, low_prev1 as l1, close_prev1 as c1 from a),
c as (select *,
  coalesce(c1 < o1 and close > open and open <= c1 and close >= o1, false) as engulfing,
  coalesce(rng > 0 and body / rng <= 0.4 and lower / rng >= 0.5 and upper / rng <= 0.2, false) as hammer_basic,
  coalesce(rng > 0 and close > open and body / rng >= 0.8 and upper / rng <= 0.1 and lower / rng <= 0.1, false) as marubozu_basic,
  coalesce(rng > 0 and close > open and (c1 is null or c1 < o1) and body / rng >= 0.75 and lower / rng <= 0.05 and upper / rng <= 0.1, false) as belt_hold,
  coalesce(h1 > l1 and c1 < o1 and (o1 - c1) / (h1 - l1) >= 0.4 and close > open and open >= c1 and close <= o1, false) as harami,
  coalesce(rng > 0 and body / rng <= 0.3 and lower / rng >= 0.6 and upper / rng <= 0.15, false) as dragonfly_doji,
  coalesce(rng > 0 and body / rng <= 0.4 and upper / rng >= 0.45 and lower / rng <= 0.2, false) as inverted_hammer,
  coalesce(h2 > l2 and rng > 0 and c2 < o2 and (o2 - c2) / (h2 - l2) > 0.5 and not (h1 > l1 and abs(c1 - o1) / (h1 - l1) >= 0.3)
    and close > open and body / rng > 0.4 and close > (o2 + c2) / 2, false) as morning_star,
  coalesce(h1 > l1 and rng > 0 and c1 < o1 and (o1 - c1) / (h1 - l1) >= 0.5 and close > open and body / rng >= 0.5
    and open < l1 and close > (o1 + c1) / 2 and close < o1 and close <= h1, false) as piercing_line,
  coalesce(h1 > l1 and rng > 0 and c1 < o1 and (o1 - c1) / (h1 - l1) >= 0.25 and close > open and body / rng >= 0.2
    and open <= o1 and open <= c1 * 1.03 and close > (o1 + c1) / 2 and close < o1, false) as piercing_variant,
  coalesce(h2 > l2 and h1 > l1 and rng > 0 and c2 > o2 and (c2 - o2) / (h2 - l2) >= 0.5 and (h2 - c2) / (h2 - l2) <= 0.2
    and c1 > o1 and (c1 - o1) / (h1 - l1) >= 0.5 and (h1 - c1) / (h1 - l1) <= 0.2 and close > open and body / rng >= 0.5 and upper / rng <= 0.2
    and c1 > c2 and close > c1 and h1 > h2 and high > h1 and close / o2 - 1 >= 0.04, false) as three_soldiers,
  coalesce(sma50 > sma200 and close >= sma50, false) as trend_ctx, coalesce(low <= p_low20 * 1.03, false) as near3,
  coalesce(low <= p_low20 * 1.04, false) as near4, coalesce(p_close15 >= close * 1.02, false) as pulled15,
  coalesce(p_close20 >= close * 1.02, false) as pulled20
  from b)
select *,
  engulfing and coalesce(abs(c1 - o1) > 0 and body >= abs(c1 - o1) * 1.1, false) and coalesce(rng > 0 and upper / rng <= 0.25 and close >= h1, false)
   and (trend_ctx::int + (near3 or (pulled15 and trend_ctx))::int + coalesce((p_high10 - p_low10) / nullif(c1, 0) * 100 <= 8, false)::int
     + coalesce(volume >= p_vol20 * 1.25, false)::int + coalesce(open >= c1 * 0.98, false)::int) >= 4 as engulfing_confirmed,
  hammer_basic and (coalesce(rsi_low <= 40, false)::int + near4::int + coalesce(volume >= p_vol20 * 1.2, false)::int) >= 2 as hammer,
  marubozu_basic and (coalesce((p_high12 - p_low12) / nullif(c1, 0) * 100 <= 7, false)::int
     + (coalesce(close >= p_high20 * 0.995, false) or (near3 and pulled20))::int + coalesce(volume >= p_vol20 * 1.5, false)::int) >= 2 as marubozu
from c""")
for _name in ("engulfing", "engulfing_confirmed", "hammer_basic", "hammer", "belt_hold", "harami", "dragonfly_doji",
              "inverted_hammer", "morning_star", "piercing_line", "piercing_variant", "three_soldiers"):
    oracle(f"cdl_{_name}", f"select ticker, date, open, high, low, close from q_candle where {_name}")
oracle("cdl_marubozu", "select ticker, date, marubozu_basic, marubozu from q_candle where marubozu_basic")
oracle("cdl_combos", """
select s.signal_date, s.ticker, s.pattern, s.pattern_family = 'A' and c.hammer as confirmed_hammer_a,
  s.pattern_family in ('A', 'C', 'G') and c.engulfing as engulfing_trend_combo, s.pattern_family = 'B' and c.piercing_variant as piercing_variant_b_combo
from q_sig s join (select ticker, date, max(hammer::int) over (partition by ticker order by date rows 1 preceding) = 1 as hammer, engulfing, piercing_variant from q_candle) c on c.ticker = s.ticker and c.date = s.signal_date""")
oracle("cdl_scan_shapes", """
with l as (select *, row_number() over (partition by ticker order by date desc) as back from q_candle)
select ticker, date, shape, close > sma50 as above_sma50, close > sma200 as above_sma200 from (
  select ticker, date, close, sma50, sma200, unnest([case when dragonfly_doji then 'dragonfly_doji' end, case when hammer_basic then 'hammer' end,
    case when inverted_hammer then 'inverted_hammer' end, case when marubozu_basic then 'marubozu' end]) as shape
  from l where back <= 60) where shape is not null""")
oracle("cdl_recent", """
select ticker, date, max(hammer_basic::int) over w = 1 as hammer_recent2, max(morning_star::int) over w = 1 as morning_star_recent2
from q_candle window w as (partition by ticker order by date rows 1 preceding)""")
