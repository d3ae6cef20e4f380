"""Statements for sources, sinks and upserts."""

from __future__ import annotations

from barlight.plans.oracles import cte, oracle, r

cte("q_factors", """
select cast(o_orderdate as date) as date, round(10 + avg(o_totalprice) / 20000 + 1e-9, 4) as vix_close, round(70 + min(o_totalprice) / 50000 + 1e-9, 4) as fx_close,
  round(50 + max(o_totalprice) / 10000 + 1e-9, 4) as oil_close,
  round(sum(case when o_orderstatus = 'F' then o_totalprice else -o_totalprice end) / 1000 + 1e-7, 2) as net_flow from orders group by 1""")
cte("q_days", "select distinct cast(o_orderdate as date) as date from orders where isodow(o_orderdate) < 6")
cte("q_events", """
select 'S' || l_suppkey as ticker, cast(l_shipdate as date) as event_date,
  case l_returnflag when 'R' then 'earnings' when 'A' then 'dividend' end as event_type,
  max_by(l_discount, l_orderkey * 10 + l_linenumber) as amount from lineitem where l_returnflag in ('R', 'A') group by 1, 2, 3""")
cte("q_snap", """
select e.*, (select max(date) from q_days d where d.date <= e.event_date) as lo, (select min(date) from q_days d where d.date >= e.event_date) as hi
from (select distinct event_date from q_events) e""")
oracle("src_bars", "select date, ticker, open, high, low, close, volume from q_bars where ticker <> 'S0'")
oracle("src_quotes_nested", """
select date, ticker, open, high, low, close, case when month(date) % 2 = 0 then round(close * 0.99 + 1e-9, 4) else close end as adj_close,
  case when ticker = 'S0' then 0 else volume end as volume from q_bars where not (ticker <> 'S0' and day(date) = 13)""")
oracle("src_bhav_normalise", """
select date, ticker || '.NS' as ticker, open, high, low, close, volume, close as adj_close from q_bars
where isodow(date) <> 3 and cast(substr(ticker, 2) as bigint) in (select s_suppkey from supplier where s_acctbal > 0) and not day(date) = 13""")
oracle("src_flows_parse", """
select cast(o_orderdate as date) as date, round(sum(round(o_totalprice, 2)) + 1e-9, 2) as net_flow from orders where o_orderstatus <> 'P' group by 1""")
oracle("src_flows_hist", """
select layout, date, net_flow from (
  select cast(o_orderdate as date) as date, unnest(['net_flow', 'netValue', 'net', 'split']) as layout,
    max_by(round(o_totalprice, 2), o_orderkey) as net_flow from orders group by 1)""")
oracle("src_universe", """
select 'C' || c_nationkey as ticker, min(c_custkey)::bigint as pos from customer where c_mktsegment <> 'FURNITURE' and c_nationkey <> 3 group by 1""")
oracle("src_manual_events", """
select ticker, coalesce(case when lo = hi then lo when hi is null then lo when lo is null then hi when event_date - lo < hi - event_date then lo else hi end, event_date) as event_date,
  event_type, max_by(amount, seq) as amount from (
  select 'S' || l_suppkey as ticker, cast(l_shipdate as date) as event_date, l_discount as amount, l_orderkey * 10 + l_linenumber as seq,
    case l_returnflag when 'R' then 'earnings' else 'dividend' end as event_type from lineitem where l_returnflag in ('R', 'A'))
join q_snap using (event_date) group by 1, 2, 3""")
oracle("sink_table", f"select month, count(*)::bigint as n, {r('sum(close)', 2)} as total from (select strftime(date, '%Y-%m') as month, close from q_bars) group by 1")
oracle("upsert_bars", """
select date, ticker, case when year(date) >= 1999 then round(close * 1.01 + 1e-9, 4) else close end as close, volume, case when year(date) >= 1999 then 2 else 1 end::bigint as load_seq
from q_bars""")
oracle("upsert_buys", """
select cast(o_orderdate as date) as signal_date, 'C' || o_custkey as ticker, o_orderpriority as pattern, max_by(o_totalprice, o_orderkey) as entry_price,
  case when max_by(o_orderstatus, o_orderkey) = 'O' then 'new' end as tag, max(o_orderkey)::bigint as load_seq
from (select * from orders) group by 1, 2, 3""")
oracle("upsert_sells", """
select cast(o_orderdate as date) as buy_signal_date, 'C' || o_custkey as ticker, o_orderpriority as pattern, min_by(o_totalprice, o_orderkey) as sell_price,
  min(o_orderkey)::bigint as load_seq from orders group by 1, 2, 3""")
oracle("merge_factors", """
select coalesce(f.date, n.date) as date, f.vix_close, coalesce(n.v, f.net_flow) as net_flow from q_factors f
full join (select cast(l_shipdate as date) as date, round(sum(l_quantity), 2) as v from lineitem group by 1) n on n.date = f.date""")
oracle("snap_trading_day", """
select event_date, case when lo = hi then lo when hi is null then lo when lo is null then hi when event_date - lo < hi - event_date then lo else hi end as nearest,
  (select max(date) from q_days d where d.date < e.event_date) as before, hi as after from q_snap e""")
oracle("factor_derive", f"""
select date, {r('(vix_close / lag(vix_close) over (order by date) - 1) * 100', 6)} as vix_change_1d_pct,
  {r('(fx_close / lag(fx_close, 5) over (order by date) - 1) * 100', 6)} as fx_ret_5d_pct,
  {r('(oil_close / lag(oil_close, 5) over (order by date) - 1) * 100', 6)} as oil_ret_5d_pct, net_flow from q_factors""")
oracle("sector_map", "select 'S' || s_suppkey as ticker, coalesce(n_name, 'Other') as sector from supplier left join (select * from nation where n_regionkey <> 2) n on s_nationkey = n_nationkey")
