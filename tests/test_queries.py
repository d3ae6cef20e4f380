"""Registered queries against their DuckDB statements. BARLIGHT_ALL=1 runs every one, else a cross-section."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "src_quotes_nested", "src_flows_parse", "src_manual_events", "upsert_buys", "merge_factors", "sink_table", "ind_feature_table", "ind_rsi_wilder",
    "pat_multi", "pat_a_breakout", "pat_a_lt", "cdl_engulfing_confirmed", "cdl_hammer", "cdl_combos", "ft_recent_count", "sc_bucket_penalty", "mk_train",
    "rg_breadth", "sr_penalty", "st_boosters", "cat_event_adjust", "cat_regimes", "ot_forward_30d", "ot_sell_signal", "ot_tracker", "pos_monthly",
    "tr_history", "wt_penalty_buckets", "wt_lookback_select", "wt_candle_marginal", "md_isotonic", "md_feature_prep", "ev_quintile_lift", "ev_mode_gates",
    "ev_combo_summary", "vw_coverage", "vw_latest_scores", "qa_leakage", "sel_allocate", "str_bars", "str_open_positions",
]
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = sorted(QUERIES) if os.environ.get("BARLIGHT_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        out.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert ok, note


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert "signal_score" in entry.entry(spark).columns
