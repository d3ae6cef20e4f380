"""Short histories: recursive averages as running sums, stored tables from stored bars."""

from __future__ import annotations

import datetime
import math

import pytest

from barlight.functions.recursive import Ewm, add_ewm
from barlight.operators import indicators
from barlight.plans import inputs

SF = "/root/testdata/sf0.001"


def _bars(spark, days):
    start = datetime.date(2000, 1, 1)
    rows = [(t, start + datetime.timedelta(i), 1 + i, 100.0 + k * 40 + 30 * math.sin(i / 7 + k)) for k, t in enumerate("AB") for i in range(days - 500 * k)]
    return spark.createDataFrame(rows, "ticker string, date date, bar_no long, close double")


def test_running_averages_equal_blocks_and_long_histories_keep_blocks(spark):
    bars = _bars(spark, 1500)
    specs = [Ewm("fast", "close", 0.2), Ewm("slow", "close", 2 / 27), Ewm("late", "close", 1 / 14, start=2)]
    blocks = {(r.ticker, r.bar_no): r for r in add_ewm(bars, specs).collect()}
    for r in add_ewm(bars, specs, longest=1500).collect():
        for s in specs:
            want = blocks[r.ticker, r.bar_no][s.name]
            assert (r[s.name] is None) == (want is None) and (want is None or r[s.name] == pytest.approx(want, rel=1e-12))
    longer = specs[0].longest + 1
    over = add_ewm(bars, specs, longest=longer)
    assert "_block" in over._jdf.queryExecution().analyzed().toString()
    assert 1.25 ** specs[0].longest < 1e281 and min(s.longest for s in specs) == specs[0].longest


def test_feature_table_of_short_histories_sorts_once(spark):
    kept = inputs.stored_bars(spark, SF)
    table = indicators.feature_table(kept, longest=indicators.longest_history(kept))
    plan = table._jdf.queryExecution().sparkPlan().toString()
    physical = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan and physical.count("Sort [") == 1


def test_signals_and_states_read_the_stored_bars(spark):
    assert "lineitem" not in inputs.kept_features(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    key = ["ticker", "date"]
    raw = {tuple(r[k] for k in key): r for r in inputs.features(spark, SF).select(*key, "rsi_full", "signal9", "sma50").collect()}
    for r in inputs.kept_features(spark, SF).select(*key, "rsi_full", "signal9", "sma50").collect():
        for x in ("rsi_full", "signal9", "sma50"):
            want = raw[tuple(r[k] for k in key)][x]
            assert (r[x] is None) == (want is None) and (want is None or r[x] == pytest.approx(want, abs=1e-8))
