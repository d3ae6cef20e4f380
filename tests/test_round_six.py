"""Ties of a price and its mean, and work that doesn't grow faster than the bars."""

from __future__ import annotations

import random
import re
import time
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import functions as F

from barlight.config import Backtest
from barlight.operators import indicators, stoprisk
from barlight.plans import inputs
from barlight.streaming import positions as kp

SF = "/root/testdata/sf0.001"


def test_a_close_that_equals_its_mean_is_not_above_it(spark):
    """Prices that stay put equal all their means; running sums of 100.1 leave noise on either side."""
    days = [date(2020, 1, 1) + timedelta(days=k) for k in range(260)]
    bars = spark.createDataFrame([(d, t, p, p, p, p, 10.0) for d in days for t, p in (("A", 100.1), ("B", 33.3333))], "date date, ticker string, open double, high double, low double, close double, volume double")
    features = indicators.feature_table(bars)
    assert features.filter(F.col("close") > F.col("sma50")).count() > 0  # the noise is there
    got = stoprisk.breadth(features).agg(F.max("regime_pct_above_sma50"), F.max("regime_pct_above_sma200")).first()
    assert tuple(got) == (0.0, 0.0)


def test_the_smallest_step_above_the_mean_counts(spark):
    row = spark.createDataFrame([(date(2020, 1, 1), "A", 275.8652, 275.8652 - 5e-7, 275.8652 - 2e-6, 1.0)], "date date, ticker string, close double, sma200 double, sma50 double, ret_20 double")
    got = stoprisk.breadth(row).first()
    assert (got.regime_pct_above_sma50, got.regime_pct_above_sma200) == (100.0, 100.0)


def test_positions_close_on_sorted_days_and_cost_no_walk_over_the_bars():
    rng, cfg, start = random.Random(3), Backtest(), date(2020, 1, 1)
    bars = [(start + timedelta(days=k), 100 + rng.uniform(-12, 8), 100 + rng.uniform(-14, 4)) for k in range(600)]
    signals = [(start + timedelta(days=k % 600), f"p{k // 600}", 100.0 + k % 7, None if k % 3 else 88.0 + k % 5, k % 4 == 0) for k in range(3000)]
    rows = pd.DataFrame(
        [(pd.Timestamp(d), "bar", h, x, None, None, None, None) for d, h, x in bars[::-1]] + [(pd.Timestamp(d), "signal", None, None, p, e, s, hold) for d, p, e, s, hold in signals],
        columns=["ts", "kind", "high", "close", "pattern", "entry_price", "stop_price", "hold_to_target_only"],
    )
    began = time.process_time()
    sorted_bars = kp._bars(rows)
    got = [kp._close(p, *sorted_bars, cfg, None) for p in kp._signals(rows, cfg)]
    assert time.process_time() - began < 0.4  # closing them took 0.9 s
    for (day, _, entry, stop, hold), end in zip(signals, got):
        stop, target = entry * (1 - cfg.stop_pct / 100) if stop is None else stop, entry * (1 + cfg.target_pct / 100)
        want = ("holding", None, None)
        for d, high, close in bars:
            if d > day and (high >= target or not hold and (d - day).days > cfg.lockout_days and close <= stop):
                want = ("target", d, target) if high >= target else ("stop", d, stop)
                break
        assert end == want
    assert {x[0] for x in got} == {"holding", "target", "stop"}


def test_the_passes_over_the_bars_share_their_frames(spark):
    """Each frame of a pass is compiled code of its own in every task, and only a hundred classes are kept."""
    kept = inputs.stored_bars(spark, SF)
    name = "spark.sql.debug.maxToStringFields"
    spark.conf.set(name, "1000")
    try:
        plan = indicators.feature_table(kept, longest=indicators.longest_history(kept))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(name)
    passes = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Window [")]
    frames = sum(len(set(re.findall(r"specifiedwindowframe\([^)]*\)", line))) for line in passes)
    assert 0 < frames <= 37
