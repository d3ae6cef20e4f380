"""Candle fixtures, forward scans, scoring properties, learned weights and models against brute force."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlight.config import COVERAGE_SCAN, Backtest, Outcome
from barlight.operators import models, outcomes as oc, patterns, penalties, positions, rescore, scoring, stoprisk, stscore, training
from barlight.operators.candles import candle_flags
from barlight.operators.indicators import feature_table, number_bars
from barlight.plans import inputs, q_score
from tests.test_functions import random_bars

SF = "/root/testdata/sf0.001"


def frame(spark, bars, ticker="T"):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), ticker, *map(float, b)) for i, b in enumerate(bars)]
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double")


def last_flags(spark, bars):
    flags = candle_flags(feature_table(frame(spark, bars)))
    return flags.orderBy(F.desc("date")).first().asDict()


def test_piercing_cases(spark):
    strict = last_flags(spark, [(120, 121, 108, 110, 100), (107, 117, 106.5, 116, 100)])
    assert strict["piercing_line"] and strict["piercing_variant"]
    practical = last_flags(spark, [(120, 121, 108, 110, 100), (109.5, 117, 109, 116, 100)])
    assert not practical["piercing_line"] and practical["piercing_variant"]


def test_engulfing_needs_context_only_when_confirmed(spark):
    weak = [(b := 120 - 0.08 * i, b + 4, b - 4, b - 0.1, 100) for i in range(210)]
    weak += [(110 + s, 113 + s, 104 + s, 109 - s, 100) for s in (1, -1) * 4]
    weak += [(108, 108.8, 103, 105, 100), (101, 109.5, 100, 108.5, 100)]
    flags = last_flags(spark, weak)
    assert flags["engulfing"] and not flags["engulfing_confirmed"]
    strong = [(b := 90 + 0.1 * i, b + 0.5, b - 0.5, b + 0.2, 100) for i in range(210)]
    strong += [(110 - 0.5 * i, 110.3 - 0.5 * i, 109 - 0.5 * i, 109.6 - 0.5 * i, 100) for i in range(6)]
    strong += [(107.4, 107.8, 106.6, 107.2, 100)] * 2 + [(107, 107.2, 105.4, 106, 100), (105.2, 108.6, 105, 108, 220)]
    flags = last_flags(spark, strong)
    assert flags["engulfing"] and flags["engulfing_confirmed"]


@pytest.fixture(scope="module")
def scan_case(spark):
    bars = random_bars(2, 500, seed=9)
    rng = np.random.default_rng(4)
    picks = bars.groupby("ticker").sample(120, random_state=5)
    signals = pd.DataFrame(
        {
            "ticker": picks.ticker, "signal_date": picks.date, "pattern": "X", "pattern_family": "A", "entry_price": picks.close,
            "stop_price": (picks.close * rng.uniform(0.9, 1.02, len(picks))).round(4), "signal_score": rng.uniform(0, 100, len(picks)).round(1),
        }
    )
    return bars, signals


def brute(bars, s, horizon):
    future = bars[(bars.ticker == s.ticker) & (bars.date > s.signal_date)].sort_values("date")
    return future if horizon is None else future.head(horizon)


def test_first_touch_equals_loop(spark, scan_case):
    bars, signals = scan_case
    b, s = spark.createDataFrame(bars), spark.createDataFrame(signals)
    cfg = Outcome(3.0, 4.0, 30)
    got = oc.combo_trade(oc.forward_outcome(oc.touches(oc.locate(s, b), b, cfg))).toPandas().set_index(["ticker", "signal_date"])
    assert len(got) == len(signals)
    for row in signals.itertuples():
        target = row.entry_price * 1.03
        stop = row.stop_price if 0 < row.stop_price < row.entry_price else row.entry_price * 0.96
        outcome, trade = "hold", "hold"
        for bar in brute(bars, row, 30).itertuples():
            if outcome == "hold":
                outcome = "win" if bar.high >= target else "loss" if bar.low <= stop else "hold"
            if trade == "hold":
                trade = "stop" if bar.low <= stop else "target" if bar.high >= target else "hold"
        assert (got.loc[(row.ticker, row.signal_date), ["outcome", "trade_status"]] == [outcome, trade]).all()


@pytest.mark.parametrize("lockout", [0, 7, 150])
def test_unbounded_scan_equals_loop(spark, scan_case, lockout):
    bars, signals = scan_case
    b, s = spark.createDataFrame(bars), spark.createDataFrame(signals)
    got = oc.track(oc.locate(s, b), b, Backtest(target_pct=25.0, lockout_days=lockout)).toPandas().set_index(["ticker", "signal_date"])
    for row in signals.itertuples():
        status, when = "holding", None
        for bar in brute(bars, row, None).itertuples():
            if bar.high >= row.entry_price * 1.25:
                status, when = "target", bar.date
            elif (bar.date - row.signal_date).days > lockout and bar.close <= row.stop_price:
                status, when = "stop", bar.date
            if when:
                break
        hit = got.loc[(row.ticker, row.signal_date)]
        assert hit.status == status and (hit.exit_date == when or (when is None and pd.isna(hit.exit_date)))


def test_locate_between_bars(spark):
    bars = frame(spark, [(1, 1, 1, 1, 1)] * 5)
    days = [dt.date(2019, 12, 1), dt.date(2020, 1, 3), dt.date(2021, 6, 1)]
    s = spark.createDataFrame([("T", d, "X") for d in days], "ticker string, signal_date date, pattern string")
    assert [r["bar_no"] for r in oc.locate(s, bars).orderBy("signal_date").collect()] == [0, 3, 5]


def test_pattern_g_equals_pivot_walk(spark):
    """Contractions found by the array fold against a plain walk over the pivots of the base."""
    bars = random_bars(3, 700, seed=21)
    got = patterns.with_contractions(feature_table(spark.createDataFrame(bars)), COVERAGE_SCAN).filter("pulls is not null").toPandas()
    assert len(got) > 20
    for row in got.sample(20, random_state=1).itertuples():
        h = bars[bars.ticker == row.ticker].sort_values("date").reset_index(drop=True).iloc[row.bar_no - 101 : row.bar_no - 1].reset_index(drop=True)
        marks = []
        for i in range(3, 97):
            if h.high[i] > h.high[i - 3 : i].max() and h.high[i] >= h.high[i + 1 : i + 4].max():
                marks.append((i, "high", h.high[i]))
            if h.low[i] < h.low[i - 3 : i].min() and h.low[i] <= h.low[i + 1 : i + 4].min():
                marks.append((i, "low", h.low[i]))
        found, highs = [], [m for m in marks if m[1] == "high"]
        for a, top in enumerate(highs):
            end = highs[a + 1][0] if a + 1 < len(highs) else 1000
            lows = [m for m in marks if m[1] == "low" and top[0] < m[0] < end]
            if lows:
                low = min(lows, key=lambda m: m[2])
                found.append((top[2], low[2], h.volume[top[0] : low[0] + 1].mean()))
        want = found[-3:]
        have = [(p["high"], p["low"], p["volume"] / p["bars"]) for p in row.pulls]
        np.testing.assert_allclose(np.array(have), np.array(want), rtol=1e-9)


def test_rescoring_is_idempotent(spark):
    args = (q_score.family_weights(spark, SF), q_score.buckets(spark, SF), q_score.transitions(spark, SF))
    keys = ["ticker", "signal_date", "pattern"]
    once = rescore.rescore(inputs.signals(spark, SF), *args)
    twice = rescore.rescore(once, *args).select(*keys, "signal_score").orderBy(*keys).collect()
    assert twice == once.select(*keys, "signal_score").orderBy(*keys).collect()
    assert all(0 <= r["signal_score"] <= 100 for r in twice)


def test_single_steps_are_idempotent(spark):
    s = penalties.penalty_features(inputs.signals(spark, SF))
    once = penalties.apply_penalties(s, q_score.buckets(spark, SF))
    again = penalties.apply_penalties(once, q_score.buckets(spark, SF))
    assert sorted(r[0] for r in once.select("signal_score").collect()) == sorted(r[0] for r in again.select("signal_score").collect())
    w = q_score.family_weights(spark, SF)
    a = scoring.apply_family_bonus(inputs.signals(spark, SF), w)
    assert a.select("signal_score").collect() == scoring.apply_family_bonus(a, w).select("signal_score").collect()


def test_blend_weights_leave_room():
    w = stscore.blend_weights({"a": 0.8, "b": 0.6})
    assert sum(w.values()) == pytest.approx(1.0) and w["logistic"] == pytest.approx(0.05)


def test_step_calibration_picks_first_bound(spark):
    steps = [(0.2, 0.1), (0.5, 0.4), (0.9, 0.7)]
    df = spark.createDataFrame([(0.1,), (0.2,), (0.21,), (0.95,), (None,)], "p double")
    assert [r[0] for r in df.select(stoprisk.step_calibration(F.col("p"), steps)).collect()] == [0.1, 0.1, 0.4, 0.7, None]


def test_overlap_weights_equal_ridge(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.random((n, 3)) < 0.4
    win = rng.random(n) < 0.3 + 0.3 * x[:, 0]
    w = rng.uniform(0.2, 1, n)
    rows = [("A", "win" if win[i] else "loss", float(w[i]), *map(bool, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "pattern_family string, outcome string, w double, a boolean, b boolean, c boolean")
    got = training.candle_overlap(df, ("a", "b", "c"), "w").filter("scope = '__global__'").toPandas().set_index("flag")
    d = np.column_stack([np.ones(n), x])
    reg = np.diag([0.0, 8, 8, 8])
    beta = np.linalg.solve(d.T @ (d * w[:, None]) + reg, d.T @ (win * w))
    np.testing.assert_allclose(got.loc[["a", "b", "c"], "coef_pp"], (beta[1:] * 100).round(2), atol=0.011)


def test_isotonic_steps_are_monotone_means(spark):
    rng = np.random.default_rng(2)
    p = rng.random(500).round(3)
    y = (rng.random(500) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    steps = models.isotonic_steps(df, "p", "y")
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(steps, steps[1:]))
    lower = -1.0
    for upper, value in steps:
        inside = (p > lower) & (p <= upper)
        assert value == pytest.approx(y[inside].mean(), abs=1e-9)
        lower = upper


def test_catalyst_ridge_falls_back_without_coverage(spark):
    df = spark.createDataFrame([(None, 1), (1.0, 0)] * 20, "f double, win_flag long")
    assert {r["mode"] for r in models.catalyst_ridge(df, ("f",)).collect()} == {"fallback"}


def test_confluence_stop_never_beyond_ten_percent(spark):
    out = positions.confluence_stop(inputs.signals(spark, SF)).select("entry_price", "stop_price").toPandas()
    assert (out.stop_price >= out.entry_price * 0.9 - 1e-3).all() and (out.stop_price < out.entry_price).all()


def test_numbers_start_at_one(spark):
    assert number_bars(inputs.bars(spark, SF)).groupBy("ticker").agg(F.min("bar_no").alias("m")).filter("m <> 1").isEmpty()
