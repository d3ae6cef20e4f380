"""Unbounded scans through the block index against a bar-by-bar loop."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.config import Backtest
from barlight.operators import outcomes as oc

START = datetime.date(1990, 1, 1)


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(11)
    bars, signals = [], []
    for ticker, n in (("A", 5000), ("B", 700), ("C", 3), ("D", 2500)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.004, n)) if ticker != "D" else np.linspace(0, -0.0001, n))
        high = close * (1 + rng.random(n) * 0.002)
        bars += [(ticker, START + datetime.timedelta(days=i), float(x), float(h), float(x * 0.99), float(x), 1.0) for i, (x, h) in enumerate(zip(close, high))]
        for i in {0, n - 1, *rng.integers(0, n, 60).tolist()}:
            entry = float(close[i])
            stop = [None, entry * 0.97, entry * 0.8][i % 3]
            signals += [(ticker, START + datetime.timedelta(days=i), p, entry, stop, i + 1, [3.0, 20.0, 300.0][(i + k) % 3]) for k, p in enumerate("xy")]
    b = spark.createDataFrame(bars, "ticker string, date date, open double, high double, low double, close double, volume double")
    s = spark.createDataFrame(signals, "ticker string, signal_date date, pattern string, entry_price double, stop_price double, bar_no long, target_pct double")
    return bars, signals, b, s


def loop(bars, signal, target, stop, by_close, lockout):
    for ticker, date, _, high, _, close, _ in bars:
        if ticker != signal[0] or date <= signal[1]:
            continue
        if (close if by_close else high) >= target:
            return date, close, True
        if stop is not None and close <= stop and (date - signal[1]).days > lockout:
            return date, close, False
    return None


@pytest.mark.parametrize("lockout", [0, 7, 200])
def test_tracker_equals_a_loop_over_bars(market, lockout):
    bars, signals, b, s = market
    got = {(r.ticker, r.signal_date, r.pattern, r.target_pct): r for r in oc.track(s, b, Backtest(lockout_days=lockout), ("target_pct",)).collect()}
    assert len(got) == len({(x[0], x[1], x[2], x[6]) for x in signals})
    for x in signals:
        stop = x[4] if x[4] is not None else x[3] * (1 - Backtest().stop_pct / 100)
        want = loop(bars, x, x[3] * (1 + x[6] / 100), stop, False, lockout)
        r = got[x[0], x[1], x[2], x[6]]
        assert (r.exit_date, r.status) == ((want[0], "target" if want[2] else "stop") if want else (None, "holding"))


def test_sell_signals_equal_a_loop_over_bars(market):
    bars, signals, b, s = market
    got = {(r.ticker, r.buy_signal_date, r.pattern): r.sell_signal_date for r in oc.sell_signals(s, b, 9.0).collect()}
    want = {(x[0], x[1], x[2]): hit[0] for x in signals if (hit := loop(bars, x, x[3] * 1.09, None, True, 0))}
    assert got == want


def test_index_has_one_row_per_ticker_and_opens_two_groups(market):
    _, _, b, s = market
    index = oc.reach_index(oc._blocked(b), "_high")
    sizes = {r.ticker: r for r in index.select("ticker", F.size("_index").alias("groups"), F.aggregate("_index", F.lit(0), lambda n, g: n + F.size(g["blocks"])).alias("blocks")).collect()}
    assert {t: (r.groups, r.blocks) for t, r in sizes.items()} == {"A": (3, 79), "B": (1, 11), "C": (1, 1), "D": (2, 40)}
    blocks = {}
    for r in oc._blocked(b).groupBy("ticker", "_block").agg(F.max("_high").alias("top"), F.min("_close").alias("bottom")).collect():
        blocks.setdefault(r.ticker, {})[r._block] = (r.top, r.bottom)
    asked = s.select("ticker", "entry_price", (F.floor(F.col("bar_no") / 64)).alias("u"), (F.col("entry_price") * 1.2).alias("t"), (F.col("entry_price") * 0.9).alias("z"))
    for r in asked.join(index, "ticker").withColumn("far", oc.first_reach(F.col("u"), F.col("t"), F.col("z"))).collect():
        assert r.far == min((n for n, (top, bottom) in blocks[r.ticker].items() if n > r.u and (top >= r.t or bottom <= r.z)), default=None)


def test_plan_joins_by_equality_alone(market):
    _, _, b, s = market
    plan = oc.track(s, b)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
