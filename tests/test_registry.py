"""Plug-ins of the scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barlight.config import COVERAGE_SCAN
from barlight.functions.columns import rolling
from barlight.operators import patterns, registry
from barlight.operators.patterns import Hit
from barlight.plans import inputs, q_signal

SF = "/root/testdata/sf0.001"
c = F.col


def highest(cfg):
    """An outside detector: a close above all highs of the 15 bars before, two percent below it the stop."""
    return Hit(F.lit("H_new_high"), c("close") > c("_high15"), c("close") * 0.98, F.lit(1.0), c("rsi_full"))


NEW_HIGH = registry.Detector("H", highest, lambda cfg: {"_high15": rolling(F.max, "high", 15, shift=1)})
GAP_UP = registry.CandleCheck("gap_up", lambda: c("open") > c("_high_before"), 3, lambda: {"_high_before": rolling(F.max, "high", 1, shift=1)})


@pytest.fixture
def registered():
    registry.register(NEW_HIGH)
    registry.register(GAP_UP)
    inputs.forget()
    yield
    registry.unregister_all()
    inputs.forget()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_outside_plugins_are_part_of_the_scan_without_a_shuffle(spark, registered):
    plain = patterns.scan(inputs.features(spark, SF), COVERAGE_SCAN)
    multi = q_signal.pat_multi(spark, SF)
    assert "H_new_high" in multi._jdf.queryExecution().toString() and exchanges(multi) == exchanges(plain)
    got = inputs.scan(spark, SF)
    assert "gap_up" in got.columns
    rows = got.filter("pattern_family = 'H'").collect()
    bars = {}
    for r in inputs.features(spark, SF).orderBy("ticker", "date").select("ticker", "date", "open", "high", "close").collect():
        bars.setdefault(r.ticker, []).append(r)
    want, gaps = set(), {}
    for ticker, b in bars.items():
        for i, r in enumerate(b):
            if i >= 15 and r.close > max(x.high for x in b[i - 15 : i]):
                want.add((ticker, r.date))
            gaps[ticker, r.date] = any(k > 0 and b[k].open > b[k - 1].high for k in range(max(0, i - 2), i + 1))
    assert {(r.ticker, r.signal_date) for r in rows} == want and want
    assert all(r.gap_up == gaps[r.ticker, r.signal_date] for r in got.collect())
    others = got.filter("pattern_family != 'H'").select("ticker", "signal_date", "pattern", "entry_price").collect()
    assert sorted(others) == sorted(plain.select("ticker", "signal_date", "pattern", "entry_price").collect())


def test_rsi_variants_enter_the_scores(spark):
    f = inputs.features(spark, SF)
    base, own = registry.Registry(), registry.Registry().with_rsi(registry.RsiVariant("flat", lambda: F.lit(50.0)))
    default = base.scan(f, COVERAGE_SCAN, context=()).collect()
    assert sorted(default) == sorted(patterns.scan(f, COVERAGE_SCAN, context=()).collect())
    assert len({r.score_rsi for r in own.scan(f, COVERAGE_SCAN, context=(), rsi="flat").collect()}) == 1
    assert base.scan(f, COVERAGE_SCAN, context=(), rsi="wilder").count() == len(default)


def test_names_are_checked(spark):
    r = registry.Registry()
    with pytest.raises(ValueError):
        r.with_detector(registry.Detector("A", highest))
    with pytest.raises(ValueError):
        r.scan(inputs.features(spark, SF), families=("A", "Z"))
    with pytest.raises(ValueError):
        r.scan(inputs.features(spark, SF), rsi="nothing")
