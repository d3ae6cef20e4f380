"""Open positions as keyed state: three deliveries, one empty and one late, timers, and the size of the state."""

from __future__ import annotations

import datetime as dt

import pytest

from barlight.streaming import positions as kp

DAY = dt.date(2020, 1, 1)
BARS = "ticker string, date date, high double, close double"
SIGNALS = "ticker string, signal_date date, pattern string, entry_price double, stop_price double, hold_to_target_only boolean"


class Feed:
    """A folder that deliveries land in, and the job that reads it."""

    def __init__(self, spark, home, **options):
        self.spark, self.home, self.options, self.rows, self.n = spark, f"file://{home}", options, {}, 0

    def deliver(self, bars=(), signals=()):
        bar_rows = self.spark.createDataFrame([(t, DAY + dt.timedelta(days=d), x + 0.5, float(x)) for t, d, x in bars], BARS)
        signal_rows = self.spark.createDataFrame([(t, DAY + dt.timedelta(days=d), p, 100.0, stop, hold) for t, d, p, stop, hold in signals], SIGNALS)
        events = kp.bar_events(bar_rows).unionByName(kp.signal_events(signal_rows))
        events.coalesce(1).write.parquet(f"{self.home}/in/delivery={self.n}")
        self.n += 1
        stream = self.spark.readStream.schema(events.schema).parquet(f"{self.home}/in/*").select(*events.columns)
        kp.run_tracking(stream, self.keep, f"{self.home}/checkpoint", **self.options)

    def keep(self, batch, number):
        for r in batch.collect():
            self.rows.setdefault((r.ticker, (r.signal_date - DAY).days, r.pattern), []).append((r.status, r.exit_date and (r.exit_date - DAY).days, r.exit_price))

    def state(self):
        stored = self.spark.read.format("statestore").load(f"{self.home}/checkpoint")
        return {r[0]: r[1] for r in stored.selectExpr("key.ticker", "size(value.groupState.pattern)").collect()}


def test_positions_over_three_deliveries(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.deliver([("T", d, 100) for d in range(4)] + [("U", 0, 100)], [("T", 0, "early", 90.0, False), ("U", 0, "quiet", None, False)])
    feed.deliver()
    assert feed.rows == {("T", 0, "early"): [("holding", None, None)], ("U", 0, "quiet"): [("holding", None, None)]}
    late = [("T", 2, "late", 90.0, False), ("T", 4, "between", 99.9, False), ("T", 4, "held", 99.9, True), ("T", 0, "early", 50.0, False)]
    feed.deliver([("T", 6, 100), ("T", 14, 99), ("T", 7, 101), ("T", 20, 120)], late)
    assert feed.rows[("T", 0, "early")] == [("holding", None, None), ("target", 20, 106.0)]  # the repeated signal didn't replace it
    assert feed.rows[("T", 2, "late")] == [("target", 20, 106.0)] and feed.rows[("T", 4, "held")] == [("target", 20, 106.0)]
    assert feed.rows[("T", 4, "between")] == [("stop", 14, 99.9)]
    assert feed.state() == {"U": 1}  # closed positions leave no state


def test_positions_expire_by_bars_and_by_timer(spark, tmp_path):
    feed = Feed(spark, tmp_path, expire_days=10, lateness="2 days")
    feed.deliver([("T", d, 100) for d in range(3)] + [("U", 0, 100)], [("T", 0, "a", 90.0, False), ("U", 0, "b", 90.0, False), ("U", 1, "c", 90.0, False)])
    assert feed.state() == {"T": 1, "U": 2}
    feed.deliver([("T", 11, 100)])
    assert feed.rows[("T", 0, "a")][-1] == ("expired", 11, None)
    feed.deliver([("T", 40, 100)], [("T", 39, "new", 90.0, False)])
    for key in (("U", 0, "b"), ("U", 1, "c")):  # no bar of U came: the watermark, two days behind, expired them
        assert [r[0] for r in feed.rows[key]] == ["holding", "expired"]
    assert feed.state() == {"T": 1}


def test_settings_are_restored(spark):
    before = spark.conf.get(next(iter(kp.SETTINGS)), None)
    with pytest.raises(RuntimeError), kp.state_settings(spark):
        assert "RocksDB" in spark.conf.get(next(iter(kp.SETTINGS)))
        raise RuntimeError
    assert spark.conf.get(next(iter(kp.SETTINGS)), None) == before
