"""Buckets by lookback, streams with empty and late deliveries, file readers, stored runs and fitted optima."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.config import Detection
from barlight.operators import candles, models, penalties
from barlight.operators.penalties import FEATURES
from barlight.session import checkpoint_folder, durable, run_folder
from barlight.sources import readers
from barlight.streaming.incremental import Store, lookback_bars, track_stream

DAY = dt.date(2020, 1, 1)
BAR = "date date, ticker string, open double, high double, low double, close double, volume double, bar_no long"


def bars(spark, first, closes):
    return spark.createDataFrame([(DAY + dt.timedelta(days=first + i), "T", x, x + 0.5, x - 0.5, x, 1.0, first + i + 1) for i, x in enumerate(closes)], BAR)


def test_each_lookback_has_its_own_buckets(spark):
    feature = "feature_recent_signal_count"
    buckets = spark.createDataFrame(
        [(5, feature, "A", 0.0, 10.0, True, -1.0), (20, feature, "A", 0.0, 10.0, True, -7.0), (20, feature, "__global__", 0.0, 10.0, True, -3.0)],
        "lookback long, feature string, family string, lower double, upper double, include_upper boolean, penalty double",
    )
    signals = spark.createDataFrame([(n, "A", 50.0, 2.0) for n in (5, 20, 40)] + [(20, "B", 50.0, 2.0)], f"lookback long, pattern_family string, signal_score double, {feature} double")
    signals = signals.withColumns({f: F.lit(None).cast("double") for f in FEATURES if f != feature})
    got = {(r["lookback"], r["pattern_family"]): r["score_penalty_total"] for r in penalties.apply_penalties(signals, buckets).collect()}
    assert got == {(5, "A"): -1.0, (20, "A"): -7.0, (40, "A"): 0.0, (20, "B"): -3.0}
    plain = penalties.apply_penalties(signals.drop("lookback"), buckets.filter("lookback = 5").drop("lookback")).collect()
    assert {r["score_penalty_total"] for r in plain if r["pattern_family"] == "A"} == {-1.0}
    assert penalties.apply_penalties(signals, buckets.limit(0)).filter("score_penalty_total != 0").count() == 0


def test_open_positions_survive_empty_and_late_deliveries(spark, tmp_path):
    signals = spark.createDataFrame(
        [("T", DAY + dt.timedelta(days=d), p, 100.0, 90.0, False, d + 1) for d, p in ((0, "early"), (4, "between"), (2, "late"))],
        "ticker string, signal_date date, pattern string, entry_price double, stop_price double, hold_to_target_only boolean, bar_no long",
    )
    store = Store(spark, f"file://{tmp_path}/positions")
    shown = signals.filter("pattern != 'late'")
    flat, jump = [100.0, 100.0, 100.0], [100.0, 120.0]
    for batch, (table, delivery) in enumerate([(shown, bars(spark, 0, flat)), (shown, bars(spark, 0, flat).limit(0)), (signals, bars(spark, 6, jump))]):
        track_stream(table, store)(delivery, batch)
    rows = spark.read.parquet(store.path)
    last = {r["pattern"]: r["status"] for r in rows.filter("batch = 2").collect()}
    assert last == {"early": "target", "between": "target", "late": "target"}
    assert [r["pattern"] for r in rows.filter("batch = 1 and status = 'holding'").collect()] == ["early"]


def test_positions_expire(spark, tmp_path):
    signals = spark.createDataFrame([("T", DAY, "p", 100.0, 90.0, False, 1)], "ticker string, signal_date date, pattern string, entry_price double, stop_price double, hold_to_target_only boolean, bar_no long")
    store = Store(spark, f"file://{tmp_path}/positions")
    track_stream(signals, store, expire_days=5)(bars(spark, 0, [100.0] * 10), 0)
    assert [r["status"] for r in spark.read.parquet(store.path).collect()] == ["expired"]


def test_history_follows_the_configuration():
    assert lookback_bars(Detection(base_lookback=400)) - lookback_bars(Detection(base_lookback=100)) == 300
    assert lookback_bars() > 497  # the slowest average fades below double precision


def test_bars_and_universe_are_read_from_files(spark, tmp_path):
    rows = [("2020-01-01", " AA ", "1.0", "2", "0.5", "1.5", "100"), ("2020-01-02", "^NSEI", "1", "2", "0.5", "1.5", "5"), ("bad", "BB", "1", "2", "0.5", "1.5", "5")]
    (tmp_path / "bars.csv").write_text("\n".join(["date,ticker,open,high,low,close,volume", *map(",".join, rows)]))
    text = readers.read_bars(spark, f"file://{tmp_path}/bars.csv", "csv")
    assert [(str(r["date"]), r["ticker"], r["close"]) for r in text.collect()] == [("2020-01-01", "AA", 1.5)]
    text.write.parquet(f"file://{tmp_path}/bars.parquet")
    assert readers.read_bars(spark, f"file://{tmp_path}/bars.parquet").select("ticker", "volume").collect() == text.select("ticker", "volume").collect()
    (tmp_path / "universe.txt").write_text("# list\nbb\n\n aa\nBB\n^NSEI\n")
    assert [r["ticker"] for r in readers.read_universe(spark, f"file://{tmp_path}/universe.txt").orderBy("pos").collect()] == ["BB", "AA"]


def test_stored_tables_lie_in_the_run_folder(spark):
    stored = durable(spark.range(3))
    assert run_folder(spark).startswith(checkpoint_folder(spark)) and all(run_folder(spark).rpartition("/")[2] in f for f in stored.inputFiles())


def test_hammer_counts_on_the_bar_before(spark):
    days = [(DAY + dt.timedelta(days=i), "T", h, False, False) for i, h in enumerate((True, False, False))]
    flags = spark.createDataFrame(days, "date date, ticker string, hammer boolean, engulfing boolean, piercing_variant boolean").withColumn("bar_no", F.datediff("date", F.lit(DAY)))
    signals = spark.createDataFrame([(DAY + dt.timedelta(days=i), "T", "p", "A") for i in range(3)], "signal_date date, ticker string, pattern string, pattern_family string")
    got = {r["signal_date"]: r["confirmed_hammer_a"] for r in candles.candle_combos(signals, flags).collect()}
    assert list(dict(sorted(got.items())).values()) == [True, True, False]


def test_logistic_fit_equals_gradient_descent(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.5)))).astype(int)
    w = rng.uniform(0.3, 1, 300)
    df = spark.createDataFrame([(float(a), float(b), int(t), float(k), "A") for (a, b), t, k in zip(x, y, w)], "a double, b double, y int, w double, pattern_family string")
    fitted = models.fit(df, "y", ("a", "b"), families=False, weight="w")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    mass = w * np.where(y == 1, 300 / 2 / y.sum(), 300 / 2 / (300 - y.sum()))
    beta, shift = np.zeros(2), 0.0
    for _ in range(20_000):
        rest = mass * (1 / (1 + np.exp(-(z @ beta + shift))) - y)
        beta -= 0.3 * (z.T @ rest / mass.sum() + models.L2 / 300 * beta)
        shift -= 0.3 * rest.sum() / mass.sum()
    np.testing.assert_allclose([*fitted.model.coefficients, fitted.model.intercept], [*beta, shift], atol=2e-4)
    assert models.optimality(df, "y", ("a", "b"), False, "w") == (300, int(y.sum()), True)
    with pytest.raises(ValueError, match="not in the training rows"):
        models.fit(df, "y", ("a", "absent"))
