"""Windows, recursive averages, ranks and keyed merges against pandas and numpy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlight.functions.columns import business_ordinal
from barlight.functions.ranks import add_average_rank, cumulative_counts, quantiles, rank_auc, spearman
from barlight.operators.indicators import feature_table
from barlight.sources.upserts import keep_first, keep_last, upsert


def random_bars(tickers=3, n=900, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(tickers):
        close = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.02, n)))
        open_ = np.r_[close[0], close[:-1]] * (1 + rng.normal(0, 0.004, n))
        high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.01, n))
        low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.01, n))
        days = pd.bdate_range("2015-01-01", periods=n).date
        for i in range(n):
            rows.append((days[i], f"T{t}", *[round(float(x[i]), 4) for x in (open_, high, low, close)], float(rng.integers(1, 500) * 100)))
    return pd.DataFrame(rows, columns=["date", "ticker", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def pdf():
    return random_bars()


@pytest.fixture(scope="module")
def computed(spark, pdf):
    return feature_table(spark.createDataFrame(pdf)).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)


def by_ticker(pdf, fn):
    return pdf.groupby("ticker", group_keys=False).apply(fn, include_groups=False).reset_index(drop=True)


@pytest.mark.parametrize(
    "name, fn",
    {
        "ema26": lambda g: g.close.ewm(span=26, adjust=False).mean(),
        "macd": lambda g: g.close.ewm(span=12, adjust=False).mean() - g.close.ewm(span=26, adjust=False).mean(),
        "signal9": lambda g: (g.close.ewm(span=12, adjust=False).mean() - g.close.ewm(span=26, adjust=False).mean()).ewm(span=9, adjust=False).mean(),
        "avg_gain": lambda g: g.close.diff().clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(),
        "sma200": lambda g: g.close.rolling(200).mean(),
        "prev_high_close": lambda g: g.close.shift(1).rolling(40).max(),
        "high252": lambda g: g.high.rolling(252).max(),
        "bb_width_min": lambda g: (4 * g.close.rolling(20).std() / g.close.rolling(20).mean()).rolling(120).min(),
        "vwap": lambda g: ((g.high + g.low + g.close) / 3 * g.volume).rolling(20).sum() / g.volume.rolling(20).sum(),
        "ret_60": lambda g: g.close.pct_change(60, fill_method=None) * 100,
        "swing_low10": lambda g: g.low.shift(1).rolling(10).min(),
    }.items(),
)
def test_indicator_equals_pandas(pdf, computed, name, fn):
    want = by_ticker(pdf.sort_values(["ticker", "date"]), fn)
    np.testing.assert_allclose(computed[name].to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9)


def test_no_look_ahead(spark, pdf, computed):
    """Cutting the future away leaves every earlier row as it was, but for the columns that look forward by definition."""
    cut = sorted(pdf.date.unique())[600]
    short = feature_table(spark.createDataFrame(pdf[pdf.date <= cut])).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    long = computed[computed.date <= cut].reset_index(drop=True)
    columns = [x for x in short.columns if x not in ("next_open", "pivot_high", "pivot_low", "date", "ticker")]
    np.testing.assert_allclose(short[columns].to_numpy(float), long[columns].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_business_ordinal_equals_offsets(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    rows = [(d, e) for d in days for e in days]
    df = spark.createDataFrame(rows, "d date, e date").select("d", "e", business_ordinal(F.col("d")).alias("u"), business_ordinal(F.col("e")).alias("v"))
    for r in df.toPandas().itertuples():
        for n in (1, 3, 5):
            assert (r.v <= r.u - n) == (pd.Timestamp(r.e) <= pd.Timestamp(r.d) - pd.offsets.BDay(n))


@pytest.fixture(scope="module")
def skewed():
    """Two groups; one value holds a third of all rows."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random(6000) < 0.34, 5.0, np.round(rng.normal(5, 3, 6000), 2))
    g = np.where(rng.random(6000) < 0.9, "a", "b")
    return pd.DataFrame({"g": g, "x": x, "y": (rng.random(6000) < 0.4).astype("int64"), "z": np.round(x + rng.normal(0, 2, 6000), 1)})


def test_quantiles_equal_numpy(spark, skewed):
    out = quantiles(spark.createDataFrame(skewed), ["g"], "x", {"q20": 0.2, "q50": 0.5, "q83": 0.83}).toPandas().set_index("g")
    for g, part in skewed.groupby("g"):
        np.testing.assert_allclose(out.loc[g, ["q20", "q50", "q83"]].astype(float), np.quantile(part.x, [0.2, 0.5, 0.83]))
        assert out.loc[g, "n"] == len(part) and out.loc[g, "distinct_n"] == part.x.nunique()


def test_ranks_equal_pandas(spark, skewed):
    out = add_average_rank(spark.createDataFrame(skewed.reset_index()), "x", "r").toPandas().set_index("index").sort_index()
    np.testing.assert_allclose(out.r, skewed.x.rank(method="average"))


def test_rank_statistics(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = spearman(df, "x", "z").first()
    assert got["rank_corr"] == pytest.approx(skewed.x.rank().corr(skewed.z.rank()), abs=1e-9) and got["n"] == len(skewed)
    pos, neg = skewed.x[skewed.y == 1].to_numpy(), skewed.x[skewed.y == 0].to_numpy()
    pairs = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert rank_auc(df, "x", "y").first()["auc"] == pytest.approx(pairs, abs=1e-9)


def test_cumulative_counts_cover_every_row(spark, skewed):
    out = cumulative_counts(spark.createDataFrame(skewed), [], "x").toPandas().sort_values("x")
    assert out.n.sum() == len(skewed) and (out.below.to_numpy() == np.r_[0, out.n.cumsum()[:-1]]).all()


def test_keyed_merges(spark):
    rows = [("hot", i, float(i)) for i in range(500)] + [("b", 7, 1.0), ("c", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, seq long, v double")
    assert {r["k"]: r["v"] for r in keep_last(df, ["k"], "seq").collect()} == {"hot": 499.0, "b": 1.0, "c": 2.0}
    assert {r["k"]: r["v"] for r in keep_first(df, ["k"], "seq").collect()}["hot"] == 0.0
    once = upsert(df, df, ["k"], "seq")
    assert sorted(map(tuple, upsert(once, df, ["k"], "seq").collect())) == sorted(map(tuple, once.collect()))
