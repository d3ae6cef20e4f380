"""The bar store by month: what is kept, what is opened, and batches that come twice."""

from __future__ import annotations

import datetime as dt

import pytest

from barlight.streaming.monthstore import MonthStore, earlier

BAR = "date date, ticker string, open double, high double, low double, close double, volume double"


def days(first, n):
    return [first + dt.timedelta(days=i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, x, x, x, x, 1.0) for t, d, x in rows], BAR)


def test_months_are_counted_back():
    assert [earlier("2001-03", k) for k in (0, 2, 3, 14, 15)] == ["2001-03", "2001-01", "2000-12", "2000-01", "1999-12"]


def test_files_opened_do_not_grow_with_history(spark, tmp_path):
    store = MonthStore(spark, f"file://{tmp_path}/bars")
    opened, stored = [], []
    for batch in range(14):
        month = dt.date(2000 + batch // 12, batch % 12 + 1, 1)
        new = frame(spark, [(t, d, 1.0 + batch) for t in "AB" for d in days(month, 28)])
        store.put(new, batch)
        history = store.history(new, 40, batch)
        opened.append(len([f for f in history.inputFiles() if "/month=" in f]))
        stored.append(sum(len(v) for v in store.versions().values()))
        assert history.groupBy("ticker").count().collect() == history.groupBy("ticker").count().filter(f"count = {min(28 * (batch + 1), 68)}").collect()
    assert opened[5:] == [opened[5]] * 9 and opened[5] <= 5 and stored == list(range(1, 15))


def test_sparse_tickers_are_followed_further_back(spark, tmp_path):
    store = MonthStore(spark, f"file://{tmp_path}/bars")
    old = [("S", dt.date(1990 + i, 1, 5), float(i)) for i in range(9)] + [("D", d, 1.0) for d in days(dt.date(1999, 1, 1), 300)]
    store.put(frame(spark, old), 0)
    new = frame(spark, [("S", dt.date(2000, 1, 5), 9.0), ("D", dt.date(2000, 1, 5), 2.0)])
    store.put(new, 1)
    got = store.history(new, 6, 1).collect()
    assert sorted(r.date.year for r in got if r.ticker == "S") == list(range(1993, 1999)) + [2000]
    assert len([r for r in got if r.ticker == "D"]) == 7


def test_corrections_and_retries(spark, tmp_path):
    store = MonthStore(spark, f"file://{tmp_path}/bars")
    d = dt.date(2020, 5, 4)
    store.put(frame(spark, [("A", d, 1.0), ("A", d + dt.timedelta(1), 1.0), ("B", d, 5.0)]), 0)
    correction = frame(spark, [("A", d, 2.0), ("A", d + dt.timedelta(40), 3.0)])
    for _ in range(2):  # the same batch twice
        store.put(correction, 1)
    store.put(frame(spark, [("A", d + dt.timedelta(2), 4.0)]), 2)
    got = {(r.ticker, (r.date - d).days): r.close for r in store.history(frame(spark, [("A", d, 0.0), ("B", d, 0.0)]), 5, 2).collect()}
    assert got == {("A", 0): 2.0, ("A", 1): 1.0, ("A", 2): 4.0, ("A", 40): 3.0, ("B", 0): 5.0}
    assert {m: sorted(v) for m, v in store.versions().items()} == {"2020-05": [1, 2], "2020-06": [1]}


@pytest.mark.parametrize("upto, close", [(0, 1.0), (1, 2.0)])
def test_a_retried_batch_reads_what_it_found(spark, tmp_path, upto, close):
    store = MonthStore(spark, f"file://{tmp_path}/bars")
    d = dt.date(2020, 5, 4)
    store.put(frame(spark, [("A", d, 1.0)]), 0)
    store.put(frame(spark, [("A", d, 2.0)]), 1)
    path = store.live(upto)["2020-05"]
    assert spark.read.schema(BAR).parquet(path).first()["close"] == close
