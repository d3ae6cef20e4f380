"""Walk-forward evaluation against a plain fold-by-fold version."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest

from barlight.config import FAMILIES
from barlight.operators import walkforward as wf

FEATURES = ("a", "b", "d")
CANDIDATES = {"all": wf.Candidate(FEATURES), "bare": wf.Candidate(FEATURES[:2], False), "margin": wf.Candidate(FEATURES, True, loss="margin")}


def history(n=900, seed=2):
    rng = np.random.default_rng(seed)
    day = pd.to_datetime("2001-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 300, n)), "D")
    frame = pd.DataFrame({"key": range(n), "signal_date": day.date, "month": day.strftime("%Y-%m"), "pattern_family": rng.choice(list(FAMILIES), n)})
    frame["a"], frame["b"], frame["d"] = rng.normal(size=n), np.round(rng.gamma(2, 3, n), 1), 5.0
    frame.loc[rng.random(n) < 0.2, "a"] = np.nan
    p = 1 / (1 + np.exp(-(frame.a.fillna(0) + 0.3 * frame.b - 2)))
    frame["stop_before_target"] = (rng.random(n) < p).astype(float)
    frame.loc[rng.random(n) < 0.05, "stop_before_target"] = np.nan
    return frame


def as_rows(spark, frame):
    clean = frame.astype(object).where(frame.notna(), None)
    rows = [tuple(r) for r in clean.itertuples(index=False)]
    return spark.createDataFrame(rows, "key long, signal_date date, month string, pattern_family string, a double, b double, d double, stop_before_target double").repartition(5)


def plain_fit(x, y, w, loss):
    n, beta = len(y), np.zeros(x.shape[1])
    ridge = np.full(len(beta), wf.L2 / n)
    ridge[-1] = 0
    total = max(1, w.sum())
    for _ in range(200):
        value, slope, bend = wf.loss_terms(loss, x @ beta, y)
        gradient = x.T @ (w * slope) / total + ridge * beta
        step, size = np.linalg.lstsq((x.T * (w * bend)) @ x / total + np.diag(ridge + 1e-12), gradient, rcond=1e-13)[0], 1.0
        cost = lambda b: (w * wf.loss_terms(loss, x @ b, y)[0]).sum() / total + (ridge * b**2).sum() / 2
        while size > 1e-9 and cost(beta - size * step) > cost(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(gradient).max() < 1e-10:
            break
    return beta


def plain_scores(frame, candidate, half_life=0.0, min_rows=250, cut=None):
    """(key -> score, medians and spreads by fold) by looping over folds."""
    out, stats = {}, {}
    day = pd.to_datetime(frame.signal_date)
    folds = [("test", day <= cut, day > cut, pd.Timestamp(cut))] if cut else [(m, frame.month < m, frame.month == m, day[frame.month == m].min()) for m in sorted(frame.month.unique())]
    for name, before, test, start in folds:
        train = frame[before & frame.stop_before_target.notna()]
        if before.sum() < min_rows:
            continue
        test = frame[test & frame.stop_before_target.notna()]
        median = train[list(candidate.features)].median()
        filled = train[list(candidate.features)].fillna(median)
        mean, std = filled.mean(), filled.std(ddof=0).where(lambda s: s > 1e-8, 1.0)
        stats[name] = median, mean, std

        def design(rows):
            parts = [((rows[list(candidate.features)].fillna(median) - mean) / std).to_numpy()]
            if candidate.families:
                parts.append(np.stack([(rows.pattern_family == f).to_numpy(float) for f in FAMILIES], axis=1))
            return np.column_stack([*parts, np.ones(len(rows))])

        y = train.stop_before_target.to_numpy()
        age = np.maximum((start - pd.to_datetime(train.signal_date)).dt.days.to_numpy(), 0) / 30.4375
        recency = 0.5 ** (age / half_life) if half_life else np.ones(len(y))
        w = np.where(y == 1, len(y) / 2 / max(1, y.sum()), len(y) / 2 / max(1, len(y) - y.sum())) * recency
        beta = plain_fit(design(train), y, w, candidate.loss)
        cell = wf.cell_of(wf.sigmoid(design(train) @ beta))
        pooled = pd.DataFrame({"x": cell, "w": recency, "s": recency * y}).groupby("x").sum().reset_index()
        steps = wf.pool(pooled.x.to_numpy() / wf.CELLS, pooled.w.to_numpy(), pooled.s.to_numpy())
        out |= dict(zip(test.key, wf.stepped(wf.sigmoid(design(test) @ beta), steps)))
    return out, stats


@pytest.mark.parametrize("half_life", [0.0, 3.0])
def test_walk_forward_equals_loop_over_folds(spark, half_life):
    frame = history()
    rows, months = wf.by_month(as_rows(spark, frame))
    got = wf.evaluate(rows, months, CANDIDATES, ("key",), wf.Policy(half_life_months=half_life))
    assert max(f.gradient for f in got.fits.values()) < 1e-7
    scores = got.scores.collect()
    for name, candidate in CANDIDATES.items():
        want, stats = plain_scores(frame, candidate, half_life)
        mine = {r.key: r.score for r in scores if r.candidate_name == name}
        assert mine.keys() == want.keys()
        assert np.mean([abs(mine[k] - want[k]) < 2e-4 for k in want]) > 0.99  # a score on a cell's border may fall on either side
    s, at = got.design.statistics, {f.name: k for k, f in enumerate(got.design.folds)}
    for fold, (median, mean, std) in plain_scores(frame, CANDIDATES["all"])[1].items():
        for i, f in enumerate(FEATURES):
            assert s.median[at[fold], i] == median[f] and s.mean[at[fold], i] == pytest.approx(mean[f]) and s.spread[at[fold], i] == pytest.approx(std[f])


def test_holdout_equals_plain_version(spark):
    frame = history()
    cut = datetime.date(2001, 6, 15)
    rows, names = wf.by_cutoff(as_rows(spark, frame), str(cut))
    got = wf.evaluate(rows, names, {"all": CANDIDATES["all"]}, ("key",), wf.Policy(half_life_months=3.0), last_train_day=str(cut))
    want, _ = plain_scores(frame, CANDIDATES["all"], 3.0, cut=pd.Timestamp(cut))
    mine = {r.key: r.score for r in got.scores.collect()}
    assert mine.keys() == want.keys() and np.mean([abs(mine[k] - want[k]) < 2e-4 for k in want]) > 0.99


@pytest.mark.parametrize("limit", [0, 30, 10**6])
def test_medians_are_exact_however_often_they_are_narrowed(spark, monkeypatch, limit):
    monkeypatch.setattr(wf, "EXACT_VALUES", limit)
    monkeypatch.setattr(wf, "PIVOTS", 7)
    frame = history(500, 5)
    rows, months = wf.by_month(as_rows(spark, frame))
    labelled = rows.filter("stop_before_target is not null")
    stats = wf.period_statistics(labelled, FEATURES, "stop_before_target", "signal_date")
    folds = wf.folds_of(stats, months, wf.Policy(min_train_rows=1))
    got = wf.fold_statistics(labelled, FEATURES, stats, folds, len(months)).median
    known = frame[frame.stop_before_target.notna()]
    assert got.tolist() == [[known[known.month < f.name][x].median() for x in FEATURES] for f in folds]


def test_metrics_of_a_score_table(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"candidate_name": rng.choice(["x", "y"], 400), "fold": rng.choice(["1", "2", "3"], 400), "train_rows": 7, "y": rng.integers(0, 2, 400), "score": np.round(rng.random(400), 2), "signal_score": rng.integers(0, 99, 400).astype(float)})
    table = spark.createDataFrame(frame)
    for r in wf.monthly_metrics(table, "y").collect():
        part = frame[(frame.candidate_name == r.candidate_name) & (frame.fold == r.fold)]
        low, high = part.score.quantile(0.2), part.score.quantile(0.8)
        assert (r.train_rows, r.test_rows) == (7, len(part)) and r.realized_stop_rate == pytest.approx(part.y.mean(), abs=1e-4)
        assert r.spearman_stop_risk_vs_stop == pytest.approx(part.score.rank().corr(part.y.rank()), abs=1e-4)
        assert r.low20_stop_rate == pytest.approx(part[part.score <= low].y.mean(), abs=1e-4) and r.high20_stop_rate == pytest.approx(part[part.score >= high].y.mean(), abs=1e-4)
    for r in wf.pooled_summary(table, "y").collect():
        part = frame[frame.candidate_name == r.candidate_name]
        assert (r.oos_rows, r.months) == (len(part), 3) and r.baseline_top_cut == pytest.approx(part.signal_score.quantile(0.8), abs=1e-4)


def test_histories_without_a_usable_fold(spark):
    frame = history(60)
    for part in (frame, frame[:0], frame.assign(stop_before_target=None)):
        rows, months = wf.by_month(as_rows(spark, part))
        got = wf.evaluate(rows, months, CANDIDATES, ("key",))
        assert got.scores.count() == 0 and got.scores.columns == ["candidate_name", "fold", "train_rows", "key", "stop_before_target", "score"]
        assert wf.monthly_metrics(got.scores, "stop_before_target").count() == 0
    with pytest.raises(ValueError):
        wf.evaluate(rows, months, {"x": wf.Candidate(("nothing",))}, ("key",))
