"""Expanding walk-forward and hold-out evaluation of many candidate models at once.

Rows carry a *period* (0, 1, 2, ...): fold p trains on the periods before p and is scored on period p. A hold-out is the same with two periods.
All folds of all candidates are fitted together. What depends on a fold's training rows is a cumulative sum of sufficient statistics per period:
class counts, moments and exact medians come from grouped jobs whose size doesn't depend on the number of folds, and each Newton step of all
fits is one pass over the rows, in which a row adds to the gradient and curvature of the folds after its period. Fits start from
the optimum over all rows, so few steps are needed. Calibration counts training scores in cells, again for all folds in one pass.

The driver holds parameters only: numbers per candidate, fold and feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlight.config import FAMILIES
from barlight.functions.columns import as_int, rounded
from barlight.functions.ranks import spearman
from barlight.operators.evaluate import tail_rates
from barlight.operators.stoprisk import FEATURE_SETS
from barlight.session import durable

c = F.col


@dataclass(frozen=True)
class Candidate:
    """A feature set, with or without the family indicators, and the loss that fits it."""

    features: tuple[str, ...]
    families: bool = True
    feature_set: str = "custom"
    loss: str = "logistic"


# Names of the evaluated candidates and the presets they use.
CANDIDATES = {
    "full": Candidate(FEATURE_SETS["full"], True, "full"),
    "full_no_family": Candidate(FEATURE_SETS["full"], False, "full"),
    "scores_only": Candidate(FEATURE_SETS["scores_only"], True, "scores_only"),
    "scores_only_no_family": Candidate(FEATURE_SETS["scores_only"], False, "scores_only"),
    "scores_plus_row_context": Candidate(FEATURE_SETS["scores_plus_row_context"], True, "scores_plus_row_context"),
    "scores_plus_regime": Candidate(FEATURE_SETS["scores_plus_regime"], True, "scores_plus_regime"),
}
DEFAULT_CANDIDATES = ("full", "full_no_family", "scores_only", "scores_plus_row_context", "scores_plus_regime")

L2 = 0.5
CELLS = 10_000
"""Calibration pools training probabilities rounded to this many cells; scores are reported with as many."""
PIVOTS = 63
EXACT_VALUES = 500_000
"""Distinct values near medians that the driver may look at; wider brackets are narrowed by further passes."""
SALTS = 16
STEPS = 40
TOLERANCE = 1e-8


@dataclass(frozen=True)
class Policy:
    label: str = "stop_before_target"
    min_train_rows: int = 250
    min_train_periods: int = 1
    half_life_months: float = 0.0
    tail: float = 0.2


@dataclass
class Fold:
    """One evaluation period: its name, first day, the rows before it and the class counts among the labelled ones."""

    period: int
    name: str
    first_day: int
    earlier: int
    rows: int
    positives: int


@dataclass
class Statistics:
    """Per fold (first axis) and feature: median, mean and spread of the training rows."""

    features: tuple[str, ...]
    median: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


@dataclass
class Fit:
    """Parameters of one candidate in one fold, in the standardised features, the families and an intercept."""

    beta: np.ndarray
    gradient: float = np.inf
    steps: list[tuple[float, float]] = field(default_factory=list)


# ---- folds and statistics -----------------------------------------------------------------------------------------
def by_month(rows: DataFrame, month: str = "month") -> tuple[DataFrame, list[str]]:
    """*rows* with the number of their month among all months in column period, and the months; the calendar bounds their number."""
    months = [r[0] for r in rows.select(month).filter(c(month).isNotNull()).distinct().orderBy(month).collect()]
    table = F.create_map(*[F.lit(v) for i, m in enumerate(months) for v in (m, i)]) if months else F.create_map()
    return rows.filter(c(month).isNotNull()).withColumn("period", table[c(month)].cast("int") if months else F.lit(0)), months


def by_cutoff(rows: DataFrame, last_train_day: str, day: str = "signal_date") -> tuple[DataFrame, list[str]]:
    """Period 0 up to and with *last_train_day*, period 1 after it."""
    return rows.filter(c(day).isNotNull()).withColumn("period", as_int(c(day) > F.lit(last_train_day).cast("date")).cast("int")), ["train", "test"]


def period_statistics(rows: DataFrame, features: tuple[str, ...], label: str, day: str) -> list:
    """One row per period with counts, class counts, first day, and count, mean and variance of every feature over labelled rows: one grouped job."""
    known = c(label).isNotNull()
    moments = []
    for i, f in enumerate(features):
        x = F.when(known & ~F.isnan(c(f).cast("double")), c(f).cast("double"))
        moments += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    counts = [F.count("*").alias("rows"), F.count_if(known).alias("labelled"), F.count_if(c(label) == 1).alias("positives"), F.min(F.unix_date(day)).alias("first_day")]
    return rows.groupBy("period").agg(*counts, *moments).orderBy("period").collect()


def folds_of(stats: list, names: list[str], policy: Policy, last_train_day: int | None = None) -> list[Fold]:
    """Periods with enough rows, periods and both classes before them."""
    out, rows, labelled, positives = [], 0, 0, 0
    for seen, r in enumerate(stats):
        if seen >= policy.min_train_periods and rows >= policy.min_train_rows and labelled:
            out.append(Fold(r["period"], names[r["period"]], r["first_day"] if last_train_day is None else last_train_day, rows, labelled, positives))
        rows, labelled, positives = rows + r["rows"], labelled + r["labelled"], positives + r["positives"]
    return out


def expanding_medians(rows: DataFrame, features: tuple[str, ...], counts: np.ndarray, folds: list[int], periods: int) -> np.ndarray:
    """Exact medians of every feature over the periods before each of *folds*; *counts* are known values by period and feature.

    Pivots split each feature's values into cells, whose counts per period are one grouped job. The cell of a fold's median follows from cumulative counts;
    values of such cells alone are looked at again, with new pivots until few enough are left to list.
    """
    before = np.concatenate([np.zeros((1, len(features)), np.int64), np.cumsum(counts, axis=0)])
    total = np.array([before[p] for p in folds])
    out = np.zeros((len(folds), len(features)))
    wanted = {(f, k, r): None for k in range(len(folds)) for f in range(len(features)) if total[k, f] for r in {(total[k, f] - 1) // 2, total[k, f] // 2}}
    double = [c(f).cast("double") for f in features]
    pivots = [sorted(set(p or ())) for p in rows.agg(*[F.percentile_approx(F.when(~F.isnan(x), x), [i / (PIVOTS + 1) for i in range(1, PIVOTS + 1)], 1000) for x in double]).first()]
    values = rows.select(c("period").cast("int").alias("period"), F.array(*double).alias("x"))
    while todo := [key for key, found in wanted.items() if found is None]:
        cells = cell_counts(values, pivots, len(features), periods)
        seen = [np.cumsum(x, axis=0) for x in cells]  # by period
        brackets: dict[tuple[int, int], list] = {}
        for f, k, r in todo:
            running = np.cumsum(seen[f][folds[k] - 1])
            cell = int(np.searchsorted(running, r, side="right"))
            if cell % 2:
                wanted[f, k, r] = pivots[f][cell // 2]
            else:
                brackets.setdefault((f, cell // 2), []).append((k, r, int(running[cell - 1]) if cell else 0))
        if not brackets:
            break
        inside = bracketed(values, pivots, sorted(brackets))
        if inside.count() <= EXACT_VALUES:
            listed = inside.toArrow()
            f_, b_, p_, x_, n_ = (listed.column(i).to_numpy() for i in range(5))
            for (f, b), asked in brackets.items():
                at = np.flatnonzero((f_ == f) & (b_ == b))
                at = at[np.argsort(x_[at], kind="stable")]
                for k, r, offset in asked:
                    running = offset + np.cumsum(np.where(p_[at] < folds[k], n_[at], 0))
                    wanted[f, k, r] = float(x_[at][np.searchsorted(running, r, side="right")])
            break
        finer = inside.groupBy("feature").agg(F.percentile_approx("x", [i / (PIVOTS + 1) for i in range(1, PIVOTS + 1)], 1000).alias("p")).collect()
        for r in finer:
            pivots[r["feature"]] = sorted({*pivots[r["feature"]], *r["p"]})
    for k in range(len(folds)):
        for f in range(len(features)):
            if n := total[k, f]:
                out[k, f] = (wanted[f, k, (n - 1) // 2] + wanted[f, k, n // 2]) / 2
    return out


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column; missing values are NaN."""
    return column.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)


def cells_of(x: np.ndarray, pivots: list[float]) -> np.ndarray:
    """2 i between pivots i - 1 and i, 2 i + 1 on pivot i."""
    edges = np.array(pivots)
    at = np.searchsorted(edges, x)
    return 2 * at + (at < len(edges)) * (edges[np.minimum(at, len(edges) - 1)] == x) if len(edges) else 2 * at


def cell_counts(values: DataFrame, pivots: list[list[float]], width: int, periods: int) -> list[np.ndarray]:
    """Known values of each feature by period and cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((periods, 2 * len(p) + 1), np.int64) for p in pivots]
        for batch in batches:
            x, period = matrix_of(batch.column("x"), width), batch.column("period").to_numpy()
            for f in range(width):
                known = ~np.isnan(x[:, f])
                np.add.at(held[f], (period[known], cells_of(x[known, f], pivots[f])), 1)
        for f, counts in enumerate(held):
            p, cell = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), f)), pa.array(p), pa.array(cell), pa.array(counts[p, cell])], ["feature", "period", "cell", "n"])

    out = [np.zeros((periods, 2 * len(p) + 1), np.int64) for p in pivots]
    table = values.mapInArrow(count, "feature long, period long, cell long, n long").groupBy("feature", "period", "cell").agg(F.sum("n").alias("n")).toArrow()
    f, p, cell, n = (table.column(i).to_numpy() for i in range(4))
    for at in range(width):
        mine = f == at
        out[at][p[mine], cell[mine]] = n[mine]
    return out


def bracketed(values: DataFrame, pivots: list[list[float]], brackets: list[tuple[int, int]]) -> DataFrame:
    """(feature, bracket, period, x, n) of the values that lie strictly inside one of *brackets*."""
    asked: dict[int, list[int]] = {}
    for f, b in brackets:
        asked.setdefault(f, []).append(2 * b)
    width = len(pivots)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, period = matrix_of(batch.column("x"), width), batch.column("period").to_numpy()
            for f, cells in asked.items():
                known = np.flatnonzero(~np.isnan(x[:, f]))
                cell = cells_of(x[known, f], pivots[f])
                inside = np.isin(cell, cells)
                rows = known[inside]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), f)), pa.array(cell[inside].astype(np.int64) // 2), pa.array(period[rows].astype(np.int64)), pa.array(x[rows, f])], ["feature", "bracket", "period", "x"])

    return values.mapInArrow(pick, "feature long, bracket long, period long, x double").groupBy("feature", "bracket", "period", "x").agg(F.count("*").alias("n"))


def fold_statistics(rows: DataFrame, features: tuple[str, ...], stats: list, folds: list[Fold], periods: int) -> Statistics:
    """Median, mean and spread (of the column with missing values at the median) of the rows before each fold; constant columns get spread 1."""
    counts = np.zeros((periods, len(features)), np.int64)
    means, spreads, sizes = np.zeros(counts.shape), np.zeros(counts.shape), np.zeros(periods, np.int64)
    for r in stats:
        sizes[r["period"]] = r["labelled"]
        for f in range(len(features)):
            counts[r["period"], f], means[r["period"], f], spreads[r["period"], f] = r[f"n{f}"], r[f"m{f}"] or 0.0, r[f"v{f}"] or 0.0
    median = expanding_medians(rows, features, counts, [f.period for f in folds], periods)
    mean, spread = np.zeros(median.shape), np.ones(median.shape)
    for k, fold in enumerate(folds):
        n, total = counts[: fold.period].astype(float), max(sizes[: fold.period].sum(), 1)
        missing = total - n.sum(axis=0)
        mean[k] = ((n * means[: fold.period]).sum(axis=0) + missing * median[k]) / total
        square = (n * (spreads[: fold.period] + (means[: fold.period] - mean[k]) ** 2)).sum(axis=0) + missing * (median[k] - mean[k]) ** 2
        s = np.sqrt(square / total)
        spread[k] = np.where(s <= 1e-8, 1.0, s)
    return Statistics(features, median, mean, spread)


# ---- fitting --------------------------------------------------------------------------------------------------------
@dataclass
class Design:
    """Everything a task needs to lay out a candidate's columns for a fold."""

    candidates: list[tuple[str, Candidate]]
    folds: list[Fold]
    statistics: Statistics
    policy: Policy

    def width(self, at: int) -> int:
        candidate = self.candidates[at][1]
        return len(candidate.features) + len(FAMILIES) * candidate.families + 1

    def columns(self, at: int, fold: int, x: np.ndarray, family: np.ndarray) -> np.ndarray:
        candidate, s = self.candidates[at][1], self.statistics
        pick = [s.features.index(f) for f in candidate.features]
        part = x[:, pick]
        part = (np.where(np.isnan(part), s.median[fold, pick], part) - s.mean[fold, pick]) / s.spread[fold, pick]
        return np.column_stack([part, *([family] if candidate.families else []), np.ones(len(x))])

    def weights(self, fold: int, label: np.ndarray, day: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Class balance by counts times recency relative to the fold's first day times the row's own weight."""
        f = self.folds[fold]
        up, down = f.rows / (2.0 * max(1, f.positives)), f.rows / (2.0 * max(1, f.rows - f.positives))
        return np.where(label > 0.5, up, down) * self.recency(fold, day) * weight

    def recency(self, fold: int, day: np.ndarray) -> np.ndarray:
        if self.policy.half_life_months <= 0:
            return np.ones(len(day))
        age = np.maximum(self.folds[fold].first_day - day, 0) / 30.4375
        return np.exp2(-age / self.policy.half_life_months)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def loss_terms(loss: str, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each row and its first and second derivative by the linear predictor."""
    if loss == "logistic":
        p = sigmoid(z)
        return np.logaddexp(0, z) - y * z, p - y, p * (1 - p)
    if loss == "margin":  # squared hinge
        sign = 2 * y - 1
        short = np.maximum(1 - sign * z, 0)
        return short**2, -2 * sign * short, 2.0 * (short > 0)
    raise ValueError(f"unknown loss {loss}")


SCHEMA = ["period", "label", "day", "weight", "family", "x"]


def training_rows(rows: DataFrame, features: tuple[str, ...], policy: Policy, day: str, weight: str | None) -> DataFrame:
    """Labelled rows as the fits read them: period, label, day number, weight, family indicators and feature values."""
    family = F.array(*[as_int(F.upper(F.trim("pattern_family")) == f).cast("double") for f in FAMILIES])
    w = F.greatest(F.coalesce(c(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    return rows.filter(c(policy.label).isNotNull()).select(
        c("period").cast("int").alias("period"), c(policy.label).cast("double").alias("label"), F.unix_date(day).cast("double").alias("day"), w.alias("weight"),
        family.alias("family"), F.array(*[c(f).cast("double") for f in features]).alias("x"),
    )


def arrays_of(batch: pa.RecordBatch, width: int) -> dict[str, np.ndarray]:
    out = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("period", "label", "day", "weight")}
    family = np.nan_to_num(matrix_of(batch.column("family"), len(FAMILIES)))
    return out | {"family": family, "x": matrix_of(batch.column("x"), width)}


def pass_over(train: DataFrame, design: Design, betas: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Weight, loss, gradient and curvature of each of the fits *betas*, keyed by candidate and fold: one pass over the rows.

    Tasks hand over one block of numbers a fit, which SALTS groups a fit add up before the driver does.
    """
    width = len(design.statistics.features)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = arrays_of(batch, width)
            for (at, fold), beta in betas.items():
                mine = np.flatnonzero(rows["period"] < design.folds[fold].period)
                if not len(mine):
                    continue
                x = design.columns(at, fold, rows["x"][mine], rows["family"][mine])
                w = design.weights(fold, rows["label"][mine], rows["day"][mine], rows["weight"][mine])
                value, slope, bend = loss_terms(design.candidates[at][1].loss, x @ beta, rows["label"][mine])
                sums = np.concatenate([[w.sum(), (w * value).sum()], x.T @ (w * slope), (x.T @ (x * (w * bend)[:, None])).ravel()])
                held[at, fold] = held.get((at, fold), 0) + sums
        salt = TaskContext.get().partitionId() % SALTS
        keys = list(held)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([salt] * len(keys), pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["candidate", "fold", "salt", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = 0, None
        for batch in batches:
            key = batch.select(["candidate", "fold"]).slice(0, 1)
            for sums in batch.column("sums").to_pylist():
                total = total + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([*key.columns, pa.array([total.tobytes()], pa.binary())], ["candidate", "fold", "sums"])

    blocks = train.mapInArrow(add, "candidate int, fold int, salt int, sums binary").groupBy("candidate", "fold", "salt").applyInArrow(merge, "candidate int, fold int, sums binary")
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in blocks.toArrow().to_pylist():
        key = r["candidate"], r["fold"]
        out[key] = out.get(key, 0) + np.frombuffer(r["sums"])
    return out


def newton(train: DataFrame, design: Design, starts: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], Fit]:
    """Optima of the penalised losses: mean of the weighted loss plus L2 / (2 rows) times the squared coefficients, intercept free."""
    state = {k: {"beta": b, "tried": b, "value": np.inf, "step": np.zeros(len(b))} for k, b in starts.items()}
    done: dict[tuple[int, int], Fit] = {}
    for _ in range(STEPS):
        open_fits = {k: s["tried"] for k, s in state.items() if k not in done}
        if not open_fits:
            break
        for k, sums in pass_over(train, design, open_fits).items():
            s, size = state[k], len(open_fits[k])
            ridge = np.full(size, L2 / max(1, design.folds[k[1]].rows))
            ridge[-1] = 0
            weight = max(1.0, sums[0])
            value = sums[1] / weight + (ridge * s["tried"] ** 2).sum() / 2
            if value > s["value"] + 1e-12 and np.abs(s["step"]).max() > 1e-12:
                s["step"] = s["step"] / 2  # too far: half way back
                s["tried"] = s["beta"] + s["step"]
                continue
            s["beta"], s["value"] = s["tried"], value
            gradient = sums[2 : 2 + size] / weight + ridge * s["beta"]
            if np.abs(gradient).max() < TOLERANCE:
                done[k] = Fit(s["beta"], float(np.abs(gradient).max()))
                continue
            curvature = sums[2 + size :].reshape(size, size) / weight + np.diag(ridge + 1e-12)
            s["step"] = -np.linalg.lstsq(curvature, gradient, rcond=1e-13)[0]
            s["tried"] = s["beta"] + s["step"]
            s["gradient"] = float(np.abs(gradient).max())
    return {k: done.get(k) or Fit(s["beta"], s.get("gradient", np.inf)) for k, s in state.items()}


def fit_folds(train: DataFrame, design: Design) -> dict[tuple[int, int], Fit]:
    """All candidates in all folds, started from each candidate's fit to the last fold's rows."""
    last = len(design.folds) - 1
    first = newton(train, design, {(at, last): np.zeros(design.width(at)) for at in range(len(design.candidates))})
    rest = {(at, fold): first[at, last].beta for at in range(len(design.candidates)) for fold in range(last)}
    return first | (newton(train, design, rest) if rest else {})


def pool(x: np.ndarray, weight: np.ndarray, hits: np.ndarray) -> list[tuple[float, float]]:
    """Pool-adjacent-violators over ascending *x*: (upper bound, value) of each block."""
    blocks: list[list[float]] = []
    for at, w, s in zip(x.tolist(), weight.tolist(), hits.tolist()):
        blocks.append([at, w, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] > blocks[-1][2] * blocks[-2][1]:
            right = blocks.pop()
            blocks[-1] = [right[0], blocks[-1][1] + right[1], blocks[-1][2] + right[2]]
    return [(upper, s / w) for upper, w, s in blocks]


def calibrate(train: DataFrame, design: Design, fits: dict[tuple[int, int], Fit]) -> None:
    """Isotonic steps of every fit from its training rows, whose probabilities are counted in cells: one pass for all folds of a candidate."""
    width = len(design.statistics.features)

    def count(at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(design.folds), 2, CELLS + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = arrays_of(batch, width)
            for fold, f in enumerate(design.folds):
                mine = np.flatnonzero(rows["period"] < f.period)
                if not len(mine):
                    continue
                cell = cell_of(sigmoid(design.columns(at, fold, rows["x"][mine], rows["family"][mine]) @ fits[at, fold].beta))
                w = design.recency(fold, rows["day"][mine]) * rows["weight"][mine]
                held[fold, 0] += np.bincount(cell, w, CELLS + 1)
                held[fold, 1] += np.bincount(cell, w * rows["label"][mine], CELLS + 1)
        fold, cell = np.nonzero(held[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(fold), pa.array(cell), pa.array(held[fold, 0, cell]), pa.array(held[fold, 1, cell])], ["fold", "cell", "w", "s"])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("cell")  # at most CELLS + 1 rows
        blocks = pool(table.column("cell").to_numpy() / CELLS, table.column("w").to_numpy(), table.column("s").to_numpy())
        fold = table.column("fold")[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([fold] * len(blocks), pa.int64()), pa.array([b[0] for b in blocks]), pa.array([b[1] for b in blocks])], ["fold", "upper", "value"])

    for at in range(len(design.candidates)):
        counted = train.mapInArrow(lambda batches, at=at: count(at, batches), "fold long, cell long, w double, s double")
        summed = counted.groupBy("fold", "cell").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
        for r in summed.groupBy("fold").applyInArrow(steps, "fold long, upper double, value double").collect():
            fits[at, r["fold"]].steps.append((r["upper"], r["value"]))
    for f in fits.values():
        f.steps.sort()


def cell_of(p: np.ndarray) -> np.ndarray:
    return np.floor(p * CELLS + 0.5).astype(np.int64)


def stepped(p: np.ndarray, steps: list[tuple[float, float]]) -> np.ndarray:
    """Value of the first step whose bound is at least p, to four digits."""
    if not steps:
        return np.round(p, 4)
    bound, value = np.array(steps).T
    return np.round(value[np.minimum(np.searchsorted(bound, cell_of(p) / CELLS), len(value) - 1)], 4)


# ---- evaluation -----------------------------------------------------------------------------------------------------
@dataclass
class Evaluation:
    """Folds, fits and the stored scores of the rows that no fit had seen."""

    design: Design
    fits: dict[tuple[int, int], Fit]
    scores: DataFrame


def evaluate(rows: DataFrame, names: list[str], candidates: dict[str, Candidate], keep: tuple[str, ...], policy: Policy = Policy(), day: str = "signal_date", weight: str | None = None, last_train_day: str | None = None) -> Evaluation:
    """Fit every candidate before every fold and score the fold's labelled rows.

    The scores table has columns candidate_name, fold (its period's name), train_rows, *keep*, the label and score. Without a usable fold it is empty.
    Rows with a null label count towards the rows that a fold needs and take no other part.
    """
    features = tuple(dict.fromkeys(f for candidate in candidates.values() for f in candidate.features))
    if absent := [f for f in features if f not in rows.columns]:
        raise ValueError(f"features not in the rows: {absent}")
    rows = durable(rows)  # read by every pass
    stats = period_statistics(rows, features, policy.label, day)
    last = None if last_train_day is None else int(np.datetime64(last_train_day, "D").astype(int))
    folds = folds_of(stats, names, policy, last)
    labelled = rows.filter(c(policy.label).isNotNull())
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    schema = f"candidate_name string, fold string, train_rows long, {kinds}, `{policy.label}` long, score double"
    if not folds:
        return Evaluation(Design([], [], Statistics(features, *[np.zeros((0, 0))] * 3), policy), {}, rows.sparkSession.createDataFrame([], schema))
    design = Design(list(candidates.items()), folds, fold_statistics(labelled, features, stats, folds, len(names)), policy)
    train = training_rows(labelled, features, policy, day, weight)
    fits = fit_folds(train, design)
    calibrate(train, design, fits)
    fold_at = {f.period: k for k, f in enumerate(folds)}
    tested = labelled.filter(c("period").isin(list(fold_at)))
    family = F.array(*[as_int(F.upper(F.trim("pattern_family")) == f).cast("double") for f in FAMILIES])
    ready = tested.select(*[c(k).alias(f"keep_{i}") for i, k in enumerate(keep)], c(policy.label).cast("long").alias("label"), c("period").cast("int").alias("period"), family.alias("family"), F.array(*[c(f).cast("double") for f in features]).alias("x"))
    out_names = ["candidate_name", "fold", "train_rows", *keep, policy.label, "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, family = matrix_of(batch.column("x"), len(features)), np.nan_to_num(matrix_of(batch.column("family"), len(FAMILIES)))
            period = batch.column("period").to_numpy()
            for p in np.unique(period).tolist():
                mine, fold = np.flatnonzero(period == p), fold_at[p]
                part = batch.take(pa.array(mine))
                for at, (name, _) in enumerate(design.candidates):
                    fitted = fits[at, fold]
                    z = sigmoid(design.columns(at, fold, x[mine], family[mine]) @ fitted.beta)
                    fixed = [pa.array([name] * len(mine)), pa.array([folds[fold].name] * len(mine)), pa.array(np.full(len(mine), folds[fold].rows))]
                    yield pa.RecordBatch.from_arrays([*fixed, *(part.column(f"keep_{i}") for i in range(len(keep))), part.column("label"), pa.array(stepped(z, fitted.steps))], out_names)

    return Evaluation(design, fits, durable(ready.mapInArrow(score, schema)))


def monthly_metrics(scores: DataFrame, label: str, tail: float = 0.2) -> DataFrame:
    """One row per candidate and fold of a score table: rows, rank correlation of score and label, means, and label rates of the lowest and highest scores."""
    keys = ("candidate_name", "fold")
    tails = tail_rates(scores, "score", label, tail, keys)
    means = scores.groupBy(*keys).agg(F.max("train_rows").alias("train_rows"), F.avg("score").alias("mean_score"))
    ranks = spearman(scores, "score", label, keys).select(*keys, "rank_corr")
    return tails.join(means, list(keys)).join(ranks, list(keys), "left").select(
        *keys, "train_rows", c("rows").alias("test_rows"), rounded(c("rank_corr"), 4).alias("spearman_stop_risk_vs_stop"), rounded(c("mean_score"), 4).alias("avg_signal_stop_risk"),
        rounded(c("overall_rate"), 4).alias("realized_stop_rate"), rounded(c("low_cut"), 4).alias("low20_stop_risk_cutoff"), rounded(c("high_cut"), 4).alias("high20_stop_risk_cutoff"),
        rounded(c("low_rate"), 4).alias("low20_stop_rate"), rounded(c("high_rate"), 4).alias("high20_stop_rate"),
    )


def pooled_summary(scores: DataFrame, label: str, baseline: str = "signal_score", tail: float = 0.2) -> DataFrame:
    """One row per candidate over all its folds, and the same measures of the *baseline* column on the same rows."""
    key = ("candidate_name",)
    known = scores.filter(c("score").isNotNull() & c(label).isNotNull() & c(baseline).isNotNull())
    sizes = known.groupBy(*key).agg(F.count("*").alias("oos_rows"), F.count_distinct("fold").alias("months"))
    parts = []
    for column, prefix in (("score", ""), (baseline, "baseline_")):
        tails = tail_rates(known, column, label, tail, key).select(*key, *[c(x).alias(f"{prefix}{x}") for x in ("low_cut", "high_cut", "low_rate", "high_rate")])
        ranks = spearman(known, column, label, key).select(*key, c("rank_corr").alias(f"{prefix}rank_corr"))
        parts += [tails, ranks]
    out = sizes
    for part in parts:
        out = out.join(part, list(key), "left")
    four = lambda x, name: rounded(c(x), 4).alias(name)
    return out.select(
        *key, "oos_rows", "months", four("rank_corr", "spearman_stop_risk_vs_stop"), four("low_cut", "low20_stop_risk_cutoff"), four("high_cut", "high20_stop_risk_cutoff"),
        four("low_rate", "low20_stop_rate"), four("high_rate", "high20_stop_rate"), rounded(c("high_rate") - c("low_rate"), 4).alias("stop_rate_gap_high20_minus_low20"),
        rounded(c("high_rate") / F.nullif(c("low_rate"), F.lit(0.0)) - 1.0, 4).alias("relative_lift_high_vs_low"),
        four("baseline_rank_corr", "baseline_spearman_signal_score_vs_stop"), four("baseline_high_cut", "baseline_top_cut"), four("baseline_low_cut", "baseline_bottom_cut"),
        four("baseline_high_rate", "baseline_top_stop_rate"), four("baseline_low_rate", "baseline_bottom_stop_rate"),
    )


def fold_table(evaluation: Evaluation) -> list[tuple]:
    """(candidate, feature set, families, fold, earlier rows, training rows, positives, largest gradient entry) of every fit."""
    d = evaluation.design
    return [
        (name, candidate.feature_set, candidate.families, fold.name, fold.earlier, fold.rows, fold.positives, evaluation.fits[at, k].gradient)
        for at, (name, candidate) in enumerate(d.candidates) for k, fold in enumerate(d.folds)
    ]
