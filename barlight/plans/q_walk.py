"""Queries of walk-forward and hold-out evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.config import Outcome
from barlight.functions.columns import rounded
from barlight.operators import evaluate, walkforward as wf
from barlight.plans import inputs
from barlight.plans.q_learn import PREP
from barlight.plans.q_score import SCORES, outcomes, rescored_history, st_rows
from barlight.plans.queries import query
from barlight.session import durable

c = F.col
K = ("ticker", "signal_date", "pattern")
LABEL = "stop_before_target"
CUTOFF = "2000-06-30"
RAW = ("signal_score", "score_risk")


def complete(spark, sf, rows):
    """Rows old enough for their horizon; labels of those whose instrument has fewer bars than that are unknown."""
    known = rows.withColumn(LABEL, F.when(c("bars_available") >= Outcome().horizon, c(LABEL)))
    return evaluate.complete_only(known, inputs.stored_bars(spark, sf), Outcome().horizon)


def candidates() -> dict[str, wf.Candidate]:
    return {name: wf.CANDIDATES[name] for name in wf.DEFAULT_CANDIDATES}


@inputs.plan_once
def stop_risk_walk(spark, sf):
    """Every candidate fitted before each month and scored on it."""
    rows, months = wf.by_month(complete(spark, sf, rescored_history(spark, sf)))
    return wf.evaluate(rows, months, candidates(), (*K, "signal_score"), wf.Policy())


@inputs.plan_once
def stop_risk_holdout(spark, sf):
    """The same with a single cut, and training rows that count less the older they are."""
    rows, names = wf.by_cutoff(complete(spark, sf, rescored_history(spark, sf)), CUTOFF)
    return wf.evaluate(rows, names, candidates(), (*K, "month", "signal_score"), wf.Policy(half_life_months=12.0), last_train_day=CUTOFF)


@query
def ev_walk_forward(spark, sf):
    """Scores of all candidates for rows that their fits had not seen."""
    return stop_risk_walk(spark, sf).scores.select("candidate_name", *K, "fold", "train_rows", LABEL, "score")


@query
def ev_walk_forward_monthly(spark, sf):
    return wf.monthly_metrics(stop_risk_walk(spark, sf).scores, LABEL)


@query
def ev_walk_forward_summary(spark, sf):
    return with_specification(wf.pooled_summary(stop_risk_walk(spark, sf).scores, LABEL))


def with_specification(summary):
    sets = F.create_map(*[F.lit(v) for name, x in candidates().items() for v in (name, x.feature_set)])
    families = F.create_map(*[F.lit(v) for name, x in candidates().items() for v in (name, x.families)])
    return summary.withColumns({"feature_set": sets[c("candidate_name")], "include_family_features": families[c("candidate_name")]})


@query
def ev_walk_forward_folds(spark, sf):
    """What each fold trains and is scored on, per candidate."""
    walk = stop_risk_walk(spark, sf)
    schema = "candidate_name string, feature_set string, include_family_features boolean, fold string, earlier_rows long, train_rows long, positives long"
    folds = spark.createDataFrame([row[:-1] for row in wf.fold_table(walk)], schema)  # candidates x months
    tested = walk.scores.groupBy("candidate_name", "fold").agg(F.count("*").alias("test_rows"), rounded(F.avg(LABEL), 4).alias("realized_stop_rate"))
    return folds.join(tested, ["candidate_name", "fold"])


@query
def ev_walk_forward_statistics(spark, sf):
    """Median, mean and spread of every feature over the rows before each fold."""
    rows, months = wf.by_month(complete(spark, sf, outcomes(spark, sf)))
    rows = durable(rows.select("period", "signal_date", LABEL, *PREP))
    stats = wf.period_statistics(rows, PREP, LABEL, "signal_date")
    folds = wf.folds_of(stats, months, wf.Policy())
    s = wf.fold_statistics(rows.filter(c(LABEL).isNotNull()), PREP, stats, folds, len(months))
    cells = [(fold.name, f, *(float(x[k, i]) for x in (s.median, s.mean, s.spread))) for k, fold in enumerate(folds) for i, f in enumerate(PREP)]
    out = spark.createDataFrame(cells, "fold string, feature string, median double, mean double, std double")
    return out.select("fold", "feature", *[rounded(c(x), 6).alias(x) for x in ("median", "mean", "std")])


@inputs.plan_once
def raw_scores(spark, sf):
    """A score table of columns that need no fit, over the folds of the walk-forward."""
    rows, months = wf.by_month(complete(spark, sf, outcomes(spark, sf)))
    folds = wf.folds_of(wf.period_statistics(rows, (), LABEL, "signal_date"), months, wf.Policy())
    known = rows.filter(c(LABEL).isNotNull() & c("period").isin([f.period for f in folds]))
    size = F.create_map(*[F.lit(v) for f in folds for v in (f.name, f.rows)]) if folds else F.create_map(F.lit(""), F.lit(0))
    cells = F.array(*[F.struct(F.lit(name).alias("candidate_name"), rounded(1.0 - c(name) / 100.0, 4).alias("score")) for name in RAW])
    return durable(known.select(*K, c("month").alias("fold"), size[c("month")].cast("long").alias("train_rows"), LABEL, "signal_score", F.explode(cells).alias("_c")).select("*", "_c.*").drop("_c"))


@query
def ev_score_table_monthly(spark, sf):
    return wf.monthly_metrics(raw_scores(spark, sf), LABEL)


@query
def ev_score_table_summary(spark, sf):
    return wf.pooled_summary(raw_scores(spark, sf), LABEL)


@query
def ev_holdout(spark, sf):
    """One cutoff: fit up to it, report tail rates after it, per candidate."""
    held = stop_risk_holdout(spark, sf)
    sizes = held.scores.groupBy("candidate_name").agg(F.max("train_rows").alias("train_rows"), F.count("*").alias("test_rows"))
    by_month = held.scores.drop("fold").withColumnRenamed("month", "fold")
    return with_specification(wf.pooled_summary(by_month, LABEL)).join(sizes, "candidate_name").withColumn("train_end_date", F.lit(CUTOFF).cast("date"))


@query
def ev_holdout_monthly(spark, sf):
    return wf.monthly_metrics(stop_risk_holdout(spark, sf).scores.drop("fold").withColumnRenamed("month", "fold"), LABEL)


SHORT_TERM_CANDIDATES = {loss: wf.Candidate(SCORES, True, "short_term", loss) for loss in ("logistic", "margin")}


@inputs.plan_once
def short_term_walk(spark, sf):
    """Short-term fits before each month with at least six months before it."""
    rows, months = wf.by_month(st_rows(spark, sf))
    policy = wf.Policy(label="st_hit_target_7d", min_train_rows=1, min_train_periods=6)
    return wf.evaluate(rows, months, SHORT_TERM_CANDIDATES, (*K, "return_pct", "status"), policy)


@query
def ev_st_walk_forward(spark, sf):
    """Ranking metrics of both short-term fits and their blend over all folds, with differences to the logistic one."""
    scores = short_term_walk(spark, sf).scores
    wide = scores.groupBy("fold", *K, "return_pct", "status").agg(*[F.max(F.when(c("candidate_name") == x, c("score"))).alias(x) for x in SHORT_TERM_CANDIDATES])
    modes = {"logistic": c("logistic") * 100.0, "margin": c("margin") * 100.0, "logistic+margin": (c("logistic") + c("margin")) / 2.0 * 100.0}
    long = durable(evaluate.explode_scores(wide, modes, ("fold", "return_pct", "status")))
    months = long.groupBy("mode").agg(F.count_distinct("fold").alias("folds_used"))
    out = evaluate.add_deltas(evaluate.ranking_metrics(long, ["mode"], "score"), "mode", "logistic").join(months, "mode")
    return out.select("mode", "folds_used", "n_scored", "n_closed_scored", *[rounded(c(m), 6).alias(m) for m in evaluate.METRICS], *[rounded(c(f"{m}_delta"), 6).alias(f"{m}_delta") for m in evaluate.METRICS])
