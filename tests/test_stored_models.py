"""Stored parameter tables: node tables against the fitted ensembles, and optimality of the stored coefficients on the rows they were fitted to."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.operators import models, stored
from barlight.plans import q_learn
from barlight.plans.parameters import SMALL, tables

FEATURES = ("a", "b")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 2))
    y = (np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(0, 0.5, 1200) > 0.8).astype(int)
    frame = [(i, None if i % 11 == 0 else float(a), float(b), int(t), "ABCDEFG"[i % 7]) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(frame, "i long, a double, b double, y int, pattern_family string")


@pytest.mark.parametrize("kind, size", [("random_forest", {"numTrees": 60, "maxDepth": 8}), ("gbt", {"maxIter": 25, "maxDepth": 4}), ("logistic", {}), ("margin", {})])
def test_table_scores_equal_the_models(rows, kind, size):
    fitted = models.fit(rows, "y", FEATURES, kind, **size)
    table = stored.table_of(fitted, kind)
    scored = fitted.model.transform(models.design(rows, FEATURES, fitted.stats)).withColumns({"model": fitted._raw(), "table": stored.raw_probability(table)})
    assert scored.agg(F.max(F.abs(F.col("model") - F.col("table")))).first()[0] < 1e-8
    both = fitted.score(rows, "model").withColumn("table", stored.probability(table))
    assert both.agg(F.max(F.abs(F.col("model") - F.col("table")))).first()[0] < 1e-8


def test_node_tables_hold_whole_trees(rows):
    fitted = models.fit(rows, "y", FEATURES, "random_forest", numTrees=7, maxDepth=3)
    nodes = stored.node_table(fitted.model)
    ids = [n[1] for n in nodes]
    inner = [n for n in nodes if n[2] >= 0]
    assert ids == list(range(len(nodes))) and len({n[0] for n in nodes}) == 7 and len(nodes) == 2 * len(inner) + 7
    assert sorted(i for n in inner for i in n[4:6]) == sorted(set(ids) - {min(n[1] for n in nodes if n[0] == t) for t in range(7)})


def test_stored_ensembles_are_small():
    assert {len({n[0] for n in tables()["short_term"][kind]["nodes"]}) for kind in SMALL} == {24}


def test_stored_coefficients_are_optimal_on_their_rows(spark):
    sf = "/root/testdata/sf0.01"
    assert max(abs(r["gradient"]) for r in q_learn.md_gradient(spark, sf).collect()) < 1e-5
    assert max(abs(r["residual"]) for r in q_learn.wt_candle_overlap(spark, sf).collect()) < 1e-6
    assert max(abs(r["residual"]) for r in q_learn.md_cat_ridge(spark, sf).collect()) < 1e-6


def test_wrong_coefficients_show(rows):
    table = stored.table_of(models.fit(rows, "y", FEATURES), "logistic")
    assert max(abs(r["gradient"]) for r in stored.gradient(rows, table, "y").collect()) < 1e-6
    table["coefficients"][0] += 0.1
    assert max(abs(r["gradient"]) for r in stored.gradient(rows, table, "y").collect()) > 1e-3
