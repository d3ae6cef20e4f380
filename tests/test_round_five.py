"""Few passes over the bars, few bars under the detectors, and no generated methods that the JVM won't compile."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barlight.config import COVERAGE_SCAN
from barlight.operators import indicators, patterns, stoprisk, stored
from barlight.plans import inputs
from barlight.plans.parameters import tables
from barlight.session import compiled_steps, durable

SF = "/root/testdata/sf0.001"
LIMIT = "spark.sql.codegen.hugeMethodLimit"


def _count(df, node):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return sum(line.lstrip(" +-:*()0123456789").startswith(node) for line in plan.splitlines())


def test_features_of_short_histories_take_four_passes_and_bars_one_sort(spark):
    kept = inputs.stored_bars(spark, SF)
    table = indicators.feature_table(kept, longest=indicators.longest_history(kept))
    assert _count(table, "Window [") == 4 and _count(table, "Sort [") == 1
    assert _count(inputs.bars(spark, SF), "Sort [") == 1


def test_detectors_see_candidates_only_and_find_what_all_bars_give(spark):
    table = durable(inputs.kept_features(spark, "/root/testdata/sf0.01"))
    hits = {f: build(COVERAGE_SCAN) for f, build in patterns.DETECTORS.items()}
    whole = patterns.with_contractions(table, COVERAGE_SCAN)
    want = {(f, r.ticker, r.date) for f, hit in hits.items() for r in whole.filter(hit.when).select("ticker", "date").collect()}
    got = patterns.detect(table, cfg=COVERAGE_SCAN)
    assert {(r.pattern_family, r.ticker, r.signal_date) for r in got.select("pattern_family", "ticker", "signal_date").collect()} == want
    assert {f for f, *_ in want} == set(patterns.DETECTORS)
    seen = patterns._candidates(table, tuple(patterns.DETECTORS), COVERAGE_SCAN, patterns.DETECTORS)
    assert seen.count() < table.count() / 4
    pulls = ["ticker", "date", F.to_json("pulls").alias("p")]
    some = whole.filter("pulls is not null").select(*pulls).join(seen.select("ticker", "date"), ["ticker", "date"])
    assert some.count() > 0 and some.exceptAll(seen.filter("pulls is not null").select(*pulls)).isEmpty()


def test_hand_over_tables_are_written_without_huge_methods(spark):
    before = spark.conf.get(LIMIT)
    with compiled_steps(spark):
        assert int(spark.conf.get(LIMIT)) <= 8000
    assert spark.conf.get(LIMIT) == before
    with pytest.raises(ZeroDivisionError), compiled_steps(spark):
        1 / 0
    assert spark.conf.get(LIMIT) == before


@pytest.mark.parametrize("kind", ["logistic", "random_forest", "gbt"])
def test_stored_models_compute_their_inputs_once_a_row(spark, kind):
    """The inputs are drawn anew whenever they are computed: one draw a row, or no step would fit the probability."""
    table = tables()["short_term"][kind]
    names = [*table["features"]]
    rows = spark.createDataFrame([(i, "ABCDEFG"[i % 7]) for i in range(40)], "id long, pattern_family string").coalesce(1)
    drawn = rows.select("*", *[(F.rand(k) * 90).alias(x) for k, x in enumerate(names)])
    kept = durable(drawn)
    want = [r.p for r in kept.orderBy("id").select(stored.probability(table).alias("p")).collect()]
    mixed = drawn.withColumns({x: F.rand(k) * 90 for k, x in enumerate(names)}).select("id", stored.probability(table).alias("p"))
    assert [r.p for r in mixed.orderBy("id").collect()] == want


def test_values_read_from_outside_are_bound(spark):
    p = F.rand(7)
    steps = [(i / 50, float(i)) for i in range(1, 51)]
    drawn = spark.range(200, numPartitions=1).select(p.alias("p"), stoprisk.step_calibration(F.rand(7), steps).alias("v"))
    assert all(r.v == min(v for upper, v in steps if r.p <= upper) for r in drawn.collect())
    assert spark.sql("select cast(null as double) as p").select(stoprisk.step_calibration(F.col("p"), steps)).first()[0] is None
