"""Parameter tables that queries and their statements score from, and how they are fitted anew: python -m barlight.plans.parameters SF_DIR

Tables are fitted artifacts like any deployment keeps; models.json was fitted to the given tables at scale 0.01.
"""

from __future__ import annotations

import json
import sys
from functools import lru_cache
from pathlib import Path

FILE = Path(__file__).with_name("models.json")
VERSION = 1
SMALL = {"random_forest": {"numTrees": 24, "maxDepth": 4}, "gbt": {"maxIter": 24, "maxDepth": 3}}
"""Sizes of the stored ensembles; fits of production size keep the estimators' own."""


@lru_cache(maxsize=1)
def tables() -> dict:
    return json.loads(FILE.read_text())


def fit_tables(spark, sf: str) -> dict:
    """All stored tables, fitted to the labelled rows of *sf*."""
    from barlight.config import Outcome
    from barlight.operators import candles, catalysts, models, stoprisk, stored, training  # noqa: F401
    from barlight.plans.q_learn import candle_rows, catalyst_rows
    from barlight.plans.q_score import CATALYST_FEATURES, CATALYST_WEIGHTS, SCORES, outcomes, st_rows

    short = st_rows(spark, sf)
    out = {"version": VERSION, "short_term": {}, "stop_risk": {}}
    for kind in ("logistic", "margin", "random_forest", "gbt"):
        fitted = models.fit(short, "st_hit_target_7d", SCORES, kind, weight="sample_weight", **SMALL.get(kind, {}))
        out["short_term"][kind] = stored.table_of(fitted, kind)
    known = outcomes(spark, sf).filter(f"bars_available >= {Outcome().horizon}")
    for target in stoprisk.TARGETS:
        out["stop_risk"][target] = stored.table_of(models.fit(known, target, SCORES), "logistic")
    out["candle_overlap"] = training.overlap_coefficients(training.add_recency_weight(candle_rows(spark, sf)), candles.WEIGHT_FLAGS, "sample_weight")
    ridge = models.catalyst_ridge(catalyst_rows(spark, sf), CATALYST_FEATURES, baseline=CATALYST_WEIGHTS, digits=stored.DIGITS, cap=float("inf")).collect()
    out["catalyst"] = {r["feature"]: r["coefficient"] for r in ridge}
    return out


def main() -> None:
    from barlight.session import end_run, local_session

    spark = local_session()
    text = json.dumps(fit_tables(spark, sys.argv[1]), indent=None, separators=(",", ":"))
    FILE.write_text(text.replace('"nodes":', '\n"nodes":').replace('"kind":', '\n"kind":') + "\n")
    end_run(spark)
    spark.stop()
