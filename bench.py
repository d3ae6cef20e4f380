"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

from barlight.session import end_run, local_session

# From the raw table to the result, nothing stored beforehand.
WHOLE = ("ind_feature_table", "cdl_engulfing_confirmed", "pat_multi", "mk_train", "rg_breadth", "upsert_bars", "sel_allocate", "str_bars")
# Steps that read the stored bars and signal history, as a deployment would.
STORED = (
    "ot_forward_30d", "ot_tracker", "pos_summary", "pos_grid", "tr_history", "wt_family", "wt_penalty_buckets", "wt_lookback_select", "wt_candle_marginal",
    "st_boosters", "cat_event_adjust", "ev_quintile_lift", "vw_coverage",
)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    from barlight.plans import inputs
    from barlight.plans.queries import all_queries

    queries = all_queries()
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times = {name: timed(lambda: run(name)) for name in WHOLE}
    times["store_bars"] = timed(lambda: inputs.stored_bars(spark, sf_dir))
    times["store_signals"] = timed(lambda: inputs.signals(spark, sf_dir))
    times |= {name: timed(lambda: run(name)) for name in STORED}
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))
    sys.stdout.flush()
    end_run(spark)
    spark.stop()


if __name__ == "__main__":
    main()
