"""Headline queries on one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dayloom import plans  # noqa: E402
from dayloom.plans import common, registry  # noqa: E402
from dayloom.session import drop_scratch, local_session  # noqa: E402

HEADLINE = [
    "E02_by_label", "E02_by_label_lines", "E10_quantiles", "E14_multi_key", "E20_spearman_daily", "E28_condition_table",
    "F02_transitions_days", "F12_pattern_summary", "F14_epochs", "F18_prior_entity", "F20_zscore", "F21_ranks",
    "F22_runs", "F28_neighbour_mean", "D02_reconcile", "D06_asof_event", "I01_rank_features", "I02_ranked_top10_lift",
    "I04_score_models", "I20_poisson_posterior", "J01_rolling_oos", "J03_adaptive_select", "J05_weight_search",
    "J09_random_baseline", "J12_signflip_test", "J17_spatial_test", "J20_period_summary", "A15_fingerprint",
]


def bootstrap_20000(spark, folder):
    """20,000 bootstrap replicates of the daily means."""
    from dayloom.operators import resampling as R
    from dayloom.panel import SITE

    return R.bootstrap_ci(common.daily(spark, folder), SITE, "mean", 20000)


def timed(fn, spark, folder) -> float:
    t0 = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    plans.load_all()
    spark = local_session(cores, shuffle=int(cores) if cores.isdigit() else 8)
    jobs = {n: registry.QUERIES[n] for n in HEADLINE}
    jobs["J10_bootstrap_20000"] = bootstrap_20000
    timed(jobs["E02_by_label"], spark, folder)  # start the JVM workers and load classes
    times = {n: round(timed(fn, spark, folder), 3) for n, fn in jobs.items()}
    drop_scratch(spark)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
