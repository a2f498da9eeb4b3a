"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], after a warm-up, quick ones the better of two runs; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark.catalog import QUERIES
from tidemark.session import local_session

HEADLINE = ("b1_right_bins", "b4_prior_quantile", "c1_onsets", "b11_bars", "j1_asof_max_age", "m12_study", "k1_kaplan_meier", "r2_cr1", "r8_median_diff", "m13_legacy_outcomes", "g1_effects", "g4_tests", "e2_regression")
#: Queries quicker than this many seconds run again, and the better run counts.
QUICK = 10


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    def seconds(name: str) -> float:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds("c1_onsets")  # the session's start counts for no query
    took = {}
    for name in HEADLINE:
        first = seconds(name)
        took[name] = round(min(first, seconds(name)) if first < QUICK else first, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
