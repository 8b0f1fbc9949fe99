"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

value is the sum of all queries' best times. The ratios say how many times as fast as the naive form others are:
"shared_vs_naive" slices on four timescales (as in the first round), "wide_shared_vs_naive" slices on 24 timescales with windows of
50 to 510 ticks and intervals of 1 to 10, "auto_vs_naive" and "wide_auto_vs_naive" the mode that multi_window chooses. "plan_seconds" are
what planning alone takes for 16 timescales over ten years of minutes, and what each change there adds."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidewheel.plans.epochs import EpochPlan
from tidewheel.plans.timescale import Registry
from tidewheel.queries import QUERIES

NAMES = (
    "mts_count_shared", "mts_count_naive", "mts_linreg", "mts_uniq_count", "mts_topk", "mts_totals", "mts_count_based", "mts_dynamic_remove",
    "mts_shared_greedy", "mts_shared_dp", "mts_grouped", "word_count_windows", "split_words", "custom_fold",
    "mts_count_auto", "mts_tree", "mts_shared_dynamic", "mts_wide_naive", "mts_wide_slices", "mts_wide_tree", "mts_wide_auto", "mts_active",
)


def plan_seconds() -> dict[str, float]:
    """Seconds that plans take to build: steady timescales, and what each of eight changes adds."""
    scales, until = [(20 + 17 * k, 1 + k % 12) for k in range(16)], 5_256_000
    changes = [(50 + 40 * k, 2 + k, 1, until // 6 * (k + 1)) for k in range(4)]
    changes += [(w, i, 2, at + until // 12) for w, i, _, at in changes]
    out = {}
    for select in ("greedy", "dp"):
        for name, signals in ((select, []), (f"{select}_changes", changes)):
            began = time.perf_counter()
            EpochPlan(Registry.of(scales).apply(signals), until, select, 3, most_edges=10**7)
            out[name] = time.perf_counter() - began
        out[f"{select}_each_change"] = (out.pop(f"{select}_changes") - out[select]) / len(changes)
    return {name: round(s, 4) for name, s in out.items()}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["mts_count_shared"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the workers
    seconds = {}
    for name in NAMES:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs), 3)
    against = {
        "shared_vs_naive": ("mts_count_naive", "mts_count_shared"), "wide_shared_vs_naive": ("mts_wide_naive", "mts_wide_slices"),
        "auto_vs_naive": ("mts_count_naive", "mts_count_auto"), "wide_auto_vs_naive": ("mts_wide_naive", "mts_wide_auto"),
    }
    ratios = {name: round(seconds[naive] / seconds[other], 2) for name, (naive, other) in against.items()}
    print(json.dumps({"metric": "multi-timescale window queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "plan_seconds": plan_seconds(), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), **ratios}))


if __name__ == "__main__":
    main()
