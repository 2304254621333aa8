"""Times headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from unifold import registry

HEADLINE = ("ols_simple", "ols_two_regressor", "loro_xval_r2", "fdr_bh", "perm_max_fwe", "robust_z_flags", "ncsnr", "split_half", "seed_corr", "spearman", "mean_lifetime", "transition_matrix", "event_asof_label", "event_interval_label", "moving_average", "pareto_front", "weighted_percentile", "joint_topk", "expr_3dmath", "anova_two_way")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, times = registry.queries(), {}
    known["volume_means"](spark, sf).count()  # start-up
    for name in HEADLINE:
        began = time.time()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
