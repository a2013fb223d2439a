"""Time the headline queries: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from strayfield.plans.registry import all_queries
from strayfield.session import local_session

HEADLINE = [
    "e1_knn_l2", "e4_knn_cosine", "e7_knn_image_auroc", "e8_self_score", "e10_overlap_pairs", "c4_random_sample",
    "c12_approx_coreset", "d1_patchify", "d7_mean_vector", "f3_rollup_instances", "f6_auroc_ties", "f8_average_precision",
    "f12_pixel_metrics", "f15_iou", "f21_hard_examples", "f24_label_histogram", "f25_quadrant_histogram", "g1_zscore_outliers",
    "h3_moving_avg", "h4_ema", "j2_dilate", "j10_components", "j12_merge_masks", "j15_gaussian_smooth", "j16_paste_instances",
    "j20_combine_maps",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)))
    spark = local_session(cpus, cpus)
    registry = all_queries()
    names = sys.argv[1:] or HEADLINE
    registry["e1_knn_l2"](spark, folder).write.format("noop").mode("overwrite").save()  # starts JVM and Python workers
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
