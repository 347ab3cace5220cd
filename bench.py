"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from figureyard.plans import registered
from figureyard.session import local_session

HEADLINE = [
    "ag7_class_by_split",
    "ag2_pipeline_counters",
    "ag13_latency_statistics",
    "flt2_crop_features",
    "flt5_figure_candidates",
    "jn2_images_pages_papers",
    "jn11_vector_rects_not_in_images",
    "jn12_captions",
    "ml2_zero_shot",
    "ml7_bootstrap_accuracy",
    "ml10_best_band",
    "ml11_detector_sweep",
    "reg1_register_first_wins",
    "reg7_fold_page_log",
    "reg8_screen_then_confirm",
    "reg15_page_batches",
    "snk3_size_capped_archives",
    "sr3_next_items_per_user",
    "wn1_paper_splits",
    "wn4_suppressed_candidates",
    "wn5_merged_rects",
    "e2_page_figures",
    "ml3_logistic_probe",
    "ml15_normalised_cache",
    "str1_register_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's compilers and the Python workers before the clock runs
    for name in ("reg2_harvest_in_order", "flt1_crop_pixel_gate"):
        registered.QUERIES[name](spark, folder).count()
    times = {}
    for name in names:
        start = time.perf_counter()
        registered.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
