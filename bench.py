"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textsignal import fixtures  # noqa: E402
from textsignal.plans import catalog, jobs  # noqa: E402
from textsignal.session import get_session, new_path  # noqa: E402
from textsignal.sources.tables import read_comments  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "label_distribution", "b02_clean_full", "b07_keyword_count", "b09_intensity", "c04_community_label",
    "d01_top_k_per_class", "d04_stratified_split", "d06_downsample", "d07_temporal_split", "d08_folds",
    "e04_vocabulary", "e06_tfidf", "f01_logistic", "f06_best_threshold", "g02_auc", "g04_report", "g05_roc_curve",
    "e11_assemble", "e12_variants", "f02_calibrated_svm", "f08_intensity_logistic", "f09_intensity_svm",
    "f10_refit_temporal", "g11_summary",
)
# Some 100 fits; timed on demand.
if os.environ.get("BENCH_GRID"):
    HEADLINE += ("f04_grid_search_logistic", "f04_grid_search_svm")


def main() -> None:
    spark = get_session(
        "bench", **{
            "spark.master": f"local[{CPUS}]", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": CPUS,
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["c01_pool_size"](spark, FOLDER).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    stored = new_path(spark, "comments")
    fixtures.comments(spark, FOLDER).write.parquet(stored)
    start = time.perf_counter()
    jobs.label_job(spark, read_comments(spark, stored), new_path(spark, "job")).count()
    seconds["label_job"] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
