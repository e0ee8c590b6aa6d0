"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from boxlake.plans import load_all  # noqa: E402
from boxlake.plans.registry import QUERIES  # noqa: E402
from boxlake.session import build_session  # noqa: E402

HEADLINE = [
    "a11_sweep", "a10_sheet_prf", "i1_suppress", "i2_match_pairs", "i3_components", "a26_grouped_paths",
    "a25_visible_paths", "j6_center_hits", "j8_iou_pairs", "j10_assign_tiles", "j11_nearest_distance",
    "w8_mine_negatives", "w3_stratified_split", "w5_holdout_split", "v1_v12_verify", "a13_roc_auc_detections",
    "a21_validation_bundle", "j17_nearest_crops", "p8_electrical_filter", "s3_geometries", "r1_exemplar_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM's workers
    times = {}
    for name in names:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "boxlake_headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
