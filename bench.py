"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "dataset_report", "readiness", "near_duplicates", "activity_by_dataset", "global_overview",
    "import_comments", "dedupe_rename", "patch_versions", "version_diff", "train_val_test_split",
    "ml_jsonl_lines", "normalize_boxes", "overlap_pairs", "coco_annotations", "coco_skipped",
    "yolo_lines", "media_stats", "presence_sessions", "team_board", "box_edit_versions",
)


def main() -> None:
    from checks import catalog
    from checks.compare import local_session
    from labelmill.staging import scratch

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    names = sys.argv[1:] or HEADLINE
    # Start the session's threads and code paths outside the timings.
    catalog.QUERIES["labels_by_field"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    taken = {}
    for name in names:
        start = time.time()
        with scratch(spark):
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(taken.values()), 3), "unit": "sec",
                "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
